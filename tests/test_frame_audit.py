import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quern.operators import frame_audit


def plain(rows, index, length):
    """The audit of one file's rows (vector, embedded, frame_index, index), by numpy on the whole."""
    if not rows:
        return (0, 0, False, None, None, None, None, None, [], None, None, ["missing_parquet"])
    errors, widths = set(), {len(r[0]) for r in rows}
    flat = np.asarray([x for r in rows for x in r[0]], dtype=np.float32)
    finite, told = bool(np.isfinite(flat).all()), [None] * 5
    if len(widths) > 1:
        errors.add("action_not_matrix")
    elif flat.size:
        m = np.asarray([r[0] for r in rows], dtype=np.float32)
        told = [hashlib.sha256(np.asarray(m.shape, dtype="<i8").tobytes() + m.tobytes()).hexdigest()]
        with np.errstate(all="ignore"):
            told += [[float(x) for x in f(axis=0)] for f in (m.min, m.max, m.mean, m.std)]
    embedded = sorted({r[1] for r in rows})
    contiguous = [r[2] for r in rows] == list(range(len(rows)))
    unique = len({r[3] for r in rows}) == len(rows)
    errors |= {n for n, bad in (("row_length_mismatch", len(rows) != length), ("nonfinite_action", not finite), ("embedded_episode_index_mismatch", embedded != [index]), ("frame_index_not_contiguous", not contiguous), ("index_not_unique_within_episode", not unique)) if bad}
    return (len(rows), widths.pop() if len(widths) == 1 else 0, finite, *told, embedded, contiguous, unique, sorted(errors))


NAMES = "rows action_dim finite action_sha256 minimum maximum mean std embedded frame_index_contiguous index_unique errors".split()


def same(a, b):
    return str(a) == str(b)


@pytest.mark.parametrize("batch", [3, 10_000])
def test_files_against_numpy(spark, tmp_path, batch):
    """Sound and spoiled episodes of several lengths and widths, in files whose rows are read in their order."""
    rng, want, listed = random.Random(8), {}, []
    for e in range(40):
        width, n = rng.choice([1, 2, 6]), rng.choice([1, 2, 7, 200, 1500])
        rows = [([rng.gauss(0, 10.0 ** rng.randint(-3, 4)) for _ in range(width)], e, t, 1000 * e + t) for t in range(n)]
        match e % 8:
            case 1:
                rows[-1] = ([*rows[-1][0], 1.0], *rows[-1][1:])
            case 2:
                rows[0][0][0] = float("inf")
            case 3:
                rows[0] = (rows[0][0], e + 1, rows[0][2], rows[0][3])
            case 4:
                rows[-1] = (*rows[-1][:2], 0 if n > 1 else 5, rows[-1][3])
            case 5:
                rows[-1] = (*rows[-1][:3], rows[0][3])
        length = n + (e % 8 == 6)
        listed.append((f"ep{e}", e, length))
        want[f"ep{e}"] = plain(rows, e, length)
        columns = {"action": pa.array([r[0] for r in rows], pa.list_(pa.float64())), "episode_index": [r[1] for r in rows], "frame_index": [r[2] for r in rows], "index": [r[3] for r in rows]}
        pq.write_table(pa.table(columns), tmp_path / f"ep{e}.parquet")
    listed.append(("ep99", 99, 4))
    want["ep99"] = plain([], 99, 4)
    frames = spark.read.parquet(str(tmp_path)).select("*", F.regexp_extract("_metadata.file_path", r"(ep[0-9]+)\.parquet$", 1).alias("key"), F.col("_metadata.row_index").alias("at"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        audits = frame_audit.frame_audits(frames, "key", ["at"], "action", embedded="episode_index", frame_index="frame_index", index="index")
        assert str(audits._jdf.queryExecution().executedPlan()).count("FileScan") == 1
        out = frame_audit.audited(spark.createDataFrame(listed, "key string, e long, n long"), audits, "key", "e", "n").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == len(listed)
    for r in out:
        assert same(tuple(r[n] for n in NAMES), want[r.key]), r.key
    assert len({e for w in want.values() for e in w[-1]}) == 7


def test_nulls_and_columns_that_are_not_there(spark):
    rows = [("a", 0, [1.0, None]), ("a", 1, [1.0, 2.0]), ("b", 0, None), ("c", 0, []), (None, 0, [3.0])]
    frames = spark.createDataFrame(rows, "k string, t int, v array<double>")
    by = {r.k: r for r in frame_audit.frame_audits(frames, "k", ["t"], "v").collect()}
    assert set(by) == {"a", "b", "c", None} and all(r.embedded is r.frame_index_contiguous is r.index_unique is None for r in by.values())
    assert (by["a"].rows, by["a"].is_matrix, by["a"].finite, by["a"].action_sha256) == (2, False, False, None)
    assert not by["b"].is_matrix and by["c"].is_matrix and by["c"].action_dim == 0 and by["c"].action_sha256 is None
    assert by[None].mean == [3.0] and by[None].std == [0.0]
    assert frame_audit.frame_audits(frames.limit(0), "k", ["t"], "v").count() == 0
