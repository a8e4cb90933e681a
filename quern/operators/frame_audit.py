"""One audit of a frame table: what an episode's vectors are, and what is wrong with them, in one scan."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = (
    "rows long, action_dim long, finite boolean, action_sha256 string, minimum array<double>, maximum array<double>, "
    "mean array<double>, std array<double>, embedded array<long>, frame_index_contiguous boolean, index_unique boolean, is_matrix boolean"
)
OPTIONAL = ("embedded", "frame_index", "index")


class Episode:
    """What is gathered of one episode: its vectors as 4-byte numbers, and its indices."""

    def __init__(self) -> None:
        self.widths: set[int] = set()
        self.rows, self.nulls = 0, False
        self.values: list[np.ndarray] = []
        self.columns: dict[str, list[np.ndarray]] = {c: [] for c in OPTIONAL}
        self.lacking: set[str] = set()

    def add(self, vectors: pa.Array, columns: dict[str, pa.Array]) -> None:
        self.rows += len(vectors)
        sizes = np.diff(vectors.offsets.to_numpy())
        self.widths.update(np.unique(sizes).tolist())
        flat = vectors.flatten()
        self.nulls |= bool(vectors.null_count or flat.null_count)
        self.values.append(flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype("<f4"))
        for name, column in columns.items():
            if column.null_count:
                self.lacking.add(name)
            else:
                self.columns[name].append(column.to_numpy(zero_copy_only=False))

    def audit(self) -> tuple:
        """Values in the order of ``FIELDS``; arithmetic is that of 4-byte numbers, row after row."""
        values = np.concatenate(self.values)
        matrix = len(self.widths) == 1 and not self.nulls
        finite = bool(np.isfinite(values).all()) and not self.nulls
        width = next(iter(self.widths)) if len(self.widths) == 1 else 0
        told = [None] * 5
        if matrix and values.size:
            made = values.reshape(self.rows, width)
            shape = np.asarray(made.shape, dtype="<i8").tobytes()
            told = [hashlib.sha256(shape + made.tobytes()).hexdigest()]
            with np.errstate(all="ignore"):
                told += [[float(x) for x in f(axis=0)] for f in (made.min, made.max, made.mean, made.std)]
        own = {n: np.concatenate(c) if c and n not in self.lacking else None for n, c in self.columns.items()}
        embedded = None if own["embedded"] is None else np.unique(own["embedded"]).tolist()
        frame, index = own["frame_index"], own["index"]
        return (
            self.rows,
            width,
            finite,
            *told,
            embedded,
            None if frame is None else bool(np.array_equal(frame, np.arange(len(frame)))),
            None if index is None else len(np.unique(index)) == len(index),
            matrix,
        )


def _audits(source: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (key, vector, OPTIONAL) that come sorted by key and place; a row for each key."""
    key, episode = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((key, *episode.audit()), schema, strict=True)], schema=schema)

    for batch in source:
        keys = batch.column(0)
        ends = pc.run_end_encode(keys).run_ends.to_pylist() if batch.num_rows else []
        first = 0
        for last in ends:
            own = keys[first].as_py()
            if episode is None or own != key:
                if episode is not None:
                    yield row()
                key, episode = own, Episode()
            part = batch.slice(first, last - first)
            episode.add(part.column(1), {c: part.column(2 + i) for i, c in enumerate(OPTIONAL)})
            first = last
    if episode is not None:
        yield row()


def frame_audits(frames: DataFrame, key: str, order: list[str], vector: str, **columns: str) -> DataFrame:
    """(key, FIELDS) of each episode's frames in their order.

    ``columns`` names what frames have of ``embedded`` (the episode's index),
    ``frame_index`` and ``index``; what isn't named, or is null somewhere, is
    told as null. Vectors of several widths, or null ones or values, are no
    matrix, and have no digest and moments. Frames are dealt by episode,
    sorted there, and taken batch by batch; an episode, as a file has it, is
    held as 4-byte numbers.
    """
    optional = [(F.col(columns[c]) if c in columns else F.lit(None)).cast("long").alias(f"_{c}") for c in OPTIONAL]
    slim = frames.select(F.col(key), F.col(vector).cast("array<float>").alias("_vector"), *optional, *[F.col(o).alias(f"_at_{i}") for i, o in enumerate(order)])
    placed = slim.repartition(key).sortWithinPartitions(key, *[f"_at_{i}" for i in range(len(order))])
    rows = placed.select(key, "_vector", *[f"_{c}" for c in OPTIONAL])
    out = T.StructType.fromDDL(f"{key} {dict(frames.dtypes)[key]}, {FIELDS}")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        yield from _audits(source, to_arrow_schema(out))

    return rows.mapInArrow(run, out)


def audited(episodes: DataFrame, audits: DataFrame, key: str, index: str, length: str) -> DataFrame:
    """Each of the listed episodes (key, index, length) with its audit and ``errors``, in order; one without frames is ``missing_parquet``."""
    joined = episodes.select(key, index, length).join(audits, key, "left")
    there = F.col("rows").isNotNull()
    rules: dict[str, Column] = {
        "action_not_matrix": there & ~F.col("is_matrix"),
        "embedded_episode_index_mismatch": F.col("embedded") != F.array(F.col(index).cast("long")),
        "frame_index_not_contiguous": ~F.col("frame_index_contiguous"),
        "index_not_unique_within_episode": ~F.col("index_unique"),
        "missing_parquet": ~there,
        "nonfinite_action": ~F.col("finite"),
        "row_length_mismatch": F.col("rows") != F.col(length),
    }
    errors = F.array_compact(F.array(*[F.when(broken, name) for name, broken in rules.items()]))
    none = {"rows": F.lit(0).cast("long"), "action_dim": F.lit(0).cast("long"), "finite": F.lit(False)}
    told = {c: F.coalesce(c, x) for c, x in none.items()} | {"embedded": F.coalesce("embedded", F.array().cast("array<long>"))}
    return joined.withColumn("errors", errors).withColumns(told).drop("is_matrix")
