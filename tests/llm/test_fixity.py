import hashlib
import random

from pyspark.sql import functions as F

from quern.llm import fixity as X

PAGES = "page_id long, url string, html string, volume string, digest int"


def manifest_of(spark, rows):
    return spark.createDataFrame(rows, "volume string, offset long, length long, copies long, digest string")


def plain_root(rows, span, fanout, levels):
    nodes = {}
    for _, offset, length, copies, digest in sorted(rows, key=lambda r: r[1]):
        nodes.setdefault(offset // span, []).append(f"{offset} {length} {copies} {digest}")
    nodes = {p: hashlib.sha256("\n".join(v).encode()).hexdigest() for p, v in nodes.items()}
    for _ in range(levels):
        up = {}
        for p in sorted(nodes):
            up.setdefault(p // fanout, []).append(f"{p} {nodes[p]}")
        nodes = {p: hashlib.sha256("\n".join(v).encode()).hexdigest() for p, v in up.items()}
    return nodes.get(0)


def test_audit_finds_what_differs(spark):
    rng = random.Random(1)
    a = []
    for v in ("v1", "v2", None, "whole"):
        at = 0
        for _ in range(60):
            n = rng.randint(1, 40)
            a.append((v, at, n, 1, f"{rng.random()}"))
            at += n
    b, want = [], []
    for row in a:
        v, at, n, copies, digest = row
        kind = rng.choice(["same"] * 30 + ["changed", "missing"]) if v != "v2" else "same"
        kind = "missing" if v == "whole" else kind
        if kind == "changed":
            b.append((v, at, n, copies, "other"))
        elif kind == "same":
            b.append(row)
        if kind != "same":
            want.append((v or "(none)", at, n, kind))
    b.append(("v1", 10**6, 5, 1, "x"))
    want.append(("v1", 10**6, 5, "extra"))
    out = X.audit(manifest_of(spark, a), manifest_of(spark, b), span=50, fanout=3, levels=3).collect()
    assert sorted((r.volume, r.offset, r.length, r.kind) for r in out) == sorted(want)
    for r in out:
        name = None if r.volume == "(none)" else r.volume
        assert r.root == plain_root([x for x in a if x[0] == name], 50, 3, 3)
        assert r.replica_root == plain_root([x for x in b if x[0] == name], 50, 3, 3)


def test_equal_and_empty_replicas(spark):
    a = manifest_of(spark, [("v", 0, 3, 1, "d"), ("v", 3, 3, 1, "e")])
    none = a.limit(0)
    assert X.audit(a, a).count() == X.audit(none, none).count() == 0
    assert {r.kind for r in X.audit(a, none).collect()} == {"missing"}
    assert {r.kind for r in X.audit(none, a).collect()} == {"extra"}


def test_manifest_lays_records_out_without_gaps(spark):
    rows = [(i, f"http://h/{i}", "é" * (i % 7), "x", 1) for i in range(40)] + [(None, None, None, "x", 1)] * 5 + [(3, "http://h/3", "ééé", "x", 1)] * 2
    pages = spark.createDataFrame(rows, PAGES)
    content = X.record(F.col("url"), F.col("html"))
    out = X.manifest(pages, content).collect()
    assert sum(r.copies for r in out) == len(rows)
    for v in {r.volume for r in out}:
        at = 0
        for r in sorted((r for r in out if r.volume == v), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length * r.copies
    assert X.manifest(pages.limit(0), content).count() == 0


def test_files_round_trip(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "<p>é\r\n\r\n" * i, "v", 0) for i in range(9)], PAGES)
    content = X.record(F.col("url"), F.col("html"))
    made = X.manifest(pages, content).join(pages.select(F.sha2(content, 256).alias("digest"), content.cast("binary").alias("content")), "digest")
    files = X.volume_files(made.select("volume", "offset", "content"))
    read = X.read_records(files).select("volume", "offset", F.sha2("content", 256).alias("digest"))
    assert sorted(map(tuple, read.collect())) == sorted((r.volume, r.offset, r.digest) for r in made.collect())
    assert list(X.parse(b"junk")) == [(0, b"junk")]


def test_production_levels_over_many_partitions(spark):
    rng = random.Random(4)
    a = []
    for v in range(12):
        at = 0
        for _ in range(40):
            n = rng.randint(1, 60_000)
            a.append((f"v{v}", at, n, 1, f"{rng.random()}"))
            at += n
    b = [(*r[:4], "other") if i in (5, 200) else r for i, r in enumerate(a) if i != 100]
    out = X.audit(manifest_of(spark, a).repartition(50), manifest_of(spark, b).repartition(37))
    assert sorted((r.volume, r.offset, r.kind) for r in out.collect()) == sorted(
        [(*a[5][:2], "changed"), (*a[200][:2], "changed"), (*a[100][:2], "missing")]
    )
    # The plan of the result does not hold the trees below it.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 0
    tree = X.tree(manifest_of(spark, a), span=X.SPAN, fanout=X.FANOUT, levels=X.LEVELS)
    assert tree[-1].where("volume = 'v3'").first().hash == plain_root([r for r in a if r[0] == "v3"], X.SPAN, X.FANOUT, X.LEVELS)


def test_volumes_of_nulls_and_repeats(spark):
    rows = [("v", 0, bytearray(b"b")), ("v", 0, bytearray(b"a")), ("v", 1, None), (None, 0, bytearray(b"z")), ("v", 0, bytearray(b"a"))]
    df = spark.createDataFrame(rows, "volume string, offset long, content binary")
    got = {r.volume: bytes(r.content) for r in X.volume_files(df).collect()}
    assert got == {"v": b"aab", None: b"z"}
    assert X.volume_files(df.limit(0)).count() == X.read_records(X.volume_files(df.limit(0))).count() == 0
