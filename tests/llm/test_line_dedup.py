import hashlib
import random
import re
import time

import duckdb
from pyspark.sql import functions as F

from quern.llm import entries, line_dedup, oracles

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n_lines int, row string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return re.sub(r"^[ \t-\r]+|[ \t-\r]+$", "", line).translate(LOWER)


def plain(docs, least_docs=2, least_chars=10):
    holders = {}
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders.setdefault(key(line), set()).add(doc_id)
    out = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        gone = lambda own: len(own) >= least_docs and doc_id != min((x for x in own if x is not None), default=None)  # noqa: B023, E731
        kept = [x for x in lines if not gone(holders.get(key(x), set()))]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, *[str(x) for x in r]))


def report(spark, docs, **options):
    rows = [(d, t, 7, "x") for d, t in docs]
    return [tuple(r) for r in line_dedup.line_report(spark.createDataFrame(rows, SCHEMA), **options).collect()]


EDGES = [
    (5, "The same line here\nonly in five\nTHE SAME LINE HERE \n\ntail"),
    (3, "  the same line here\t\x0b\r\nthe same line here\nshort"),
    (9, "the same line here"),
    (9, "another text of the same id\nthe same line here"),
    (9, "the same line here"),
    (None, "the same line here\nonly without an id\nonly without an id"),
    (None, "only without an id"),
    (1, None),
    (2, ""),
    (4, "\n\n"),
    (6, "İSTANBUL ÜBER ALLES\nübergrößen"),
    (7, "İstanbul Über alles\nÜBERGRÖSSEN\nİSTANBUL ÜBER ALLES"),
    (8, "123456789\n1234567890\nshort"),
    (10, "123456789\n1234567890\nshort\r"),
    (-4, "a line that a negative id holds"),
    (0, "a line that a negative id holds\n a line that a negative id holds"),
]


def test_edges_against_plain_version(spark):
    assert by_id(report(spark, EDGES)) == by_id(plain(EDGES))
    assert by_id(report(spark, EDGES, least_docs=3, least_chars=1)) == by_id(plain(EDGES, 3, 1))


def test_random_texts_against_plain_version(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choices(["alpha", "Beta", "gamma", "DELTA"], k=rng.randint(0, 5))) + rng.choice(["", " ", "\r"]) for _ in range(60)]
    docs = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 12)))) for i in rng.sample(range(1000), 150)]
    docs += rng.sample(docs, 10)
    found = report(spark, docs)
    assert by_id(found) == by_id(plain(docs)) and sum(r[2] for r in found) > 100


def test_empty_table_and_clashing_names(spark):
    assert report(spark, []) == []
    rows = line_dedup.dedup_lines(spark.createDataFrame([(d, t, 7, "x") for d, t in EDGES], SCHEMA))
    assert rows.columns == ["row", "doc_id", "text", "n_lines", "n_dropped"]
    assert {(r.row.n_lines, r.row.row) for r in rows.collect()} == {(7, "x")} and rows.count() == len(EDGES)


def test_long_texts_take_linear_time(spark):
    first = "\n".join(f"line number {i} of the first" for i in range(0, 200_000, 2))
    second = "\n".join(f"line number {i} of the first" for i in range(200_000))
    began = time.time()
    found = sorted(report(spark, [(1, first), (2, second)]))
    assert [r[1:3] for r in found] == [(100_000, 0), (200_000, 100_000)] and time.time() - began < 60
    assert found == sorted(plain([(1, first), (2, second)]))


def test_query_against_sql_and_without_python(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    found = entries.op11_line_dedup(spark, DATA)
    want = con.execute(oracles.SQL["op11_line_dedup"]).fetchall()
    assert by_id(tuple(r) for r in found.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()) == by_id(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def test_a_hot_line_is_dealt_to_salts(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("one line in all of them\nown line "), F.col("id")).alias("text"))
    texts = docs.withColumn("text_digest", F.md5(F.col("text")))
    lines = texts.select("doc_id", F.md5(F.lit("x")).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(line_dedup.SALTS)).alias("salt"))
    assert line_dedup.shared_lines(lines, 2).count() == line_dedup.SALTS
    assert line_dedup.line_report(docs).agg(F.sum("n_dropped")).first()[0] == 1999
