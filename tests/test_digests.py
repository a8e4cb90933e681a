import hashlib

import pytest
from pyspark.sql import functions as F

from quern.operators.digests import ordered_digest


def digest(values, separator="\n", trailing=False):
    return hashlib.sha256("".join(v + separator for v in values)[: None if trailing or not values else -len(separator)].encode()).hexdigest()


@pytest.mark.parametrize("trailing", [False, True])
def test_lists_across_batches(spark, trailing):
    rows = [(k, i, f"v{i * 7 % 1000}é") for k in ("a", "b", None) for i in range(700)] + [("c", 1, ""), ("d", 1, None), ("e", 2, "x"), ("e", 1, "y")]
    df = spark.createDataFrame(rows, "k string, i int, v string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        found = {r.k: r.digest for r in ordered_digest(df, ["k"], ["i"], "v", trailing=trailing).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    long = digest([f"v{i * 7 % 1000}é" for i in range(700)], trailing=trailing)
    assert found == {"a": long, "b": long, None: long, "c": digest([""], trailing=trailing), "e": digest(["y", "x"], trailing=trailing)}


def test_several_keys_and_an_empty_table(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("a"), (F.col("id") % 2 == 0).alias("b"), "id")
    found = {(r.a, r.b): r.d for r in ordered_digest(rows, ["a", "b"], ["id"], "id", ",", name="d").collect()}
    assert found == {(a, b): digest([str(i) for i in range(1000) if i % 3 == a and (i % 2 == 0) == b], ",") for a in range(3) for b in (True, False)}
    assert ordered_digest(rows.where("id < 0"), ["a"], ["id"], "id").collect() == []
