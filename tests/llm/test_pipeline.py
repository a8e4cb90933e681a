import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline
from quern.llm import packing, repetition, segment_crf


def documents(n=60):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8)))
    docs = []
    for i in range(n):
        text = [word() for _ in range(rng.randint(55, 90))]
        if i % 4 == 0:
            text[20] = f"{word()}.{i}@mail.example.com"
        docs.append((i, " ".join(text), rng.choice(["en", "de"]), f"src{i % 6}"))
    docs += [(1000 + i, docs[i][1], "en", "src1") for i in range(10)]  # exact copies
    docs += [(2000 + i, docs[i][1] + " more", "en", "src2") for i in range(10, 20)]  # near copies
    docs += [(3000, "word " * 200, "en", "src1"), (3001, None, "en", None), (3002, "", None, "src1"), docs[0]]
    return [(*d, None if d[1] is None else len(d[1])) for d in docs]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    docs = documents()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    df, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, df, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        df = spark.read.parquet(str(tmp_path / f"s{k}"))
        seen.append(df)
    quality, near, private, mixed, packed = seen
    assert {tuple(x.columns) for x in seen[:-1]} == {("doc_id", "text", "lang", "source", "n_chars")}
    kept = repetition.measure([(d[1] or "").encode() for d in docs], repetition.Limits())[-1]
    assert Counter(r.doc_id for r in quality.collect()) == Counter(d[0] for d, k in zip(docs, kept, strict=True) if k)
    assert sorted(r.doc_id for r in near.collect()) == list(range(60))
    rows = private.collect()
    assert sorted(r.doc_id for r in rows) == list(range(60))
    assert not [r for r in rows if segment_crf.base_spans(r.text)]
    assert sum("<email>" in r.text for r in rows) == 15 and all(r.n_chars == len(r.text) for r in rows)
    texts = {r.doc_id: r.text for r in rows}
    copies = Counter(r.doc_id for r in mixed.collect())
    assert copies and max(copies.values()) <= 2
    assert {(r.doc_id, r.text) for r in mixed.collect()} <= set(texts.items())
    starts = Counter(r.doc_id for r in packed.where("start = 0").collect())
    assert starts == copies
    spans = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.expr("offset + length")).alias("end"))
    assert spans.where(f"n <> end or n > {packing.SEQUENCE}").count() == 0


def test_run_equals_the_stages(spark, tmp_path):
    spark.createDataFrame(documents(20), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and "sequence_id" in out.columns


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
