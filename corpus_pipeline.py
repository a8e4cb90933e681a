"""From documents to packed sequences: quality, near duplicates, personal data, mix, packing.

Every stage takes what the one before kept, read from Parquet. All but the
last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go.

    Null and empty texts fail the rules and go; repeated rows are judged each
    for itself, very long texts whole. Other columns, whatever their names,
    stay as they are; an empty table stays empty.
    """
    from quern.llm import repetition

    return repetition.keep_unrepetitive(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the least id.

    Null and empty texts are one group; rows without an id come last. Of rows
    that share id and text, that whose columns have the least digest stays.
    Columns of any name stay as they are; an empty table stays empty.
    """
    from quern.llm import chosen_path

    return chosen_path.keep_one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, and ``n_chars`` put right.

    Every row stays, repeated ones too; null and empty texts stay so, and very
    long ones are worked through whole. The model is fitted on this stage's
    input. Other columns are not looked at; an empty table stays empty.
    """
    from quern.llm import segment_crf

    return segment_crf.redact(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken to the target weights, some in two epochs.

    A null language or source is a leaf of its own; null and empty texts weigh
    nothing and go with the prefix they stand in; rows that share id and text
    are taken together. Columns of any name stay; an empty table stays empty.
    """
    from quern.llm import entries, mixing

    return mixing.mix(docs, **entries.mix_options())


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences.

    Null and empty texts are one closing token. Repeated rows, and a
    document's two epochs, are documents of their own; very long texts are cut
    into pieces. Other columns are not looked at; no documents, no pieces.
    """
    from quern.llm import entries, packing

    return packing.pack_documents(docs, entries.tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mixture),
    ("packing", packed),
]

#: Tokens and the model's spans can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what they return is written to the shared folder and read again.

    A stage's rows are removed when the next one's are written; the last ones stay, as they are read by the caller.
    """
    from quern.llm.common import checkpoint_dir, remove, table

    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
