"""Small helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
#: ``bytes.split()`` without arguments splits at these six, and at no others.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only these two columns, as ``doc_id`` and ``text``; a null text is empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def text_digest(text: Column) -> Column:
    """128 bits that stand for a whole text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where all tasks run in this machine, as in tests."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not (sc.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder, which survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows written once to a table in the shared folder and read from there, by columns; it stays until the folder is cleared."""
    folder = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def slices(texts: pa.Array, max_bytes: int) -> Iterator[tuple[int, int]]:
    """(first, after the last) of runs of at most ``max_bytes`` of text or one text, whichever is more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first, before = 0, 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
        yield first, last
        first, before = last, ends[last - 1]


def batches(
    source: Iterator[pa.RecordBatch], max_bytes: int = 8 << 20
) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, UTF-8 texts) in runs of at most ``max_bytes`` of text or one text, whichever is more."""
    for batch in source:
        ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
        for first, last in slices(texts, max_bytes):
            yield ids.slice(first, last - first).to_pylist(), texts.slice(first, last - first).to_pylist()
    pa.default_memory_pool().release_unused()


def task_partition() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0
