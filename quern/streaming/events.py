"""The same statistics over streams of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_files(spark: SparkSession, path: str, files_a_batch: int = 8) -> DataFrame:
    """A stream of the parquet files that come into a folder."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def windowed(rows: DataFrame, ts: str, by: list[str], x: str, size: str, hop: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count, sum, least and most of each key in windows of event time, tumbling or hopping.

    On a stream, rows later than ``late`` behind the newest are dropped, and a
    window's state goes once no row can come for it.
    """
    rows = rows.withWatermark(ts, late) if rows.isStreaming else rows
    made = rows.groupBy(F.window(ts, size, hop) if hop else F.window(ts, size), *by).agg(
        F.count("*").alias("n"), F.sum(x).alias("total"), F.min(x).alias("least"), F.max(x).alias("most")
    )
    return made.select(F.col("window.start").alias("start"), *by, "n", "total", "least", "most")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is final to a table, until all that is there now is read."""
    return (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
