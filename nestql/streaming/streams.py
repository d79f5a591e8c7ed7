"""Structured Streaming in the dialect's terms.

``mode = 'stream'`` reads without end and hands over partial results; a bounded
read of the same stream (``availableNow``) gives what a batch read would.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nestql.session import Session
from nestql.sources import MemoryCatalog


def file_stream(spark: SparkSession, path: str, like: str | None = None, max_files: int | None = None) -> DataFrame:
    """A stream of the Parquet files at a path; the schema is that of ``like`` or the path."""
    schema = spark.read.parquet(like or path).schema
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    folder, _, name = path.rstrip("/").rpartition("/")
    if name.endswith(".parquet"):
        # A stream reads folders; a file is picked out of its own by name.
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def deliver(df: DataFrame, consumer: Callable[[DataFrame, int], None], checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Hand each batch to a consumer. With a checkpoint, a restarted stream goes on where it was."""
    writer = df.writeStream.foreachBatch(consumer).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def run_available(df: DataFrame, sql: str, sink: str, checkpoint: str) -> DataFrame:
    """A query of the dialect over each batch of a stream, as table ``stream``; what is there now, and what came out.

    Each batch is written under its own number, so that one that is done again
    after a failure replaces itself.
    """

    def batch(part: DataFrame, number: int) -> None:
        session = Session(part.sparkSession, {"s": MemoryCatalog(part.sparkSession, {"stream": part})})
        session.sql(sql).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    deliver(df, batch, checkpoint).awaitTermination()
    return df.sparkSession.read.parquet(sink).drop("batch")


def windowed_counts(df: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows by window of event time and keys; rows later than ``late`` are left out, so state stays bounded."""
    ts = F.col(time).cast("timestamp")
    return df.withColumn(time, ts).withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))
