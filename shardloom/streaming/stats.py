"""The statistics over streams: files as they come, and windows of event time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.stats import grouped_stats


def parquet_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Files of a folder as a stream, at most so many in a batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def stream_stats(stream: DataFrame, keys: Sequence[str], mean: str, maximum: str, var: str, ddof: int = 0) -> DataFrame:
    """grouped_stats of all that has come; Spark keeps one mergeable buffer per key as state. For complete or update mode."""
    return grouped_stats(stream, keys, mean, maximum, var, ddof=ddof)


def windowed_stats(stream: DataFrame, time: str, width: str, lateness: str, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, maximum and variance of each window of event time and key.

    Rows later than the watermark allows are left out, and a window is dropped from state, and in append mode given out, once it is past.
    """
    marked = stream.withWatermark(time, lateness)
    out = marked.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.var_pop(value).alias("var"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "mean", "max", "var")


def run_available(result: DataFrame, table: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Works off what is there, into a table in memory, and ends."""
    query = result.writeStream.outputMode(mode).format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
