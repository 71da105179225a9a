"""Scans and sinks."""

from __future__ import annotations

import os
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_parquet(spark: SparkSession, path: str | list[str], schema: StructType | None = None) -> DataFrame:
    """Parquet files or folders. With a schema no footer is opened to plan; filters and columns reach the scan."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*([path] if isinstance(path, str) else path))


def read_csv(spark: SparkSession, path: str, schema: StructType, header: bool = False) -> DataFrame:
    """CSV with a schema; empty fields are null, a line that doesn't fit stops the job."""
    return spark.read.schema(schema).csv(path, header=header, nullValue="", mode="FAILFAST")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and its place: file, block, at. Sorted by the three, lines stand as in the files, taken in order of path.

    No line is counted and nothing is moved. `at` orders the lines of one block only, as files are split and packed
    into partitions as the planner likes.
    """
    lines = spark.read.text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def tagged_union(sources: Iterable[tuple[object, DataFrame]], tag: str = "SourceId") -> DataFrame:
    """All rows of the sources, by column name, each with its source's literal; columns that a source lacks are null."""
    out = None
    for value, df in sources:
        df = df.withColumn(tag, F.lit(value))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources")
    return out


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    """Parquet with zstd. Output files follow the data's size, as AQE rebalances what is written."""
    df.hint("rebalance").write.mode(mode).option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def partition_histogram(df: DataFrame) -> DataFrame:
    """partition, rows: how rows lie over partitions."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("rows"))


def register(df: DataFrame, name: str) -> DataFrame:
    """df, known to SQL by the name for this session."""
    df.createOrReplaceTempView(name)
    return df




def to_frame(df: DataFrame, most_rows: int) -> pd.DataFrame:
    """A small table as pandas, for a report or a test; one of more than most_rows rows raises before it is fetched whole."""
    found = df.limit(most_rows + 1).toPandas()
    if len(found) > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    return found


def write_answers(path: str, name: str, answers: pd.DataFrame) -> str:
    """Expected results as one parquet file in a local folder, written without Spark; gives its path."""
    os.makedirs(path, exist_ok=True)
    at = os.path.join(path, f"{name}.parquet")
    pq.write_table(pa.Table.from_pandas(answers, preserve_index=False), at)
    return at


def read_answers(path: str, name: str) -> pd.DataFrame:
    return pq.read_table(os.path.join(path, f"{name}.parquet")).to_pandas()
