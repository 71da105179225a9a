"""Sessions."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Settings that suit any size: plans are adapted while they run, and partitions follow the data's size.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "shardloom", **settings: str) -> SparkSession:
    """A session with SETTINGS; without a master, that of the submitting cluster. Settings' dots are given as __."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()})
    return (builder.master(master) if master else builder).getOrCreate()


@contextmanager
def session(master: str | None = None, **settings: str) -> Iterator[SparkSession]:
    """A session that ends with the block."""
    spark = build_session(master, **settings)
    try:
        yield spark
    finally:
        spark.stop()


def checkpoints(spark: SparkSession) -> str:
    """The folder for checkpoint(): spark.checkpoint.dir, or a new temporary one where it is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = tempfile.mkdtemp(prefix="shardloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path
