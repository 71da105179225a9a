"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b" \t\n\x0b\x0c\r"
#: The same as a Java and RE2 pattern of one word.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Maps A-Z to a-z and every other byte to itself.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Bytes of text that a Python worker holds at once, unless one text is longer.
SLICE_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a new temporary one where that is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = tempfile.mkdtemp(prefix="shardloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/shardloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str | Column) -> Column:
    """A text as bytes, null as none."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def unused(df: DataFrame, name: str) -> str:
    """The name, or one made of it, that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def crc_fold(column: str | Column, folds: int) -> Column:
    """crc32 of an id as text, modulo folds; a null id counts as an empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the bytes of a binary column stay near `most` in each; a longer value comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(offsets(batch.column(column)))
        before = np.cumsum(sizes) - sizes
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(before, before[start] + most)))
            end = min(end, batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def offsets(array: pa.Array) -> np.ndarray:
    """Offsets of a binary array without nulls, from its own first row on."""
    width = np.int64 if pa.types.is_large_binary(array.type) else np.int32
    found = np.frombuffer(array.buffers()[1], width, array.offset + len(array) + 1)[array.offset :]
    return found.astype(np.int64)


def packed(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (splitmix64's finaliser) of an unsigned array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all `width` neighbouring word hashes, doubling the span where possible."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, span, have = None, 0, mixed(h), 1
    left = width
    while left:
        if left & 1:
            part = span[done : done + n]
            out = part.copy() if out is None else mixed(out * np.uint64(0x9E3779B97F4A7C15) + part)
            done += have
        left >>= 1
        if left:
            span = mixed(span[: len(span) - have] * np.uint64(0xC2B2AE3D27D4EB4F) + span[have:])
            have *= 2
    return out
