"""Token counts through a digest cache.

A text's SHA-256 and the digest of the tokenizer's files name its count. Counts that the cache holds are joined to
the documents; each other distinct text is encoded once, and its count is appended to the cache.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_path, slices, stored, table, unused, utf8

CACHE_SCHEMA = T.StructType([T.StructField("tokenizer", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])
#: Missing digests that may be broadcast: some MB at most. Digests with more than such a share of the rows are dealt out.
FEW, HOT_SHARE = 100_000, 1000
#: Added token of the vocabulary byte_bpe_50k (fixed value); in a text, the library takes it for one token.
END_OF_TEXT = "<|endoftext|>"


def tokenizer_version(*paths: str) -> str:
    """A digest of all that the counts depend on: the files' bytes."""
    h = hashlib.sha256()
    for p in paths:
        with open(p, "rb") as f:
            h.update(hashlib.sha256(f.read()).digest())
    return h.hexdigest()


def byte_bpe_counter(rank_file: str, pattern: str, special: str = END_OF_TEXT):
    """A function from a text to its number of tokens under a byte-level BPE.

    The rank file holds the vocabulary and merges of the .json file of the same name; its encoder is the quicker of
    the two and gives the same ids (tests/llm compares them). The special string is one token, as by default there.
    """
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def count(text: str) -> int:
        parts = text.split(special)
        return len(parts) - 1 + sum(len(encode(p)) for p in parts if p)

    return count


def count_tokens(docs: DataFrame, cache_path: str, rank_file: str, pattern: str, version: str, text_col: str = "text") -> DataFrame:
    """docs with digest, n_bytes and n_tokens, from the cache at cache_path (made if there is none).

    Null text counts as empty: 0 bytes, 0 tokens; that is all there is to normalise, as counts depend on every byte.
    Repeated texts, whatever their ids, are encoded once. Columns of docs named like the three added are replaced, other
    names can't clash. An empty table gives an empty result and leaves the cache as it was. Appending is one Spark write:
    a failed job leaves no count behind, and a digest that two jobs append is read once.

    Texts are sent only if their counts are missing: up to FEW missing digests are broadcast to find their texts, more
    are joined with all. Digests of more than a HOT_SHARE-th of the rows, of which there are fewer than that, are dealt
    to as many parts as they have such shares when counts are joined back.
    """
    spark = docs.sparkSession
    docs = docs.drop("digest", "n_bytes", "n_tokens")
    body = utf8(text_col)
    # A row's place: which copy of a text is encoded is settled on narrow rows, and only that copy's text is sent.
    place = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.lit(1))
    digest = F.unhex(F.sha2(body, 256)).alias("digest")
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)

    def cached() -> DataFrame:
        held = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
        return held.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    digests = stored(docs.select(digest, place.alias("place")).groupBy("digest").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("copies")), "token-digests")
    missing = stored(digests.join(cached(), "digest", "left_anti").select("digest", "place"), "token-misses")
    lacking = missing.count()
    texts = docs.select(digest, place.alias("place"), body.alias("body"))
    if lacking <= FEW:
        texts = texts.join(F.broadcast(missing), ["digest", "place"]).dropDuplicates(["digest"])
    else:
        texts = texts.join(missing, ["digest", "place"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, last = byte_bpe_counter(rank_file, pattern), (None, 0)
        for b in slices(batches, "body"):
            n = []
            for d, x in zip(b.column("digest").to_pylist(), b.column("body").to_pylist(), strict=True):
                # Rows alike in every column come one after another.
                last = last if last[0] == d else (d, count(str(x, "utf-8", "replace")))
                n.append(last[1])
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    if lacking:
        fresh = texts.select("digest", "body").mapInArrow(encode, "digest binary, n_tokens bigint").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
        fresh.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    rows = digests.agg(F.sum("copies")).first()[0] or 0
    share = max(1, -(-rows // HOT_SHARE))
    part, parts = unused(docs, "part"), unused(docs, "parts")
    hot = F.broadcast(digests.where(F.col("copies") > share).select("digest", F.ceil(F.col("copies") / share).alias(parts)))
    n_parts = F.coalesce(parts, F.lit(1))
    keyed = docs.withColumns({"digest": digest, "n_bytes": F.octet_length(body).cast("long")})
    dealt = keyed.join(hot, "digest", "left").withColumn(part, F.pmod(F.monotonically_increasing_id(), n_parts)).drop(parts)
    counts = cached().join(hot, "digest", "left").select("digest", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), n_parts - 1)).alias(part))
    return dealt.join(counts, ["digest", part]).select(*[f"`{c}`" for c in docs.columns], "digest", "n_bytes", "n_tokens")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents with byte_bpe_50k, from an empty cache, so that each run encodes every distinct text."""
    import public_tokenizers as P

    version = tokenizer_version(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, new_path(spark, "token-counts"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, version)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
