"""A corpus from raw documents: rules, near-duplicates, repeated passages, a mix of sources, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written and read again for the next.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm.bpe import encode_decode
from shardloom.llm.common import stored, table, utf8
from shardloom.llm.mixing import mixed_documents
from shardloom.llm.neardup import near_duplicates
from shardloom.llm.quality_rules import apply_rules, fitted
from shardloom.llm.suffixes import repeats

#: Near-duplicates share at least so many percent of their five-word shingles.
SIMILAR = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep."""
    return apply_rules(docs, fitted(spark, docs, sf_dir)).where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id, and of rows that repeat it, one."""
    found = near_duplicates(docs, SIMILAR).where("kept")
    # Texts without a word form no group; each such row is its own.
    alone = found.where("n_shingles = 0").select("node")
    one = found.where("n_shingles > 0").groupBy("component").agg(F.min("node").alias("node")).select("node")
    keep = stored(one.unionByName(alone).distinct(), "kept-nodes")
    marked = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", utf8("text")).alias("node"))
    return marked.join(keep, "node", "left_semi").dropDuplicates(["node"]).select("row.*")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages of 50 words or more that an earlier document has; those that are all such go."""
    cut = repeats(docs, cut=True).where("n_removed = 0 or n_removed < n_words")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them; the one at a source's cut with the words up to it."""
    mixed = mixed_documents(docs)
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast("long"))
    return mixed.select(*docs.columns)


def _tokens(ids: pa.Array, flat: np.ndarray, counts: np.ndarray, decoded: list[bytes]) -> pa.RecordBatch:
    ends = np.r_[0, np.cumsum(counts)].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))
    sums = pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string())
    return pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), lists, sums], ["doc_id", "n_tokens", "ids", "decoded_sha256"])


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and a digest of the text that they decode to."""
    import public_tokenizers as P

    return encode_decode(docs, P.path("word_bpe_49k.json"), _tokens, "doc_id bigint, n_tokens bigint, ids array<int>, decoded_sha256 string")


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("mix_sources", mix_sources), ("bpe", bpe)]

#: SQL can't express the decoding of a trained model; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
