"""Exact top-k inner products by a three-phase uniform threshold.

A vector is cut into LISTS equal spans of components; a pair's score is the sum of its local scores over the spans.
Phase 1 gathers, for each query, the entries that lead each list of local scores in each part of the data; only these
are resolved, and the k-th best of them is a safe cutoff. Phase 2 broadcasts it: a pair that reaches the cutoff has a
local score of a LISTS-th of it in some list, so only such entries are collected, and those whose bound (what they have
and a LISTS-th for each list that they lack) falls short are dropped. Phase 3 resolves the scores that those left lack,
exactly, and ranks them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, stored, table

LISTS = 2
#: Queries that are broadcast at once; more take further passes over the vectors.
QUERY_BLOCK = 8192
#: Vectors scored at once in a worker.
ROW_BLOCK = 1024
#: Pairs resolved at once.
PAIRS = 1 << 15


def _matrices(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, whole components) by number of components, without vectors that are null or hold null or non-finite ones."""
    ids, lists = batch.column("vec_id"), batch.column("vec")
    keep = np.array(lists.is_valid()) & np.array(ids.is_valid())
    lengths = np.array(lists.value_lengths().fill_null(0))
    for dim in np.unique(lengths[keep]):
        rows = np.flatnonzero(keep & (lengths == dim))
        flat = lists.take(pa.array(rows)).flatten()
        x = np.array(flat.cast(pa.float64()).fill_null(np.nan)).reshape(len(rows), dim)
        fine = np.isfinite(x).all(1)
        yield np.array(ids.take(pa.array(rows)))[fine].astype(np.int64), np.floor(scale * x[fine])


def _kind(q: np.ndarray, x: np.ndarray) -> type:
    """The quickest number type in which all sums of products are exact."""
    most = q.shape[1] * float(abs(q).max(initial=0)) * float(abs(x).max(initial=0))
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


def _exact(a: np.ndarray, kind: type) -> np.ndarray:
    return np.vectorize(int, otypes=[object])(a) if kind is object and a.size else a.astype(kind)


def _spans(dim: int) -> list[slice]:
    edges = np.linspace(0, dim, LISTS + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products, ties to the smaller vec_id.

    Components become floor(scale * x). Vectors (or ids) that are null or hold null or non-finite components take no
    part; vectors of different lengths don't match; an empty vector scores 0 with others. Rows that bear the query's
    own id are not its candidates; other repeated rows are candidates each, and a query given more than once is asked
    once (with its smallest vector). A score beyond 64 bits stops the job. Fewer candidates than k give fewer rows; no
    query or vector gives none. Other columns are ignored. Queries are asked in blocks of about QUERY_BLOCK; the results
    of more than one block are written to the shared folder as they come, so the driver never holds more than a block.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"), is_query.alias("asks"))
    asking = rows.where("asks and vec is not null and vec_id is not null").groupBy("vec_id").agg(F.min("vec").alias("vec"))
    data = rows.select("vec_id", "vec")
    blocks = max(1, math.ceil(asking.count() / QUERY_BLOCK))
    if blocks == 1:
        return _one_block(spark, data, dict_of(asking.toArrow().combine_chunks().to_batches(), scale), k, scale)[0]
    asking, path = stored(asking, "top-queries"), new_path(spark, "top-found")
    for block in range(blocks):
        part = asking.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow()
        found, held = _one_block(spark, data, dict_of(part.combine_chunks().to_batches(), scale), k, scale)
        found.write.mode("append").parquet(path)
        for b in held:
            b.destroy()
    return spark.read.schema(found.schema).parquet(path)


def dict_of(batches: list[pa.RecordBatch], scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    found: dict[int, list] = {}
    for b in batches:
        for ids, x in _matrices(b, scale):
            found.setdefault(x.shape[1], []).append((ids, x))
    return {d: (np.concatenate([i for i, _ in p]), np.concatenate([x for _, x in p])) for d, p in found.items()}


def _resolved(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (q[i], x[j]) alone."""
    parts = [(q[i[at : at + PAIRS]] * x[j[at : at + PAIRS]]).sum(1) for at in range(0, len(i), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _one_block(spark: SparkSession, data: DataFrame, asked: dict, k: int, scale: float) -> tuple[DataFrame, list[Broadcast]]:
    """The result for a block of queries, and what has been broadcast for it."""
    queries = spark.sparkContext.broadcast(asked)
    kept = "query_id bigint, vec_id bigint, score bigint"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(query ids, queries, row ids, rows) of one length, in a number type that is exact."""
        for batch in batches:
            for ids, x in _matrices(batch, scale):
                if x.shape[1] not in queries.value:
                    continue
                q_ids, q = queries.value[x.shape[1]]
                for at in range(0, len(ids), ROW_BLOCK):
                    rows, some = ids[at : at + ROW_BLOCK], x[at : at + ROW_BLOCK]
                    kind = _kind(q, some)
                    yield q_ids, _exact(q, kind), rows, _exact(some, kind)

    def best_of(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        """The k best of each query among the task's entries, given piece by piece."""
        best: list[tuple] = []
        for entries in found:
            best.append(entries)
            if len(best) > 8:
                best = [_first(*map(np.concatenate, zip(*best, strict=True)), k)]
        if best:
            q, v, s = _first(*map(np.concatenate, zip(*best, strict=True)), k)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64())], ["query_id", "vec_id", "score"])

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The leaders of each local list among this task's rows; they alone are resolved."""

        def leaders() -> Iterator[tuple]:
            for q_ids, q, ids, x in pieces(batches):
                own, pick, n = q_ids[:, None] == ids[None, :], np.zeros((len(q_ids), len(ids)), bool), min(k, len(ids))
                for s in _spans(q.shape[1]):
                    local = np.where(own, -np.inf, q[:, s] @ x[:, s].T)
                    by = np.argsort(-local, 1) if local.dtype == object else np.argpartition(-local, n - 1, 1)
                    np.put_along_axis(pick, by[:, :n], True, 1)
                i, j = np.nonzero(pick & ~own)
                yield q_ids[i], ids[j], _resolved(q, x, i, j).astype(np.int64)

        yield from best_of(leaders())

    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    leaders = data.mapInArrow(lead, kept).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    cutoffs = leaders.groupBy("query_id").agg(F.min("score").alias("cutoff"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    # A row for each query of the block at most.
    cut = spark.sparkContext.broadcast({r["query_id"]: r["cutoff"] for r in cutoffs.collect()})

    def sufficient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries that may reach the cutoff, resolved; a query without a cutoff has fewer than k candidates: all."""

        def survivors() -> Iterator[tuple]:
            for q_ids, q, ids, x in pieces(batches):
                spans, most = _spans(q.shape[1]), cut.value
                least = np.array([most.get(i, None) for i in q_ids.tolist()], object)
                open_ended = np.array([c is None for c in least])
                share = np.array([0 if c is None else -(-c // LISTS) for c in least], object).astype(q.dtype)
                known, lists = np.zeros((len(q_ids), len(ids)), q.dtype), np.zeros((len(q_ids), len(ids)), np.int8)
                for s in spans:
                    local = q[:, s] @ x[:, s].T
                    enough = (local >= share[:, None]) | open_ended[:, None]
                    known += np.where(enough, local, 0)
                    lists += enough
                i, j = np.nonzero((lists > 0) & (q_ids[:, None] != ids[None, :]))
                known, lists = known[i, j], lists[i, j]
                cutoff = np.array([0 if c is None else c for c in least], object).astype(q.dtype)[i]
                # An entry lacks a list only where its local score there is below the share.
                may = (lists == len(spans)) | (known + (len(spans) - lists) * share[i] >= cutoff)
                i, j, known, lists, cutoff = i[may], j[may], known[may], lists[may], cutoff[may]
                part = lists < len(spans)
                known[part] = _resolved(q, x, i[part], j[part])
                ok = (known >= cutoff) | open_ended[i]
                yield q_ids[i[ok]], ids[j[ok]], known[ok].astype(np.int64)

        yield from best_of(survivors())

    ranked = data.mapInArrow(sufficient, kept).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), [queries, cut]


def _first(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query."""
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]][: len(q)])
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return q[rank < k], v[rank < k], s[rank < k]


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best matches of every vector whose id is divisible by 50 among all others."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
