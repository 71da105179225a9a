"""Connected components of an edge list."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def _cut(edges: DataFrame, folder: str | None) -> tuple[DataFrame, tuple]:
    """edges(u, v) with its lineage cut in shared storage, and a state that differs where the edges do."""
    h = F.xxhash64("u", "v")
    state = [F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 20)).alias("s")]
    if folder is None:
        edges = edges.checkpoint()
        return edges, tuple(edges.agg(*state).first())
    seen, path = Observation(), f"{folder}/edges-{uuid.uuid4().hex}"
    # The state is taken from what is written, in the same job.
    edges.observe(seen, *state).write.parquet(path)
    return edges.sparkSession.read.schema(edges.schema).parquet(path), tuple(seen.get[k] for k in ("n", "x", "s"))


def connected_components(edges: DataFrame, left: str = "u", right: str = "v", folder: str | None = None, most_rounds: int = 50) -> DataFrame:
    """node, component: each node of the edges with the smallest node that it can reach.

    Alternates two star contractions, each a min per node (combined before the shuffle) and a join, until the edges no
    longer change; rounds grow with the logarithm of the longest path. Lineage is cut each round, by checkpoint() or in
    a folder that all executors share. Nulls and loops are ignored; a graph that takes more rounds raises.
    """
    pairs = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v").distinct()
    pairs, state = _cut(pairs, folder)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        pairs, after = _cut(small.distinct(), folder)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    found = pairs.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = pairs.select(F.col("v").alias("node")).distinct().join(found.select("node"), "node", "left_anti")
    return found.unionByName(roots.select("node", F.col("node").alias("component")))
