"""Mergeable statistics: a state of (n, mean, m2, max) that batches add to in any order.

The merge of two states is Chan's: m2 = a + b + delta^2 * na * nb / n. As columns of a DataFrame, states of many
partitions, batches or days are merged by one aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class State:
    """Count, mean, sum of squared deviations and maximum of the numbers seen; none yet is (0, 0, 0, nothing)."""

    n: int = 0
    mean: float = 0.0
    m2: float = 0.0
    maximum: float | None = None

    def update(self, values: Sequence[float]) -> State:
        x = np.asarray([v for v in values if v is not None], float)
        if not len(x):
            return self
        mean = float(x.mean())
        return self.merge(State(len(x), mean, float(((x - mean) ** 2).sum()), float(x.max())))

    def merge(self, other: State) -> State:
        n = self.n + other.n
        if not self.n or not other.n:
            return self if self.n else other
        gap = other.mean - self.mean
        return State(n, self.mean + gap * other.n / n, self.m2 + other.m2 + gap * gap * self.n * other.n / n, max(self.maximum, other.maximum))

    def variance(self, ddof: int = 0) -> float | None:
        return self.m2 / (self.n - ddof) if self.n > ddof else None


def partial_states(df: DataFrame, keys: Sequence[str], *values: str) -> DataFrame:
    """keys, value, n, mean, m2, max: a row for each group, Arrow batch and name in values, made by numpy in one scan.

    A worker holds one batch and its groups' states, never a group's rows. Nulls are skipped.
    """
    source = df.select(*keys, *[F.col(v).cast("double").alias(f"__{i}") for i, v in enumerate(values)])
    fields = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            groups = pa.Table.from_batches([b.select(list(keys))]).append_column("__at", pa.array(np.arange(b.num_rows))).group_by(list(keys), use_threads=False).aggregate([("__at", "list")])
            places = [np.array(v.as_py()) for v in groups.column("__at_list")]
            own = [groups.column(k).combine_chunks() for k in keys]
            for i, v in enumerate(values):
                x = b.column(f"__{i}").to_numpy(zero_copy_only=False).astype(float)
                known = np.array(b.column(f"__{i}").is_valid())
                states = [State().update(x[at[known[at]]]) for at in places]
                columns = [pa.array([getattr(s, f) for s in states], t) for f, t in (("n", pa.int64()), ("mean", pa.float64()), ("m2", pa.float64()), ("maximum", pa.float64()))]
                yield pa.RecordBatch.from_arrays([*own, pa.array([v] * len(states), pa.string()), *columns], [*keys, "value", "n", "mean", "m2", "max"])

    return source.mapInArrow(run, f"{fields}, value string, n bigint, mean double, m2 double, max double")


def merge_states(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One state for each key: n, mean, m2, max.

    Sums of n and n * mean give the mean; then m2 is the sum of each state's own and of n times the square of its mean's
    distance. Both are plain aggregates, combined before their shuffles, so a key's states are never held together;
    states are spread once, by an exchange that both read.
    """
    spread = states.select(*keys, "n", "mean", "m2", "max").repartition(*keys, F.xxhash64("n", "mean", "m2"))
    total = F.sum("n")
    means = spread.groupBy(*keys).agg(total.alias("__n"), F.try_divide(F.sum(F.col("n") * F.col("mean")), total).alias("__mean"), F.sum("m2").alias("__m2"), F.max("max").alias("__max"))
    on = [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    both = spread.alias("s").join(means.alias("t"), on).select("s.*", "t.__n", "t.__mean")
    gap = F.col("mean") - F.col("__mean")
    m2 = F.sum(F.when(F.col("n") > 0, F.col("m2") + F.col("n") * gap * gap).otherwise(F.lit(0.0)))
    return both.groupBy(*keys).agg(F.max("__n").alias("n"), F.coalesce(F.max("__mean"), F.lit(0.0)).alias("mean"), m2.alias("m2"), F.max("max").alias("max"))


def state_variance(ddof: int = 0) -> Column:
    """The variance of merged states; null where there are too few rows."""
    return F.when(F.col("n") > ddof, F.col("m2") / (F.col("n") - F.lit(ddof)))
