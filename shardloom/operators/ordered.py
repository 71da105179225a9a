"""Operators over ordered rows that no single task has to hold."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoints

#: Rows of one key in one span; a key with more is cut into more spans of its order.
SPAN_ROWS = 100_000


def running_sums(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], sums: dict[str, Column], tops: dict[str, Column] | None = None, span_rows: int = SPAN_ROWS, own: dict[str, Column] | None = None) -> DataFrame:
    """df with the sums and greatest values, by name, over each key's rows up to and with this one, by (order, ties).

    A key's rows are cut into spans of equal width of the numeric column `order`; spans are added up first (a row for
    each), then rows within a span. So a hot key is worked on by as many tasks as it has spans. The order must be total
    and not null; null keys form a group; null values count as 0 in sums and are skipped among the greatest. own gives
    further aggregates, by name, over the rows so far of the row's own span alone.
    """
    tops = tops or {}
    given = {f"__v_{n}": F.coalesce(v, F.lit(0)) for n, v in sums.items()} | {f"__v_{n}": v for n, v in tops.items()}
    rows = df.withColumns(given)
    extent = rows.groupBy(*keys).agg(F.min(order).alias("__first"), F.max(order).alias("__last"), F.ceil(F.count(F.lit(1)) / span_rows).alias("__spans"))
    same = lambda a, b, names: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in names]
    placed = rows.alias("r").join(extent.alias("x"), same("r", "x", keys)).select("r.*", "__first", "__last", "__spans")
    width = (F.col(order) - F.col("__first")) / (F.col("__last") - F.col("__first") + F.lit(1))
    placed = placed.withColumn("__span", F.floor(width * F.col("__spans"))).drop("__first", "__last", "__spans")
    before = Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    merge = {n: F.sum for n in sums} | {n: F.max for n in tops}
    starts = placed.groupBy(*keys, "__span").agg(*[f(f"__v_{n}").alias(f"__s_{n}") for n, f in merge.items()])
    starts = starts.select(*keys, "__span", *[f(f"__s_{n}").over(before).alias(f"__b_{n}") for n, f in merge.items()])
    both = placed.alias("r").join(starts.alias("s"), same("r", "s", [*keys, "__span"])).select("r.*", *[f"__b_{n}" for n in merge])
    within = Window.partitionBy(*keys, "__span").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    done = {n: F.coalesce(f"__b_{n}", F.lit(0)) + F.sum(f"__v_{n}").over(within) for n in sums} | {n: F.greatest(f"__b_{n}", F.max(f"__v_{n}").over(within)) for n in tops}
    done |= {n: v.over(within) for n, v in (own or {}).items()}
    return both.withColumns(done).drop("__span", *[f"__{k}_{n}" for n in merge for k in "vb"])


def running_sum(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], value: Column, name: str, span_rows: int = SPAN_ROWS) -> DataFrame:
    """running_sums of one value."""
    return running_sums(df, keys, order, ties, {name: value}, span_rows=span_rows)


def sorted_locally(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with each key's rows in one partition, sorted there: the keys' rows come in order, one key after another.

    A key is one task's; for keys that are too large for one, see running_sums.
    """
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def zip_with_index(df: DataFrame, order: Sequence[str], name: str = "rowId", offset: int = 1) -> DataFrame:
    """df with a dense number for each row, by a total order; sorted by it.

    Rows are sorted in ranges once and kept by checkpoint, so that counting ranges and numbering rows see the same ones.
    """
    checkpoints(df.sparkSession)
    ranged = df.sort(*order).select("*", F.monotonically_increasing_id().alias("__at")).checkpoint()
    block = F.shiftright("__at", 33).alias("__range")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(block).agg(F.count(F.lit(1)).alias("__n"))
    starts = starts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = F.col("__at") - F.shiftleft(F.shiftright("__at", 33), 33)
    return ranged.withColumn("__range", block).join(starts, "__range").withColumn(name, (F.col("__start") + within + offset).cast("long")).drop("__range", "__at", "__start")


def ordered_aggregate(
    df: DataFrame,
    order: Sequence[str],
    fold: Callable[[Iterator[pd.DataFrame]], bytes],
    combine: Callable[[list[bytes]], bytes],
    fan_in: int = 32,
) -> DataFrame:
    """One row, state: an aggregate that is associative but not commutative.

    Rows are sorted in ranges; fold turns each range's frames, in order, into a state; combine joins neighbouring
    states, fan_in at a time, until one is left. No rows give no state.
    """
    checkpoints(df.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: list[int] = []

        def own() -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    at.append(int(f["__at"].iloc[0]))
                    yield f.drop(columns="__at")

        state = fold(own())
        if at:
            yield pd.DataFrame({"at": [at[0] >> 33], "state": [state]})

    states = df.sort(*order).withColumn("__at", F.monotonically_increasing_id()).mapInPandas(run, "at bigint, state binary").checkpoint()

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        return pd.DataFrame({"at": [int(pdf["at"].iloc[0]) // fan_in], "state": [combine(list(pdf["state"]))]})

    # Ranges are numbered, so each round divides the greatest number by fan_in.
    left = states.agg(F.max("at")).first()[0]
    while left is not None and left > 0:
        states = states.groupBy(F.expr(f"at div {fan_in}")).applyInPandas(join, "at bigint, state binary").checkpoint()
        left //= fan_in
    return states.select("state")
