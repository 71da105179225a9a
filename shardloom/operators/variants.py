"""Other formulations of the statistics, kept to be held against the canonical ones and to offer their surfaces.

Each gives the result of grouped_stats, conditional_stats or bilevel_stats. Where Python sees groups, it sees them in
bounded parts whose states are merged, and so does conditional_window. bilevel_window works on a whole inner group in one
task: it is there to be compared, not to be used on large groups.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .ordered import running_sums
from .progressive import merge_states, partial_states, state_variance
from .stats import hand_variance

#: Rows of a Python group; a group with more is dealt into parts.
PART_ROWS = 50_000


def in_parts(df: DataFrame) -> DataFrame:
    """df with __part: numbers that cut each partition, and so any group in it, into parts of PART_ROWS rows at most."""
    row = F.monotonically_increasing_id()
    # The id's upper bits are the partition, its lower 33 the row in it.
    within = row.bitwiseAND(F.lit((1 << 33) - 1))
    return df.withColumn("__part", F.shiftleft(F.shiftright(row, 33), 33) + F.floor(within / PART_ROWS))


def grouped_sql(df: DataFrame, keys: Sequence[str], c: str, d: str, e: str) -> DataFrame:
    """Plain SQL over a view."""
    by = ", ".join(keys)
    query = f"SELECT {by}, avg({c}) AS mean_of_C, max({d}) AS max_of_D, var_pop({e}) AS var_of_E, sum({e} * {e}) / nullif(count({e}), 0) - power(avg({e}), 2) AS var_of_E2 FROM {{t}} GROUP BY {by}"
    return df.sparkSession.sql(query, t=df)


def _of_states(states: DataFrame, keys: Sequence[str], c: str, d: str, e: str) -> DataFrame:
    """The statistics from states of the columns c, d and e, named by value."""
    merged = merge_states(states, [*keys, "value"])
    of = lambda v, x: F.max(F.when(F.col("value") == v, x))
    mean, var = F.when(F.col("n") > 0, F.col("mean")), state_variance()
    return merged.groupBy(*keys).agg(of(c, mean).alias("mean_of_C"), of(d, F.col("max")).alias("max_of_D"), of(e, var).alias("var_of_E"), of(e, var).alias("var_of_E2"))


def grouped_partials(df: DataFrame, keys: Sequence[str], c: str, d: str, e: str) -> DataFrame:
    """Batch states made by numpy in one scan, merged by aggregations."""
    return _of_states(partial_states(df, keys, *dict.fromkeys((c, d, e))), keys, c, d, e)


def grouped_map(df: DataFrame, keys: Sequence[str], c: str, d: str, e: str) -> DataFrame:
    """Groups of pandas rows: each batch is grouped by pandas where it is, and its groups' states are merged.

    No row is shuffled, and a worker holds one batch.
    """
    values = list(dict.fromkeys((c, d, e)))
    source = df.select(*keys, *[F.col(v).cast("double").alias(f"__{i}") for i, v in enumerate(values)])
    kinds = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            by = pdf.groupby(list(keys), dropna=False, sort=False)
            for i, v in enumerate(values):
                x = by[f"__{i}"]
                pdf["__gap"] = (pdf[f"__{i}"] - x.transform("mean")) ** 2
                states = pd.DataFrame({"n": x.count(), "mean": x.mean().fillna(0.0), "m2": pdf.groupby(list(keys), dropna=False, sort=False)["__gap"].sum(), "max": x.max()}).reset_index()
                states.insert(len(keys), "value", v)
                yield states

    return _of_states(source.mapInPandas(run, f"{kinds}, value string, n bigint, mean double, m2 double, max double"), keys, c, d, e)


@F.pandas_udf(ArrayType(DoubleType()))
def moments(x: pd.Series) -> np.ndarray:
    """A user-defined aggregate: count, mean and sum of squared deviations of a part."""
    x = x.dropna().to_numpy(float)
    mean = float(x.mean()) if len(x) else 0.0
    return np.array([len(x), mean, float(np.inner(x - mean, x - mean))])


def grouped_udaf(df: DataFrame, keys: Sequence[str], c: str, d: str, e: str, ddof: int = 0) -> DataFrame:
    """A user-defined aggregate for the variance (of the population, or with ddof=1 of a sample) beside built-in ones, by parts."""
    parts = in_parts(df.select(*keys, e)).groupBy(*keys, "__part").agg(moments(F.col(e).cast("double")).alias("s"))
    parts = parts.select(*keys, F.col("s")[0].cast("long").alias("n"), F.col("s")[1].alias("mean"), F.col("s")[2].alias("m2"), F.lit(None).cast("double").alias("max"))
    merged = merge_states(parts, keys).select(*keys, state_variance(ddof).alias("var_of_E"), state_variance(ddof).alias("var_of_E2"))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    built_in = df.groupBy(*keys).agg(F.avg(c).alias("mean_of_C"), F.max(d).alias("max_of_D"))
    return built_in.alias("a").join(merged.alias("b"), on).select("a.*", "b.var_of_E", "b.var_of_E2")


def running_stats(df: DataFrame, keys: Sequence[str], at: str, ties: Sequence[str], c: str, d: str, e: str) -> DataFrame:
    """df with the statistics of each key's rows so far, in the order of (at, ties), `at` being a number.

    Rows are worked on in spans, as in running_sums. Beyond a key's first span the variance comes from sums around its mean of e.
    """
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
    middle = df.groupBy(*keys).agg(F.avg(e).alias("__middle"))
    rows = df.alias("r").join(middle.alias("m"), on).select("r.*", "__middle")
    x = F.col(e) - F.col("__middle")
    one = lambda v: F.when(F.col(v).isNotNull(), 1).otherwise(0)
    sums = {"__nc": one(c), "__c": F.col(c), "__n": one(e), "__x": x, "__xx": x * x}
    out = running_sums(rows, keys, at, ties, sums, {"max_of_D": F.col(d)}, own={"__seen": F.count(e), "__var": F.var_pop(e)})
    mean = F.try_divide(F.col("__x"), F.col("__n"))
    var = F.greatest(F.lit(0.0), F.try_divide(F.col("__xx"), F.col("__n")) - mean * mean)
    return out.withColumns({"mean_of_C": F.try_divide(F.col("__c"), F.col("__nc")), "var_of_E": F.when(F.col("__n") == F.col("__seen"), F.col("__var")).otherwise(var)}).drop("__middle", "__seen", "__var", *sums)


def conditional_join(df: DataFrame, keys: Sequence[str], predicate: Column, c: str, d: str, e: str) -> DataFrame:
    """Two aggregates, joined; groups without a matching row stay, with null."""
    every = df.groupBy(*keys).agg(F.avg(c).alias("mean_of_C"), F.max(d).alias("max_of_D"))
    some = df.where(predicate).groupBy(*keys).agg(F.var_pop(e).alias("cond_var_of_E"), hand_variance(F.col(e)).alias("cond_var_of_E2"))
    return every.join(some, list(keys), "left")


def conditional_zero(df: DataFrame, keys: Sequence[str], predicate: Column, c: str, d: str, e: str) -> DataFrame:
    """Sums in which other rows count as 0."""
    here = predicate & F.col(e).isNotNull()
    x = F.when(here, F.col(e)).otherwise(F.lit(0.0))
    n, s, q = F.sum(F.when(here, 1).otherwise(0)), F.sum(x), F.sum(x * x)
    var = F.try_divide(q, n) - F.pow(F.try_divide(s, n), 2)
    return df.groupBy(*keys).agg(F.avg(c).alias("mean_of_C"), F.max(d).alias("max_of_D"), var.alias("cond_var_of_E"), var.alias("cond_var_of_E2"))


def conditional_nested(df: DataFrame, keys: Sequence[str], predicate: Column, c: str, d: str, e: str) -> DataFrame:
    """Grouped by the predicate's value too, then grouped again."""
    low = df.groupBy(*keys, F.coalesce(predicate, F.lit(False)).alias("__holds")).agg(
        F.sum(c).alias("sc"), F.count(c).alias("nc"), F.max(d).alias("d"), F.var_pop(e).alias("v"), hand_variance(F.col(e)).alias("v2")
    )
    held = lambda x: F.max(F.when(F.col("__holds"), F.col(x)))
    return low.groupBy(*keys).agg(F.try_divide(F.sum("sc"), F.sum("nc")).alias("mean_of_C"), F.max("d").alias("max_of_D"), held("v").alias("cond_var_of_E"), held("v2").alias("cond_var_of_E2"))


def conditional_window(df: DataFrame, keys: Sequence[str], predicate: Column, c: str, d: str, e: str) -> DataFrame:
    """A window over each part of a group, one row of each, then their states merged. It carries every row through a sort: prefer the canonical form."""
    rows = in_parts(df.select(*keys, F.col(c).alias("__c"), F.col(d).alias("__d"), F.when(predicate, F.col(e)).cast("double").alias("__e")))
    w = Window.partitionBy(*keys, "__part")
    own = {"nc": F.count("__c"), "c": F.avg("__c"), "d": F.max("__d"), "ne": F.count("__e"), "e": F.avg("__e"), "v": F.var_pop("__e")}
    low = rows.select(*keys, "__part", *[f.over(w).alias(f"__{n}") for n, f in own.items()]).groupBy(*keys, "__part").agg(*[F.max(f"__{n}").alias(f"__{n}") for n in own])
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    state = lambda v, n, mean, m2, top: F.struct(F.lit(v).alias("value"), n.alias("n"), F.coalesce(mean, zero).alias("mean"), F.coalesce(m2, zero).alias("m2"), top.cast("double").alias("max"))
    each = F.array(
        state("C", F.col("__nc"), F.col("__c"), zero, none), state("D", F.lit(0).cast("long"), zero, zero, F.col("__d")), state("E", F.col("__ne"), F.col("__e"), F.col("__v") * F.col("__ne"), none)
    )
    states = low.select(*keys, F.explode(each).alias("__s")).select(*keys, "__s.*")
    return _of_states(states, keys, "C", "D", "E").withColumnsRenamed({"var_of_E": "cond_var_of_E", "var_of_E2": "cond_var_of_E2"})


def conditional_map(df: DataFrame, keys: Sequence[str], predicate: Column, c: str, d: str, e: str) -> DataFrame:
    """Groups of pandas rows in parts, the condition applied before."""
    some = df.withColumn("__cond", F.when(predicate, F.col(e)))
    out = grouped_map(some, keys, c, d, "__cond")
    return out.withColumnsRenamed({"var_of_E": "cond_var_of_E", "var_of_E2": "cond_var_of_E2"})


def bilevel_join(df: DataFrame, outer: Sequence[str], inner: Sequence[str], c: str, d: str, e: str) -> DataFrame:
    """Each level aggregated by itself, then joined."""
    high = df.groupBy(*outer).agg(F.avg(c).alias("mean_of_C"), F.max(d).alias("max_of_D"))
    low = df.groupBy(*outer, *inner).agg(F.var_pop(e).alias("v"), hand_variance(F.col(e)).alias("v2"))
    return high.join(low.groupBy(*outer).agg(F.avg("v").alias("avg_var_of_E"), F.avg("v2").alias("avg_var_of_E2")), list(outer), "left")


def bilevel_window(df: DataFrame, outer: Sequence[str], inner: Sequence[str], c: str, d: str, e: str) -> DataFrame:
    """Inner variances by a window over the whole inner group, one row of each then taken."""
    v = F.var_pop(e).over(Window.partitionBy(*outer, *inner))
    low = df.select(*outer, *inner, F.col(c).alias("c"), F.col(d).alias("d"), v.alias("v"))
    low = low.groupBy(*outer, *inner).agg(F.sum("c").alias("sc"), F.count("c").alias("nc"), F.max("d").alias("d"), F.max("v").alias("v"))
    return low.groupBy(*outer).agg(F.try_divide(F.sum("sc"), F.sum("nc")).alias("mean_of_C"), F.max("d").alias("max_of_D"), F.avg("v").alias("avg_var_of_E"), F.avg("v").alias("avg_var_of_E2"))


def bilevel_map(df: DataFrame, outer: Sequence[str], inner: Sequence[str], c: str, d: str, e: str) -> DataFrame:
    """Inner variances from pandas groups in parts."""
    low = grouped_map(df, [*outer, *inner], c, d, e).groupBy(*outer).agg(F.max("max_of_D").alias("max_of_D"), F.avg("var_of_E").alias("avg_var_of_E"), F.avg("var_of_E2").alias("avg_var_of_E2"))
    return df.groupBy(*outer).agg(F.avg(c).alias("mean_of_C")).join(low, list(outer))


def bilevel_sql(df: DataFrame, outer: Sequence[str], inner: Sequence[str], c: str, d: str, e: str) -> DataFrame:
    """Nested SQL over a view."""
    o, i = ", ".join(outer), ", ".join([*outer, *inner])
    low = f"SELECT {i}, sum({c}) AS sc, count({c}) AS nc, max({d}) AS d, var_pop({e}) AS v FROM {{t}} GROUP BY {i}"
    query = f"SELECT {o}, sum(sc) / nullif(sum(nc), 0) AS mean_of_C, max(d) AS max_of_D, avg(v) AS avg_var_of_E, avg(v) AS avg_var_of_E2 FROM ({low}) GROUP BY {o}"
    return df.sparkSession.sql(query, t=df)
