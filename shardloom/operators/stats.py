"""Grouped statistics: plain, under a condition, and over two levels. The canonical forms: one scan, one shuffle a level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import as_column, power_variance

Measure = str | Column


def variance(c: Column, ddof: int) -> Column:
    return {0: F.var_pop, 1: F.var_samp}[ddof](c)


def hand_variance(c: Column, ddof: int = 0) -> Column:
    """The same from count, sum and sum of squares; loses digits when the mean is far from 0."""
    return power_variance(F.count(c), F.sum(c), F.sum(c * c), ddof)


def grouped_stats(df: DataFrame, keys: Sequence[str], mean: Measure, maximum: Measure, var: Measure, *, ddof: int = 0, names: Sequence[str] = ("mean_of_C", "max_of_D", "var_of_E", "var_of_E2")) -> DataFrame:
    """keys, mean, maximum, variance, and the variance from powers.

    Nulls are skipped; a group of nulls gives null. NaN counts as the greatest value and spoils means and variances.
    ddof 1 gives sample variances, null for one row. Partial aggregates are made before the one shuffle.
    """
    v = as_column(var)
    a, b, c, d = names
    return df.groupBy(*keys).agg(F.avg(as_column(mean)).alias(a), F.max(as_column(maximum)).alias(b), variance(v, ddof).alias(c), hand_variance(v, ddof).alias(d))


def conditional_stats(
    df: DataFrame, keys: Sequence[str], predicate: Column, mean: Measure, maximum: Measure, var: Measure, *, ddof: int = 0, names: Sequence[str] = ("mean_of_C", "max_of_D", "cond_var_of_E", "cond_var_of_E2")
) -> DataFrame:
    """As grouped_stats, the variances being over the rows for which the predicate holds; none such gives null, not a lost group."""
    return grouped_stats(df, keys, mean, maximum, F.when(predicate, as_column(var)), ddof=ddof, names=names)


def bilevel_stats(
    df: DataFrame, outer: Sequence[str], inner: Sequence[str], mean: Measure, maximum: Measure, var: Measure, *, ddof: int = 0, names: Sequence[str] = ("mean_of_C", "max_of_D", "avg_var_of_E", "avg_var_of_E2")
) -> DataFrame:
    """By outer keys: mean over rows, maximum, and the mean over inner groups of their variances.

    The mean is weighted by rows, not by inner groups. Inner groups without a variance don't count.
    """
    v, a = as_column(var), as_column(mean)
    low = df.groupBy(*outer, *inner).agg(F.sum(a).alias("__sum"), F.count(a).alias("__n"), F.max(as_column(maximum)).alias("__max"), variance(v, ddof).alias("__var"), hand_variance(v, ddof).alias("__var2"))
    return low.groupBy(*outer).agg(F.try_divide(F.sum("__sum"), F.sum("__n")).alias(names[0]), F.max("__max").alias(names[1]), F.avg("__var").alias(names[2]), F.avg("__var2").alias(names[3]))
