"""Column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def name_similarity(a: str | Column, b: str | Column) -> Column:
    """1 - edits / length of the longer, from 0 to 1; two empty names are alike, null with anything is null."""
    a, b = as_column(a), as_column(b)
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def could_be_similar(a: str | Column, b: str | Column, threshold: float) -> Column:
    """False only if lengths alone rule out that name_similarity reaches the threshold."""
    a, b = F.length(as_column(a)), F.length(as_column(b))
    return F.abs(a - b) <= F.lit(1 - threshold + 1e-9) * F.greatest(a, b)


@F.pandas_udf(DoubleType())
def sequence_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The matching-blocks ratio of two strings (2 * matched / total), another measure than name_similarity; in batches."""
    from difflib import SequenceMatcher

    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def power_variance(n: Column, total: Column, squares: Column, ddof: int = 0) -> Column:
    """Variance from a count, a sum and a sum of squares; null where there are too few rows."""
    spread = squares - F.try_divide(total * total, n)
    return F.try_divide(spread, n - F.lit(ddof))


def first_not_null(*columns: str | Column) -> Column:
    return F.coalesce(*map(as_column, columns))


def summed(a: str | Column, b: str | Column) -> Column:
    """Element-wise sum of two arrays; the shorter counts as 0 beyond its end."""
    return F.zip_with(as_column(a), as_column(b), lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def parts_score(*weighted: tuple[str | Column, int]) -> Column:
    """The sum of the weights of the columns that are neither null nor empty."""
    return sum((F.when(F.length(as_column(c)) > 0, F.lit(w)).otherwise(F.lit(0)) for c, w in weighted), F.lit(0))
