"""Strict comparison of results."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd


def differences(found: pd.DataFrame, wanted: pd.DataFrame, keys: Sequence[str], tolerance: float = 1e-9, most: int = 10) -> list[str]:
    """What is wrong with found, at most so many lines; none if it is right.

    Columns, row keys and their counts must be the same, nulls in the same places; numbers may differ by the tolerance,
    absolutely or relative to the wanted one. NaN is equal to NaN only.
    """
    if sorted(found.columns) != sorted(wanted.columns):
        return [f"columns {sorted(found.columns)}, wanted {sorted(wanted.columns)}"]
    a, b = (df.sort_values(list(keys), kind="stable").reset_index(drop=True) for df in (found, wanted))
    if len(a) != len(b):
        return [f"{len(a)} rows, wanted {len(b)}"]
    out = []
    for c in [*keys, *[c for c in wanted.columns if c not in keys]]:
        for i, (x, y) in enumerate(zip(a[c].astype(object), b[c].astype(object), strict=True)):
            if not same(x, y, tolerance):
                out.append(f"row {i}, {c}: {x!r}, wanted {y!r}")
                if len(out) >= most:
                    return out
    return out


def same(x: object, y: object, tolerance: float) -> bool:
    x, y = (None if v is pd.NA or v is pd.NaT else v for v in (x, y))
    if x is None or y is None:
        return x is y
    if isinstance(x, float) or isinstance(y, float):
        if math.isnan(x) or math.isnan(y):
            return math.isnan(x) and math.isnan(y)
        return x == y or abs(x - y) <= tolerance * max(1.0, abs(y))
    return x == y
