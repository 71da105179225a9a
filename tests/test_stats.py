import math
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shardloom.operators import stats, variants
from shardloom.operators.progressive import State, merge_states, partial_states, state_variance
from shardloom.plans.verify import differences
from shardloom.sources.schemas import SIX_FIELDS

from .fixtures import six_fields

KEYS = ["grp", "subgrp"]


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame(six_fields(), SIX_FIELDS).repartition(5).cache()


def brute(rows, keep=lambda e: True):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1], r[2]].append(r)
    out = {}
    for k, g in groups.items():
        col = lambda i: [r[i] for r in g if r[i] is not None]  # noqa: B023, E731
        e = [x for x in col(7) if keep(x)]
        out[k] = (np.mean(col(5)) if col(5) else None, max(col(6), default=None), float(np.var(e)) if e else None)
    return out


def check(df, wanted, var):
    found = {(r["grp"], r["subgrp"]): (r["mean_of_C"], r["max_of_D"], r[var]) for r in df.collect()}
    assert found.keys() == wanted.keys()
    for k, w in wanted.items():
        for x, y in zip(found[k], w, strict=True):
            assert (x is None) == (y is None), (k, found[k], w)
            assert x is None or math.isclose(x, y, rel_tol=1e-8, abs_tol=1e-8), (k, found[k], w)


@pytest.mark.parametrize("form", [stats.grouped_stats, variants.grouped_sql, variants.grouped_partials, variants.grouped_map, variants.grouped_udaf])
@pytest.mark.parametrize("var", ["var_of_E", "var_of_E2"])
def test_grouped(facts, form, var):
    check(form(facts, KEYS, "C", "D", "E"), brute(six_fields()), var)


def canonical(df, keys, p, c, d, e):
    return stats.conditional_stats(df, keys, p, c, d, e)


@pytest.mark.parametrize("form", [canonical, variants.conditional_join, variants.conditional_zero, variants.conditional_nested, variants.conditional_window, variants.conditional_map])
def test_conditional(facts, form):
    check(form(facts, KEYS, F.col("E") < 0, "C", "D", "E"), brute(six_fields(), lambda e: e < 0), "cond_var_of_E")


@pytest.mark.parametrize("form", [stats.bilevel_stats, variants.bilevel_sql, variants.bilevel_join, variants.bilevel_window, variants.bilevel_map])
def test_bilevel(facts, form):
    rows, inner = six_fields(), brute(six_fields())
    found = {r["grp"]: r for r in form(facts, ["grp"], ["subgrp"], "C", "D", "E").collect()}
    assert found.keys() == {r[1] for r in rows}
    for g, r in found.items():
        c, d = ([x[i] for x in rows if x[1] == g and x[i] is not None] for i in (5, 6))
        v = [x[2] for k, x in inner.items() if k[0] == g and x[2] is not None]
        for x, y in ((r["mean_of_C"], np.mean(c) if c else None), (r["max_of_D"], max(d, default=None)), (r["avg_var_of_E"], np.mean(v) if v else None)):
            assert (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-8, abs_tol=1e-8))


def test_sample_variance_of_one_row_is_null(facts):
    one = stats.grouped_stats(facts.where("grp = 8"), KEYS, "C", "D", "E", ddof=1).first()
    assert one["var_of_E"] is None and one["var_of_E2"] is None


def test_empty_and_nan(spark, facts):
    assert stats.grouped_stats(facts.limit(0), KEYS, "C", "D", "E").count() == 0
    nan = spark.createDataFrame([(1, 2.0), (1, float("nan"))], "k int, x double")
    assert math.isnan(stats.grouped_stats(nan, ["k"], "x", "x", "x").first()["max_of_D"])


def test_plan_has_one_scan_and_one_shuffle(spark, tmp_path):
    spark.createDataFrame(six_fields(), SIX_FIELDS).write.parquet(str(tmp_path / "f"))
    df = stats.conditional_stats(spark.read.parquet(str(tmp_path / "f")), KEYS, F.col("E") < 0, "C", "D", "E")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    assert "ReadSchema: struct<grp:int,subgrp:int,C:double,D:double,E:double>" in plan


def test_known_vectors():
    s = State().update([2, 8, 7, 4, 5])
    assert math.isclose(s.mean, 5.2) and math.isclose(s.variance(1), 5.7) and math.isclose(s.variance(), 4.56)
    s = s.update([-3, 5, 2, 6])
    assert math.isclose(s.mean, 4.0) and math.isclose(s.variance(1), 11.0) and math.isclose(s.variance(), 88 / 9)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), max_size=40), st.integers(1, 45))
def test_batches_of_any_size_agree(values, size):
    whole, parts = State().update(values), State()
    for i in range(0, len(values), size):
        parts = parts.merge(State().update(values[i : i + size]))
    assert whole.n == parts.n and whole.maximum == parts.maximum
    assert math.isclose(whole.mean, parts.mean, rel_tol=1e-9, abs_tol=1e-6)
    assert math.isclose(whole.m2, parts.m2, rel_tol=1e-9, abs_tol=1e-3)


def test_states_merge_far_from_zero(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.lit(1e9) + F.col("id")).alias("x")).repartition(7)
    merged = merge_states(partial_states(df, ["k"], "x"), ["k"]).select("k", "n", state_variance().alias("v")).collect()
    for r in merged:
        x = np.arange(r["k"], 1000, 3)
        assert r["n"] == len(x) and math.isclose(r["v"], np.var(x), rel_tol=1e-9)


def test_states_of_several_columns_and_null_keys(spark):
    rows = [(None if i % 4 == 0 else i % 3, float(i), None if i % 5 else 2.0 * i, None) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, x double, y double, z double").repartition(5)
    states = partial_states(df, ["k"], "x", "y", "z")
    merged = {(r["k"], r["value"]): r for r in merge_states(states, ["k", "value"]).collect()}
    for k in (None, 0, 1, 2):
        for at, c in ((1, "x"), (2, "y"), (3, "z")):
            own = [r[at] for r in rows if r[0] == k and r[at] is not None]
            got = merged[k, c]
            assert got["n"] == len(own) and got["max"] == (max(own) if own else None)
            assert math.isclose(got["m2"], len(own) * np.var(own) if own else 0.0, rel_tol=1e-9, abs_tol=1e-9)


def test_running_stats_of_spans(spark, monkeypatch):
    rows = [(i % 2, i // 3, i, None if i % 7 == 0 else 1e6 + (i * 37 % 11), float(i * 13 % 17)) for i in range(120)]
    df = spark.createDataFrame(rows, "k int, at long, tie long, x double, y double").repartition(4)
    monkeypatch.setattr(variants.running_sums, "__defaults__", (None, 7, None))
    out = {r["tie"]: r for r in variants.running_stats(df, ["k"], "at", ["tie"], "x", "y", "x").collect()}
    for k in (0, 1):
        own = []
        top = -1.0
        for _, _, tie, x, y in sorted(r for r in rows if r[0] == k):
            own += [x] if x is not None else []
            top = max(top, y)
            r = out[tie]
            assert r["max_of_D"] == top and (r["mean_of_C"] is None) == (not own)
            assert not own or (math.isclose(r["mean_of_C"], np.mean(own), rel_tol=1e-12) and math.isclose(r["var_of_E"], np.var(own), rel_tol=1e-6, abs_tol=1e-6))


def test_strict_comparison():
    import pandas as pd

    right = pd.DataFrame({"k": [1, 2], "x": [1.0, None]})
    assert differences(right.copy(), right, ["k"]) == []
    for wrong in (right.iloc[:1], right.rename(columns={"x": "y"}), right.assign(x=[1.0, 2.0]), right.assign(x=[1.1, None]), right.iloc[:0]):
        assert differences(wrong, right, ["k"])


def test_windows_are_over_parts(facts, monkeypatch):
    """A group's rows are in several windows of a bounded number of rows, with the same result."""
    monkeypatch.setattr(variants, "PART_ROWS", 7)
    found = variants.conditional_window(facts, KEYS, F.col("E") < 0, "C", "D", "E")
    check(found, brute(six_fields(), lambda e: e < 0), "cond_var_of_E")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Window \[.*windowspecdefinition\(grp#\d+, subgrp#\d+, __part#", plan)
