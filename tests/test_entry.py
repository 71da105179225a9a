import glob
import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from shardloom.plans.queries import QUERIES, SQL
from shardloom.plans.registry import Formulation, Registry, itinerary, log_run, summarize_runs
from shardloom.plans.verify import differences

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents conversations"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)
    got = duck.execute(SQL[name])
    wanted = pd.DataFrame(got.fetchall(), columns=[c[0] for c in got.description], dtype=object)
    keys = [c for c in wanted.columns if not wanted[c].isna().any() and not isinstance(wanted[c].iloc[0], float)]
    assert differences(found, wanted, keys, 1e-6) == []


def test_entry(spark):
    if os.path.isdir(SF):
        assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_llm_is_not_needed():
    """Nothing outside imports it."""
    root = os.path.dirname(entry.__file__)
    for f in glob.glob(f"{root}/shardloom/**/*.py", recursive=True):
        if "/llm/" not in f:
            assert "llm" not in open(f).read(), f


def test_registry(spark, tmp_path):
    r = Registry()
    a = r.add(Formulation("q", "a", lambda: None, most_rows=10))
    with pytest.raises(ValueError):
        r.add(a)
    assert r.questions() == ["q"] and a.infeasible(11) and not a.infeasible(10)
    assert itinerary(r.of("q"), [1, 2], 3, seed=1) == itinerary(r.of("q"), [1, 2], 3, seed=1)
    for seconds in (1.0, 3.0):
        log_run(str(tmp_path / "log.csv"), "q", "a", 1, seconds)
    row = summarize_runs(spark, str(tmp_path / "log.csv")).first()
    assert row["runs"] == 2 and row["mean"] == 2.0 and row["low"] < 2 < row["high"]
