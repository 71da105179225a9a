import math
import random

import pytest
from pyspark.sql import functions as F

from shardloom.operators import sections
from shardloom.operators.ordered import ordered_aggregate, running_sum, zip_with_index
from shardloom.operators.sections import joined, section_ids, snippet_of, sparse_lines, student_summaries, summaries_by_snippets, summaries_by_state_machine
from shardloom.sources.readers import read_lines

from .fixtures import section_oracle, section_text


def agrees(df, lines):
    wanted = section_oracle(lines)
    rows = df.collect()
    assert len(rows) == len(wanted)
    for r in rows:
        for x, y in zip((r["StudentName"], r["SourceLines"], r["GPA"], r["Major"], r["MajorGPA"]), wanted[r["StudentId"]], strict=True):
            assert (x is None) == (y is None) and (x == y or math.isclose(x, y, rel_tol=1e-12)), (r, wanted[r["StudentId"]])


def written(tmp_path, lines, files):
    step = -(-len(lines) // files)
    for i in range(files):
        (tmp_path / f"part-{i:03d}.txt").write_text("".join(x + "\n" for x in lines[i * step : (i + 1) * step]))
    return str(tmp_path)


ODD = ["C,1,2,3", "TF,1,2.0,3", "S,100,Nobody", "S,101,Unfinished", "TH,2010-01-01,False", "C,1,3,4", "S,102,Half", "TH,2010-01-01,True", "C,2,3,4", "TF,2,3.0,3", "TH,2011-01-01,False", "C,2,3,1"]


@pytest.mark.parametrize("form", [student_summaries, summaries_by_state_machine, summaries_by_snippets])
@pytest.mark.parametrize("files", [1, 7])
def test_summaries(spark, tmp_path, form, files):
    lines = ODD + section_text()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        agrees(form(read_lines(spark, written(tmp_path, lines, files))), lines)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_section_ids_over_blocks(spark, tmp_path):
    lines = section_text(30)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        rows = section_ids(read_lines(spark, written(tmp_path, lines, 3)), F.col("value").startswith("S,")).orderBy("file", "block", "at").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    n, wanted = 0, []
    for x in lines:
        n += x.startswith("S,")
        wanted.append(n)
    assert [r["value"] for r in rows] == lines and [r["section"] for r in rows] == wanted


def parsed(lines):
    for x in lines:
        f = x.split(",")
        yield {"S": lambda f=f: {"Type": "S", "StudentId": int(f[1]), "StudentName": f[2]}, "TH": lambda: {"Type": "TH"}, "C": lambda f=f: {"Type": "C", "Dept": int(f[1]), "ClassCredits": int(f[2]), "ClassGrade": int(f[3])}, "TF": lambda f=f: {"Type": "TF", "Major": int(f[1])}}[f[0]]()


def test_snippets_split_anywhere():
    lines = section_text(1, seed=5, uneven=False)
    assert len(lines) == 49
    wanted = section_oracle(lines)[1]
    for cut in range(len(lines) + 1):
        two = joined([snippet_of(parsed(lines[:cut])), snippet_of(parsed(lines[cut:]))])
        assert two.done[0].summary()[1:] == wanted, cut


def test_snippets_are_associative():
    lines, r = ODD + section_text(5, seed=6), random.Random(7)
    wanted = [(s, *v) for s, v in section_oracle(lines).items()]
    for _ in range(50):
        cuts = sorted(r.sample(range(len(lines)), 5))
        parts = [lambda a=a, b=b: snippet_of(parsed(lines[a:b])) for a, b in zip([0, *cuts], [*cuts, len(lines)], strict=True)]
        left = joined([p() for p in parts])
        right = joined([joined([parts[0](), parts[1]()]), joined([parts[2](), joined([parts[3](), joined([parts[4](), parts[5]()])])])])
        for found in (left, right):
            assert [s.summary() for s in found.done] == wanted


def test_broken_lines_are_null(spark):
    df = spark.createDataFrame([("C,x,1,2",), ("",), (None,), ("TH,2010-01-01,False  ",)], "value string")
    rows = sparse_lines(df).collect()
    assert rows[0]["Dept"] is None and rows[0]["ClassCredits"] == 1 and rows[2]["Type"] is None and rows[3]["WasAbroad"] is False


def test_running_sum(spark):
    r = random.Random(3)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), r.randint(0, 50), i, r.choice([1, 2, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, at long, tie long, v long")
    found = {x["tie"]: x["s"] for x in running_sum(df, ["k"], "at", ["tie"], F.col("v"), "s", span_rows=10).collect()}
    sums = {}
    for k, _, tie, v in sorted(rows, key=lambda x: (x[1], x[2])):
        sums[k] = sums.get(k, 0) + (v or 0)
        assert found[tie] == sums[k]
    assert len(found) == 400


def test_zip_with_index(spark):
    df = spark.range(997).select(F.hash("id").alias("h"), "id").repartition(6)
    rows = sorted((x["h"], x["rowId"]) for x in zip_with_index(df, ["h"]).collect())
    assert [n for _, n in rows] == list(range(1, 998))
    assert zip_with_index(df.limit(0), ["h"]).count() == 0


def test_ordered_aggregate_keeps_order(spark):
    df = spark.range(500).select(F.hash("id").alias("h"), F.col("id").cast("string").alias("v")).repartition(9)
    fold = lambda frames: ",".join(v for f in frames for v in f["v"]).encode()
    out = ordered_aggregate(df, ["h"], fold, lambda parts: b",".join(parts), fan_in=2).collect()
    assert len(out) == 1 and out[0]["state"].decode().split(",") == [x["v"] for x in df.orderBy("h").collect()]
    assert ordered_aggregate(df.limit(0), ["h"], fold, lambda parts: b",".join(parts)).count() == 0


def test_header_ranges(spark):
    from shardloom.operators.sections import header_ranges

    places = [7 * i % 101 for i in range(101)] + [5]
    df = spark.createDataFrame([(p,) for p in places], "at long").repartition(6)
    wanted = sorted(zip(sorted(places), [*sorted(places)[1:], None]), key=str)
    assert sorted(((r["at"], r["next"]) for r in header_ranges(df, "at").collect()), key=str) == wanted
    assert header_ranges(df.limit(0), "at").count() == 0


@pytest.mark.parametrize("form", [student_summaries, summaries_by_state_machine])
def test_tasks_follow_the_lines(spark, tmp_path, form, monkeypatch):
    """More lines are more tasks, not larger ones; and Python isn't started for each section."""
    monkeypatch.setattr(sections, "TASK_LINES", 50)
    lines = ODD + section_text()
    out = form(read_lines(spark, written(tmp_path, lines, 3)))
    agrees(out, lines)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(section#" in plan and f", {1 + len(lines) // 50})" in plan and "FlatMapGroupsInPandas" not in plan
