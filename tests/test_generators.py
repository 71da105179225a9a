import math

import pytest
from pyspark.sql import functions as F

from shardloom.operators.dedupe import deduplicated, label_check, matches, with_blocks, with_components
from shardloom.operators.ordered import sorted_locally
from shardloom.operators.sections import student_summaries, summaries_by_state_machine
from shardloom.operators.stats import bilevel_stats, grouped_stats
from shardloom.plans.verify import differences
from shardloom.sources import generators, readers
from shardloom.sources.schemas import PEOPLE, SIX_FIELDS


def test_facts_do_not_depend_on_partitions(spark):
    df = generators.six_fields(spark, 500)
    assert [f.name for f in df.schema] == [f.name for f in SIX_FIELDS] and [f.dataType for f in df.schema] == [f.dataType for f in SIX_FIELDS]
    again = generators.six_fields(spark, 500).repartition(7)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, again.collect()))
    assert grouped_stats(df, ["grp"], "C", "D", "E").count() == 3 and bilevel_stats(df, ["grp"], ["subgrp"], "C", "D", "E").count() == 3
    assert df.where("E < 0").count() > 100 and generators.six_fields(spark, 0).count() == 0


def test_students(spark, tmp_path):
    lines = generators.student_lines(spark, 30, trimesters=3, classes=2)
    found = readers.to_frame(student_summaries(lines), 100)
    assert len(found) == 30 and (found["SourceLines"] == 1 + 3 * 4).all()
    readers.write_answers(str(tmp_path / "answers"), "students", found)
    wanted = readers.read_answers(str(tmp_path / "answers"), "students")
    assert differences(readers.to_frame(summaries_by_state_machine(lines), 100), wanted, ["StudentId"]) == []
    with pytest.raises(ValueError):
        readers.to_frame(lines, 5)


def test_people_are_found_again(spark):
    df = generators.people(spark, 60)
    assert {f.name for f in PEOPLE} <= set(df.columns) and df.count() == 60 + 1 + 60
    out = deduplicated(df).collect()
    assert len(out) == 60
    connected = with_components(with_blocks(df), matches(with_blocks(df), ("block_zip", "block_first", "block_last"), ("FirstName", "LastName"), source="SourceId"))
    assert label_check(connected).count() == 0
    wrong = connected.withColumn("component", F.when(F.col("SecretKey") <= 2, F.lit(0)).when((F.col("SecretKey") == 3) & (F.col("SourceId") == 0), F.lit(-1)).otherwise(F.col("component")))
    assert sorted((r["kind"], r["parts"]) for r in label_check(wrong).collect()) == [("mixed", 2), ("split", 2)]


def test_local_order(spark):
    df = spark.createDataFrame([(i % 5, -i) for i in range(100)], "k int, x int").repartition(6)
    parts = sorted_locally(df, ["k"], ["x"]).withColumn("p", F.spark_partition_id()).collect()
    seen = {}
    for r in parts:
        assert seen.get((r["p"], r["k"]), -math.inf) <= r["x"]
        seen[r["p"], r["k"]] = r["x"]
    assert len(seen) == 5
