import math

from pyspark.sql import functions as F

from shardloom.operators.stats import grouped_stats
from shardloom.sources.readers import partition_histogram, read_csv, read_parquet, register, tagged_union, write_parquet
from shardloom.sources.schemas import PEOPLE, SIX_FIELDS
from shardloom.streaming.stats import parquet_stream, run_available, stream_stats, windowed_stats

from .fixtures import people, six_fields


def test_stream_equals_batch(spark, tmp_path):
    facts = spark.createDataFrame(six_fields(), SIX_FIELDS)
    facts.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = parquet_stream(spark, str(tmp_path / "in"), SIX_FIELDS, files_per_batch=1)
    query = run_available(stream_stats(stream, ["grp", "subgrp"], "C", "D", "E"), "streamed", str(tmp_path / "cp"))
    assert len(query.recentProgress) >= 6
    wanted = {(r["grp"], r["subgrp"]): r for r in grouped_stats(facts, ["grp", "subgrp"], "C", "D", "E").collect()}
    found = spark.table("streamed").collect()
    assert len(found) == len(wanted)
    for r in found:
        for c in ("mean_of_C", "max_of_D", "var_of_E"):
            x, y = r[c], wanted[r["grp"], r["subgrp"]][c]
            assert (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-9))


def test_windows_of_event_time(spark, tmp_path):
    rows = spark.range(100).select((F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("ts"), (F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("x"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = parquet_stream(spark, str(tmp_path / "in"), rows.schema)
    run_available(windowed_stats(stream, "ts", "10 minutes", "1 minute", ["k"], "x"), "windowed", str(tmp_path / "cp"), "complete")
    found = spark.table("windowed").collect()
    assert len(found) == 20 and sum(r["n"] for r in found) == 100


def test_sources_and_sinks(spark, tmp_path):
    pdf = people(5, "AB")
    for s, part in pdf.groupby("SourceId"):
        part[PEOPLE.names].to_csv(tmp_path / f"{s}.csv", header=False, index=False)
    both = tagged_union((s, read_csv(spark, str(tmp_path / f"{s}.csv"), PEOPLE)) for s in (0, 1))
    assert both.count() == len(pdf) and both.where("FieldB is null").count() == 5
    write_parquet(both, str(tmp_path / "out"))
    write_parquet(both, str(tmp_path / "out"), mode="append")
    again = register(read_parquet(spark, str(tmp_path / "out"), both.schema), "people_again")
    assert spark.sql("select count(*) n from people_again").first()["n"] == 2 * len(pdf)
    assert partition_histogram(again).agg(F.sum("rows")).first()[0] == 2 * len(pdf)
