"""Seeded inputs of any size, made where they are needed: facts of six fields, lines of students, records of people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The factor of each source's own field of a person (fixed values).
FACTORS = {"A": 2, "B": 3, "C": 5, "D": 7, "E": 11, "F": 13}


def _uniform(seed: int, *of: str | Column) -> Column:
    """0 up to 1 from a hash, so that a row is the same however the table is partitioned."""
    return F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 40)) / F.lit(float(1 << 40))


def six_fields(spark: SparkSession, rows: int, groups: int = 3, subgroups: int = 3, seed: int = 1) -> DataFrame:
    """id, grp, subgrp, A to F, as schemas.SIX_FIELDS: keys and measures by hash; E and F lie on both sides of 0."""
    of = lambda k, n: F.floor(_uniform(seed + k, "id") * n).cast("int")
    spread = lambda k: _uniform(seed + k, "id") * 20 - 10
    return spark.range(rows).select(
        F.col("id").cast("int").alias("id"), of(1, groups).alias("grp"), of(2, subgroups).alias("subgrp"), (of(3, 9) + 1).alias("A"), (of(4, 9) + 1).alias("B"),
        (_uniform(seed + 5, "id") * 9 + 1).alias("C"), (_uniform(seed + 6, "id") * 9 + 1).alias("D"), spread(7).alias("E"), spread(8).alias("F"),
    )


def student_lines(spark: SparkSession, students: int, trimesters: int = 8, classes: int = 4, seed: int = 2) -> DataFrame:
    """value, file, block, at: the lines of students in order, each with so many trimesters of so many classes."""
    per_term, per = classes + 2, 1 + trimesters * (classes + 2)
    line = spark.range(students * per).select(F.expr(f"id div {per}").alias("s"), F.expr(f"id % {per} - 1").alias("k"), F.col("id"))
    line = line.withColumns({"t": F.expr(f"k div {per_term}"), "c": F.expr(f"k % {per_term}")})
    of = lambda k, n: F.floor(_uniform(seed + k, "id") * n).cast("string")
    number = (F.col("s") + 1).cast("string")
    date = F.date_format(F.add_months(F.lit("2010-01-31").cast("date"), (F.col("t") * 4).cast("int")), "yyyy-MM-dd")
    text = (
        F.when(F.col("k") < 0, F.concat_ws(",", F.lit("S"), number, F.concat(F.lit("John"), number)))
        .when(F.col("c") == 0, F.concat_ws(",", F.lit("TH"), date, F.when(_uniform(seed, "id") < 0.1, "True").otherwise("False")))
        .when(F.col("c") <= classes, F.concat_ws(",", F.lit("C"), of(1, 4), (of(2, 5).cast("int") + 1).cast("string"), of(3, 5)))
        .otherwise(F.concat_ws(",", F.lit("TF"), of(4, 4), F.format_number(_uniform(seed + 5, "id") * 3 + 1, 3), of(6, 15)))
    )
    return line.select(text.alias("value"), F.lit("generated").alias("file"), F.expr("s div 1000").alias("block"), F.col("id").alias("at"))


def people(spark: SparkSession, count: int, sources: str = "ABC") -> DataFrame:
    """Records as schemas.PEOPLE, SourceId and id: each source has each person once, under names that differ by a letter.

    Source B has a fiftieth of the people. SecretKey is the person.
    """
    kinds = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(sources)]))
    rows = spark.range(1, count + 1).select(F.col("id").alias("n"), kinds.alias("k")).where((F.col("k.s") != "B") | (F.col("n") <= max(1, count // 50)))
    name = lambda c: F.concat(F.lit(c * 6), F.col("k.s"), F.col("n"), F.lit("_"), F.sha2(F.col("n").cast("string").cast("binary"), 512))
    own = {f"Field{s}": F.when(F.col("k.s") == s, (F.col("n") * f).cast("string")) for s, f in FACTORS.items()}
    return rows.select(
        name("F").alias("FirstName"), name("L").alias("LastName"), F.concat_ws(" ", "n", F.lit("Main St")).alias("StreetAddress"), F.lit("Plaineville ME").alias("City"),
        F.format_string("%05d", F.expr("(n - 1) % 100")).alias("ZipCode"), F.col("n").cast("int").alias("SecretKey"), *[c.alias(k) for k, c in own.items()],
        F.col("k.i").alias("SourceId"), (F.col("n") * len(sources) + F.col("k.i")).alias("id"),
    )
