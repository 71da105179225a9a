"""Mixing sources to target weights by distributed prefix sums over hash-random keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, stored, table

#: Keys are the first 60 bits of an MD5 digest.
KEY_BITS = 60
#: Documents in one range of keys; a source is cut into as many ranges as it needs.
RANGE_ROWS = 5_000
#: Ranges of one run.
RUN = 1000
#: A target stops at so many times its source's size.
MOST_EPOCHS = 3


def source_targets(sized: DataFrame, weights: int = 3) -> DataFrame:
    """One row per source: source_size, rows, weight, target.

    Sources by code point, null last, weigh 1 to `weights` in turn. A target is w * level or MOST_EPOCHS times the
    size, whichever is less; the level is the one at which targets sum to the sum of sizes. Sources are capped in
    order of cap / weight, so the level follows from running sums over one row per source.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    weighed = totals.withColumn("weight", (F.row_number().over(by_name) - 1) % weights + 1)
    weighed = weighed.withColumn("cap", F.lit(float(MOST_EPOCHS)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    run = weighed.withColumns({
        "capped": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
        "whole": F.sum("source_size").over(every),
    })
    run = run.withColumn("level", (F.col("whole") - F.col("capped")) / F.col("open"))
    # The first source, by ratio, that the level of those after it does not cap.
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(every)
    run = run.withColumn("level", first["level"])
    return run.select("source", "source_size", "rows", "weight", F.least("cap", F.col("weight") * F.coalesce("level", "ratio")).alias("target"))


def mix(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, epochs (whole passes), part (words of one more), taken.

    Columns of docs named in carry come along.

    taken = epochs * size + part. Every document gets a random key from its id; each source is sorted by key in ranges
    of keys, and running sums of words tell how far into the source the budget reaches: whole passes first, then the
    documents before the cut, and of the document at the cut the words up to the budget. Sums are exact, so reruns
    agree. Null text has size 0; a null id hashes as empty; null is a source of its own, last in order. Rows that
    repeat an id share a key and are ordered by size, so equal rows can be swapped without a change. An empty table
    gives an empty result. Columns of docs other than the three are ignored.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long").alias("key"),
        *carry,
    )
    narrow = stored(narrow, "mix-sizes")
    targets = stored(source_targets(narrow), "mix-targets")
    keyed = narrow.join(targets, narrow["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    ranges = F.ceil(F.col("rows") / RANGE_ROWS)
    keyed = keyed.withColumn("range", F.floor(F.col("key").cast("double") * ranges / F.lit(float(1 << KEY_BITS))))
    # Prefix sums over runs of ranges, then over the ranges of a run, so no task sees all ranges of a source.
    sums = keyed.groupBy("source", "range").agg(F.sum("size").alias("sum")).withColumn("run", F.expr(f"range div {RUN}"))
    earlier = lambda w: F.coalesce(F.sum("sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = sums.groupBy("source", "run").agg(F.sum("sum").alias("sum")).select(F.col("source").alias("of"), F.col("run").alias("at"), earlier(Window.partitionBy("source").orderBy("run")).alias("base"))
    starts = sums.join(runs, F.col("source").eqNullSafe(F.col("of")) & (F.col("run") == F.col("at")))
    starts = starts.select("source", "range", (F.col("base") + earlier(Window.partitionBy("source", "run").orderBy("range"))).alias("start"))
    on = keyed["source"].eqNullSafe(starts["source"]) & (keyed["range"] == starts["range"])
    placed = keyed.join(starts, on).drop(starts["source"], starts["range"])
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    cut = placed.withColumns({"at": at, "epochs": epochs}).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    cut = cut.withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("at"))).cast("long"))
    return cut.select("doc_id", "source", "size", "source_size", "target", "epochs", "part", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"), *carry)


def mixed_documents(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, and once more with its first words if it is cut.

    Columns stay as they are, but for the text of the rows at the cuts. Rows that are not taken don't come out.
    """
    names = [f"`{c}`" for c in docs.columns]
    marked = docs.select(F.struct(*names).alias("doc"), F.struct(*[F.xxhash64(F.lit(k), *names).alias(f"h{k}") for k in (0, 1)]).alias("row"))
    told = marked.select("row", *[F.col("doc")[c].alias(n) for c, n in ((id_col, "id"), (text_col, "text"), (source_col, "source"))])
    taken = mix(told, seed, "id", "text", "source", ("row",)).where("taken > 0")
    # Rows alike in every column are one row here, taken as often as all of them: a count and the words of the cuts.
    copies = taken.groupBy("row").agg(F.sum("epochs").cast("int").alias("whole"), F.collect_list(F.when(F.col("part") > 0, F.col("part").cast("int"))).alias("parts"))
    one = marked.join(copies, "row").dropDuplicates(["row"])
    spread = one.select("doc", F.explode(F.concat(F.array_repeat(F.lit(-1), F.col("whole")), F.col("parts"))).alias("words"))
    text = F.col("doc")[text_col]
    words = F.regexp_extract_all(text, F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0))
    cut = F.when(F.col("words") < 0, text).otherwise(F.array_join(F.slice(words, 1, F.greatest("words", F.lit(0))), ""))
    return spread.select(*[cut.alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns])


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents: what each source and document gives."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source),
r AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS ratio FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
             - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM r),
t AS (
  SELECT source, source_size,
         least(cap, weight * coalesce((SELECT lev FROM l WHERE lev <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1), ratio)) AS target
  FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target) AS BIGINT) // t.source_size ELSE 0 END AS epochs
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - pos)) AS BIGINT) AS taken
FROM p
"""
