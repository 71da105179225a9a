"""The queries over the shared tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import name_similarity
from ..operators import sections, stats, variants
from ..operators.dedupe import deduplicated_in_blocks, label_check, matches, merged, nest, unnest, with_blocks, with_components
from ..operators.ordered import running_sum
from ..sources.readers import read_parquet, tagged_union

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str, *names: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        for n in names or (f.__name__,):
            QUERIES[n], SQL[n] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, means: tuple[str, ...], variances: tuple[str, ...] = ()) -> DataFrame:
    """Sums in another order differ in the last digits; these are the digits that are compared."""
    return df.withColumns({c: F.round(c, 6) for c in means} | {c: F.round(c, 4) for c in variances})


KEYS = ["l_returnflag", "l_linestatus"]
C, D, E = "l_extendedprice", "l_discount", "l_quantity"
FLAGSHIP_SQL = """
SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 6) AS mean_of_C, max(l_discount) AS max_of_D,
       round(var_pop(l_quantity), 4) AS var_of_E, round(var_pop(l_quantity), 4) AS var_of_E2
FROM lineitem GROUP BY ALL
"""


def _grouped(name: str, f: Callable[[DataFrame], DataFrame]) -> None:
    @query(FLAGSHIP_SQL, name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(f(table(spark, sf_dir, "lineitem")), ("mean_of_C",), ("var_of_E", "var_of_E2"))


_grouped("vanilla_lineitem", lambda df: stats.grouped_stats(df, KEYS, C, D, E))
_grouped("vanilla_sql", lambda df: variants.grouped_sql(df, KEYS, C, D, E))
_grouped("vanilla_partials", lambda df: variants.grouped_partials(df, KEYS, C, D, E))
_grouped("vanilla_grouped_map", lambda df: variants.grouped_map(df, KEYS, C, D, E))
_grouped("vanilla_udaf", lambda df: variants.grouped_udaf(df, KEYS, C, D, E))


SAMPLE_SQL = """
SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 6) AS mean_of_C, max(l_discount) AS max_of_D,
       round(var_samp(l_quantity), 4) AS var_of_E, round(var_samp(l_quantity), 4) AS var_of_E2
FROM lineitem GROUP BY ALL
"""


@query(SAMPLE_SQL)
def vanilla_sample_udaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(variants.grouped_udaf(table(spark, sf_dir, "lineitem"), KEYS, C, D, E, ddof=1), ("mean_of_C",), ("var_of_E", "var_of_E2"))


@query(SAMPLE_SQL)
def vanilla_sample_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.grouped_stats(table(spark, sf_dir, "lineitem"), KEYS, C, D, E, ddof=1), ("mean_of_C",), ("var_of_E", "var_of_E2"))


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity * l_quantity) / count(l_quantity) - power(sum(l_quantity) / count(l_quantity), 2), 4) AS var_of_E
FROM lineitem GROUP BY ALL
""")
def vanilla_hand_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(*KEYS).agg(F.round(stats.hand_variance(F.col(E)), 4).alias("var_of_E"))


@query("""
SELECT event_type, round(avg(value), 6) AS mean_of_value, max(value) AS max_of_value, round(var_pop(value), 4) AS var_of_value
FROM events GROUP BY event_type
""")
def vanilla_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.grouped_stats(table(spark, sf_dir, "events"), ["event_type"], "value", "value", "value", names=("mean_of_value", "max_of_value", "var_of_value", "again"))
    return rounded(out.drop("again"), ("mean_of_value",), ("var_of_value",))


@query("""
SELECT event_id, round(avg(value) OVER w, 6) AS mean_of_C, max(value) OVER w AS max_of_D, round(var_pop(value) OVER w, 4) AS var_of_E
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
""")
def vanilla_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    out = variants.running_stats(events, ["user_id"], "at", ["event_id"], "value", "value", "value")
    return rounded(out.select("event_id", "mean_of_C", "max_of_D", "var_of_E"), ("mean_of_C",), ("var_of_E",))


CONDITIONAL_SQL = """
SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 6) AS mean_of_C, max(l_discount) AS max_of_D,
       round(var_pop(l_quantity) FILTER (WHERE l_quantity < 25), 4) AS cond_var_of_E,
       round(var_pop(l_quantity) FILTER (WHERE l_quantity < 25), 4) AS cond_var_of_E2
FROM lineitem GROUP BY ALL
"""


def _conditional(name: str, f: Callable[[DataFrame, Column], DataFrame]) -> None:
    @query(CONDITIONAL_SQL, name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(f(table(spark, sf_dir, "lineitem"), F.col(E) < 25), ("mean_of_C",), ("cond_var_of_E", "cond_var_of_E2"))


_conditional("conditional_filter", lambda df, p: stats.conditional_stats(df, KEYS, p, C, D, E))
for _f in (variants.conditional_join, variants.conditional_zero, variants.conditional_nested, variants.conditional_window, variants.conditional_map):
    _conditional(_f.__name__, lambda df, p, f=_f: f(df, KEYS, p, C, D, E))

BILEVEL_SQL = """
WITH low AS (
  SELECT l_returnflag, l_suppkey, sum(l_extendedprice) AS s, count(l_extendedprice) AS n, max(l_discount) AS d, var_pop(l_quantity) AS v
  FROM lineitem GROUP BY ALL)
SELECT l_returnflag, round(sum(s) / sum(n), 6) AS mean_of_C, max(d) AS max_of_D, round(avg(v), 4) AS avg_var_of_E, round(avg(v), 4) AS avg_var_of_E2
FROM low GROUP BY l_returnflag
"""


def _bilevel(name: str, f: Callable) -> None:
    @query(BILEVEL_SQL, name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(f(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_suppkey"], C, D, E), ("mean_of_C",), ("avg_var_of_E", "avg_var_of_E2"))


_bilevel("bilevel_nested", stats.bilevel_stats)
for _f in (variants.bilevel_sql, variants.bilevel_join, variants.bilevel_window):
    _bilevel(_f.__name__, _f)
_bilevel("bilevel_grouped_map", variants.bilevel_map)


@query("""
WITH s AS (
  SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END)
            OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events)
SELECT user_id, CAST(section AS BIGINT) AS section, count(*) AS n_lines, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS n_purchases,
       round(sum(value), 4) AS total, arg_max(event_type, (ts, event_id)) AS last_type
FROM s WHERE section > 0 GROUP BY user_id, section
""")
def sections_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user, a signup opens a section; what comes before the first is left out."""
    events = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    numbered = running_sum(events, ["user_id"], "at", ["event_id"], (F.col("event_type") == "signup").cast("long"), "section")
    return numbered.where("section > 0").groupBy("user_id", "section").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(F.col("event_type") == "purchase").alias("n_purchases"),
        F.round(F.sum("value"), 4).alias("total"),
        F.max_by("event_type", F.struct("at", "event_id")).alias("last_type"),
    )


@query("""
WITH last AS (SELECT l_orderkey, arg_max(l_returnflag, (l_linenumber, l_returnflag)) AS major FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, CAST(1 + count(l_orderkey) AS BIGINT) AS source_lines,
       round(coalesce(sum(l_quantity * l_discount), 0) / greatest(1, coalesce(sum(l_quantity), 0)), 10) AS mean, major,
       round(coalesce(sum(l_quantity * l_discount) FILTER (WHERE l_returnflag = major), 0)
             / greatest(1, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = major), 0)), 10) AS major_mean
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN last USING (l_orderkey)
GROUP BY o_orderkey, major
""")
def sections_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is the header, its items the details: mean discount by quantity, over all and over the last item's flag."""
    items = table(spark, sf_dir, "lineitem")
    q, x = F.sum("l_quantity"), F.sum(F.col("l_quantity") * F.col("l_discount"))
    low = items.groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), q.alias("q"), x.alias("x"), F.max("l_linenumber").alias("at"))
    high = low.groupBy("l_orderkey").agg(
        F.sum("n").alias("n"), F.sum("q").alias("q"), F.sum("x").alias("x"), F.max_by(F.struct(F.col("l_returnflag").alias("major"), F.col("q").alias("mq"), F.col("x").alias("mx")), F.struct("at", "l_returnflag")).alias("m")
    )
    joined = table(spark, sf_dir, "orders").select("o_orderkey").join(high, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    mean = lambda a, b: F.round(F.coalesce(a, F.lit(0.0)) / F.greatest(F.lit(1.0), F.coalesce(b, F.lit(0.0))), 10)
    return joined.select(
        "o_orderkey", (1 + F.coalesce("n", F.lit(0))).alias("source_lines"), mean(F.col("x"), F.col("q")).alias("mean"), F.col("m.major").alias("major"), mean(F.col("m.mx"), F.col("m.mq")).alias("major_mean")
    )


_LINES_SQL = """
  o AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus <> 'P' AS closed, o_orderkey % 4 AS major FROM orders JOIN customer ON c_custkey = o_custkey),
  i AS (SELECT l_orderkey, l_suppkey % 4 AS dept, CAST(floor(l_quantity) AS INTEGER) % 5 AS credits, CAST(floor(l_extendedprice) AS BIGINT) % 5 AS grade FROM lineitem)"""
STUDENTS_SQL = f"""
WITH {_LINES_SQL},
m AS (SELECT o_custkey, arg_max(major, o_orderkey) AS major FROM o WHERE closed GROUP BY o_custkey),
c AS (SELECT o_custkey, count(*) * 2 AS n FROM o WHERE closed GROUP BY o_custkey),
g AS (SELECT o.o_custkey, i.dept, count(*) AS n, sum(credits) AS credits, sum(credits * grade) AS points FROM o JOIN i ON l_orderkey = o_orderkey WHERE closed GROUP BY ALL),
t AS (SELECT g.o_custkey, sum(n) AS n, sum(credits) AS credits, sum(points) AS points, coalesce(sum(credits) FILTER (WHERE dept = major), 0) AS own, coalesce(sum(points) FILTER (WHERE dept = major), 0) AS own_points
      FROM g JOIN m USING (o_custkey) GROUP BY g.o_custkey)
SELECT CAST(c_custkey AS INTEGER) AS "StudentId", c_name AS "StudentName", CAST(1 + coalesce(c.n, 0) + coalesce(t.n, 0) AS INTEGER) AS "SourceLines",
       round(coalesce(points, 0) / greatest(1, coalesce(credits, 0)), 10) AS "GPA", CAST(major AS INTEGER) AS "Major",
       CASE WHEN major IS NOT NULL THEN round(coalesce(own_points, 0) / greatest(1, coalesce(own, 0)), 10) END AS "MajorGPA"
FROM customer LEFT JOIN m ON m.o_custkey = c_custkey LEFT JOIN c ON c.o_custkey = c_custkey LEFT JOIN t ON t.o_custkey = c_custkey
"""


def student_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """value, file, block, at: a customer is a student, an order a trimester, an item a class; pending orders lack the footer."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    orders = table(spark, sf_dir, "orders").join(customers.select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    items = table(spark, sf_dir, "lineitem").join(orders.select("o_custkey", F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    key = F.col("o_orderkey")

    def line(who: str, order: Column, kind: int, of_kind: tuple[Column, Column], *parts: Column) -> list[Column]:
        """A line's text and place: lines of a thousand students are a block, and sort within it by `at`."""
        at = F.format_string("%03d %015d %d %03d %015d", F.col(who) % 1000, order + 1, F.lit(kind), *of_kind)
        return [F.concat_ws(",", *parts).alias("value"), F.lit("lines").alias("file"), F.floor(F.col(who) / 1000).alias("block"), at.alias("at")]

    no_place = (F.lit(0), F.lit(0).cast("long"))
    heads = customers.select(*line("c_custkey", F.lit(-1).cast("long"), 0, no_place, F.lit("S"), F.col("c_custkey"), F.col("c_name")))
    abroad = F.when(F.col("o_orderpriority") == "1-URGENT", "True").otherwise("False")
    opens = orders.select(*line("o_custkey", key, 0, no_place, F.lit("TH"), F.date_format("o_orderdate", "yyyy-MM-dd"), abroad))
    graded = (F.lit("C"), F.col("l_suppkey") % 4, F.floor("l_quantity") % 5, F.floor("l_extendedprice") % 5)
    classes = items.select(*line("o_custkey", F.col("l_orderkey"), 1, (F.col("l_linenumber"), F.col("l_partkey")), *graded))
    closes = orders.where("o_orderstatus <> 'P'").select(*line("o_custkey", key, 2, no_place, F.lit("TF"), key % 4, F.lit("3.5"), F.lit(12)))
    return heads.unionByName(opens).unionByName(classes).unionByName(closes)


def _students(name: str, f: Callable[[DataFrame], DataFrame]) -> None:
    @query(STUDENTS_SQL, name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(student_lines(spark, sf_dir)).withColumns({c: F.round(c, 10) for c in ("GPA", "MajorGPA")})


_students("sections_students", sections.student_summaries)
_students("sections_students_machine", sections.summaries_by_state_machine)


@query(f"""
WITH {_LINES_SQL}, r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS section FROM customer)
SELECT section, CAST(c_custkey AS INTEGER) AS student, 1 + count(o_orderkey) + count(o_orderkey) FILTER (WHERE closed) + CAST(coalesce(sum(n), 0) AS BIGINT) AS n_lines,
       count(o_orderkey) AS n_terms, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_classes, CAST(coalesce(sum(credits), 0) AS BIGINT) AS credits
FROM r LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(credits) AS credits FROM i GROUP BY l_orderkey) ON l_orderkey = o_orderkey
GROUP BY section, c_custkey
""")
def sections_typed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections numbered over all lines, lines brought to one wide row each, then counted by kind."""
    lines = student_lines(spark, sf_dir)
    typed = sections.sparse_lines(sections.section_ids(lines, F.col("value").startswith("S,")))
    kind = lambda k: F.count_if(F.col("Type") == k)
    return typed.groupBy("section").agg(
        F.max("StudentId").alias("student"), F.count(F.lit(1)).alias("n_lines"), kind("TH").alias("n_terms"), kind("C").alias("n_classes"), F.coalesce(F.sum("ClassCredits"), F.lit(0)).alias("credits")
    )


@query("""
SELECT conv_id, count(*) AS n_turns, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS n_user,
       CAST(sum(length(text)) AS BIGINT) AS n_chars, arg_max(role, turn) AS last_role
FROM conversations GROUP BY conv_id
""")
def sections_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"), F.sum(F.length("text")).cast("long").alias("n_chars"), F.max_by("role", "turn").alias("last_role")
    )


@query("""
WITH h AS (SELECT event_id AS first, lead(event_id) OVER (ORDER BY event_id) AS next FROM events WHERE event_type = 'signup')
SELECT e.event_id, h.first FROM events e JOIN h ON e.event_id >= h.first AND (h.next IS NULL OR e.event_id < h.next)
""")
def range_join_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row with the header whose range holds it, by the greatest header so far: a running maximum, no join of ranges."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    block = F.expr("event_id div 100000")
    head = F.when(F.col("event_type") == "signup", F.col("event_id"))
    tops = events.groupBy(block.alias("b")).agg(F.max(head).alias("top"))
    before = tops.select("b", F.max("top").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    within = F.max(head).over(Window.partitionBy("b").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = events.withColumn("b", block).join(before, "b").withColumn("first", F.greatest(within, "before"))
    return rows.where("first is not null").select("event_id", "first")


@query("""
SELECT event_id AS first, lead(event_id) OVER (ORDER BY event_id) AS next FROM events WHERE event_type = 'signup'
""")
def header_ranges_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("event_id").alias("first"))
    return sections.header_ranges(headers, "first")


@query("SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text")
def dedupe_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts, by digest: the text itself is never sent."""
    digest = F.sha2(F.col("text").cast("binary"), 256)
    return table(spark, sf_dir, "documents").groupBy(digest.alias("d")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).select("doc_id", "n")


_PEOPLE_SQL = """
  SELECT c_custkey AS id, c_name AS first, c_mktsegment AS last, c_mktsegment AS city, CAST(c_nationkey AS VARCHAR) AS zip,
         CAST(c_custkey AS VARCHAR) AS street, c_acctbal AS field, c_custkey % 3 AS source, TRY_CAST(c_nationkey AS INTEGER) AS block
  FROM customer"""
_LIKE_SQL = """
    ON a.block = b.block AND substr(a.first, 1, 1) = substr(b.first, 1, 1) AND substr(a.last, 1, 1) = substr(b.last, 1, 1) AND a.id < b.id
  WHERE (CASE WHEN greatest(length(a.first), length(b.first)) = 0 THEN 1 ELSE 1 - levenshtein(a.first, b.first) / greatest(length(a.first), length(b.first)) END) >= 0.9
    AND (CASE WHEN greatest(length(a.last), length(b.last)) = 0 THEN 1 ELSE 1 - levenshtein(a.last, b.last) / greatest(length(a.last), length(b.last)) END) >= 0.9"""
_PAIRS_SQL = f"SELECT a.id AS l, b.id AS r FROM p a JOIN p b {_LIKE_SQL}"
_COMPONENTS_SQL = """
  e AS (SELECT l, r FROM m UNION SELECT r, l FROM m),
  w(id, other) AS (SELECT id, id FROM p UNION SELECT w.id, e.r FROM w JOIN e ON e.l = w.other),
  c AS (SELECT id, min(other) AS component FROM w GROUP BY id)"""
COMPONENTS_SQL = f"WITH RECURSIVE p AS ({_PEOPLE_SQL}), m AS ({_PAIRS_SQL}), {_COMPONENTS_SQL} SELECT id, component FROM c"


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as records of people: names are whole columns, the address is the nation, the segment and the key."""
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("first"), F.col("c_mktsegment").alias("last"), F.col("c_mktsegment").alias("city"),
        F.col("c_nationkey").cast("string").alias("zip"), F.col("c_custkey").cast("string").alias("street"), F.col("c_acctbal").alias("field"), (F.col("c_custkey") % 3).alias("source"),
    )
    return with_blocks(rows, "zip", "first", "last")


#: The surveyed block: postal code and one first letter of each name.
BLOCKS, NAMES = ("block_zip", "block_first", "block_last"), ("first", "last")


@query(f"""
WITH p AS ({_PEOPLE_SQL}),
k AS (SELECT min(id) AS id, first, last, block FROM p WHERE block IS NOT NULL AND first IS NOT NULL AND last IS NOT NULL GROUP BY first, last, block),
m AS (SELECT a.id AS l, b.id AS r FROM k a JOIN k b {_LIKE_SQL}),
x AS (SELECT k.id AS l, p.id AS r FROM p JOIN k USING (first, last, block) WHERE p.id <> k.id)
SELECT l AS "left", r AS "right" FROM m UNION ALL SELECT l, r FROM x
""")
def dedupe_block_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches between classes of equal names, and the members of each class."""
    return matches(people(spark, sf_dir), BLOCKS, NAMES)


@query(COMPONENTS_SQL)
def dedupe_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = people(spark, sf_dir)
    return with_components(rows, matches(rows, BLOCKS, NAMES)).select("id", "component")


@query(COMPONENTS_SQL.replace("AND a.id < b.id", "AND a.id < b.id AND a.source <> b.source"))
def dedupe_sources_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where records of one source don't match each other."""
    rows = people(spark, sf_dir)
    return with_components(rows, matches(rows, BLOCKS, NAMES, source="source")).select("id", "component")


@query(COMPONENTS_SQL)
def dedupe_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second formulation: union-find over the nested records of each block, in Python."""
    rows = people(spark, sf_dir).withColumnsRenamed({"first": "FirstName", "last": "LastName", "zip": "ZipCode"})
    return deduplicated_in_blocks(rows, source=None)


@query(f"""
WITH p AS ({_PEOPLE_SQL})
SELECT block, substr(first, 1, 1) || substr(last, 1, 1) AS letters, count(*) AS n, round(max(field), 6) AS most, min(id) AS least,
       CAST(sum(CASE WHEN field < 0 THEN 1 ELSE 0 END) AS BIGINT) AS below
FROM p GROUP BY ALL
""")
def dedupe_nested_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks nested in parts, an array operator over them, then unnested and counted."""
    nested = nest(people(spark, sf_dir), BLOCKS, "Rows").withColumn("below", F.size(F.filter("Rows", lambda r: r["field"] < 0)))
    counts = nested.groupBy(*BLOCKS).agg(F.sum("below").alias("below"))
    rows = unnest(nested.drop("below"), "Rows").groupBy(*BLOCKS).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("field"), 6).alias("most"), F.min("id").alias("least"))
    both = rows.join(counts, list(BLOCKS))
    return both.select(F.col("block_zip").alias("block"), F.concat("block_first", "block_last").alias("letters"), "n", "most", "least", "below")


@query(f"""
WITH RECURSIVE p AS ({_PEOPLE_SQL}), m AS ({_PAIRS_SQL}), {_COMPONENTS_SQL},
j AS (SELECT c.component, p.*,
        (CASE WHEN length(last) > 0 THEN 2 ELSE 0 END) + (CASE WHEN length(first) > 0 THEN 1 ELSE 0 END) AS ns,
        (CASE WHEN length(zip) > 0 THEN 4 ELSE 0 END) + (CASE WHEN length(city) > 0 THEN 2 ELSE 0 END) + (CASE WHEN length(street) > 0 THEN 1 ELSE 0 END) AS ps
      FROM c JOIN p USING (id)),
n AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY component ORDER BY ns DESC, last, first, id) = 1),
a AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY component ORDER BY ps DESC, last, first, id) = 1),
g AS (SELECT component, count(*) AS n_records, min(field) AS field FROM j GROUP BY component)
SELECT component, n.first, n.last, a.street, a.city, a.zip, n_records, g.field
FROM g JOIN n USING (component) JOIN a USING (component)
""")
def dedupe_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = people(spark, sf_dir)
    connected = with_components(rows, matches(rows, BLOCKS, NAMES))
    return merged(connected, first="first", last="last", street="street", city="city", zip_code="zip", least=("field",))


@query("""
SELECT 'supplier' AS source, s_nationkey AS nation, count(*) AS n, round(avg(s_acctbal), 6) AS mean FROM supplier GROUP BY s_nationkey
UNION ALL
SELECT 'customer', c_nationkey, count(*), round(avg(c_acctbal), 6) FROM customer GROUP BY c_nationkey
""")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = lambda t, p: table(spark, sf_dir, t).select(F.col(f"{p}_nationkey").alias("nation"), F.col(f"{p}_acctbal").alias("balance"))
    both = tagged_union((t, balance(t, t[0])) for t in ("supplier", "customer"))
    both = both.withColumnRenamed("SourceId", "source")
    return both.groupBy("source", "nation").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("balance"), 6).alias("mean"))


@query("""
SELECT o_orderkey, CAST(o_orderdate + INTERVAL 4 MONTH AS DATE) AS next_term, CAST(o_orderdate - INTERVAL 11 MONTH AS DATE) AS last_term FROM orders
""")
def orders_next_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates moved by months, to the month's end at most."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.add_months("o_orderdate", 4).alias("next_term"), F.add_months("o_orderdate", -11).alias("last_term"))


@query("""
SELECT event_id, last_value(event_type) OVER w AS last_type, count(*) OVER w AS n
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)
""")
def events_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of so many rows around each."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 3)
    return table(spark, sf_dir, "events").select("event_id", F.last("event_type").over(w).alias("last_type"), F.count(F.lit(1)).over(w).alias("n"))


@query(f"""
{COMPONENTS_SQL.replace("SELECT id, component FROM c", "")},
q AS (SELECT DISTINCT c.component, p.last || '/' || p.zip AS label FROM c JOIN p USING (id))
SELECT 'split' AS kind, label AS name, count(*) AS parts FROM q GROUP BY label HAVING count(*) > 1
UNION ALL
SELECT 'mixed', CAST(component AS VARCHAR), count(*) FROM q GROUP BY component HAVING count(*) > 1
""")
def dedupe_label_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components held against labels."""
    rows = people(spark, sf_dir)
    connected = with_components(rows, matches(rows, BLOCKS, NAMES))
    return label_check(connected.withColumn("label", F.concat_ws("/", "last", "zip")), "label")


@query("""
SELECT p_partkey, round(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)), 6) AS similarity FROM part
""")
def name_similarity_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(name_similarity("p_name", "p_type"), 6).alias("similarity"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["vanilla_lineitem"](spark, sf_dir)
