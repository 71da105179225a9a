"""Sections of ordered lines: a header opens one, details follow, and rows only mean something by where they stand."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import checkpoints
from ..sources.schemas import STUDENT_SUMMARY

#: Departments are numbered from 0 (fixed value).
DEPARTMENTS = 4
PLACE = ("file", "block", "at")
#: Lines of a task, about: tasks grow in number with the lines, not in size.
TASK_LINES = 250_000


def parts_of(lines: DataFrame) -> int:
    """Of how many tasks lines are; they are counted at once."""
    return 1 + lines.count() // TASK_LINES


def header_counts(lines: DataFrame, headers: dict[str, Column]) -> DataFrame:
    """lines (value, file, block, at) with, by name, the number of lines of each kind up to and with each line, over all files.

    They are counted for each block of a file, blocks are added up (one row each), then lines within a block.
    """
    flagged = lines.withColumns({f"__h_{n}": F.coalesce(h.cast("long"), F.lit(0)) for n, h in headers.items()})
    blocks = flagged.groupBy("file", "block").agg(*[F.sum(f"__h_{n}").alias(f"__n_{n}") for n in headers])
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", *[F.coalesce(F.sum(f"__n_{n}").over(before), F.lit(0)).alias(f"__s_{n}") for n in headers])
    within = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    counts = {n: F.col(f"__s_{n}") + F.sum(f"__h_{n}").over(within) for n in headers}
    return flagged.join(starts, ["file", "block"]).withColumns(counts).drop(*[f"__{k}_{n}" for n in headers for k in "hs"])


def section_ids(lines: DataFrame, is_header: Column, name: str = "section") -> DataFrame:
    """lines (value, file, block, at) with the number of headers up to and with each line, over all files.

    A section may span blocks and files. Lines before the first header have number 0.
    """
    return header_counts(lines, {name: is_header})


def part(i: int) -> Column:
    """A line's field."""
    return F.get(F.split(F.rtrim("value"), ","), F.lit(i))


def sparse_lines(lines: DataFrame) -> DataFrame:
    """Lines `S,id,name`, `TH,date,abroad`, `C,dept,credits,grade`, `TF,major,gpa,credits` as one wide row each.

    Columns that a kind lacks are null, as are numbers that don't parse. Other columns of lines come along.
    """
    kind = part(0)
    of = lambda k, i, t: F.when(kind == k, part(i).try_cast(t))
    return lines.select(
        *[c for c in lines.columns if c != "value"],
        kind.alias("Type"),
        of("S", 1, "int").alias("StudentId"),
        of("S", 2, "string").alias("StudentName"),
        of("TH", 1, "string").alias("Date"),
        F.when(kind == "TH", part(2) == "True").alias("WasAbroad"),
        of("C", 1, "int").alias("Dept"),
        of("C", 2, "int").alias("ClassCredits"),
        of("C", 3, "int").alias("ClassGrade"),
        of("TF", 1, "int").alias("Major"),
        of("TF", 2, "double").alias("TriGPA"),
        of("TF", 3, "int").alias("TriCredits"),
    )


def student_summaries(lines: DataFrame) -> DataFrame:
    """StudentId, StudentName, SourceLines, GPA, Major, MajorGPA of each section of lines (value, file, block, at).

    A trimester counts once its footer has come: details without one, and lines before the first header, don't.
    SourceLines is the header and the lines of closed trimesters; Major the last footer's; GPA the mean grade by
    credits, 0 without credits, MajorGPA the same over the major's department (null without a major).
    """
    parts = parts_of(lines)
    counted = header_counts(lines.repartition(parts, "file", "block"), {"section": F.col("value").startswith("S,"), "term": part(0) == "TH", "foot": part(0) == "TF"})
    typed = sparse_lines(counted.where("section > 0").select("section", "term", "foot", "value")).repartition(parts, "section")
    # Sums are of numbers alone, so they need no sort; all that follows is done where a section's lines are.
    graded = F.col("Type") == "C"
    owners = ("StudentId", "StudentName", "Major")
    low = typed.groupBy("section", "term", "Dept", *owners).agg(
        F.count_if(F.col("Type") == "TH").alias("heads"),
        F.count_if(F.col("Type") == "TF").alias("feet"),
        F.count_if(F.col("Type").isin("TH", "C", "TF")).alias("n"),
        F.sum(F.when(graded, F.col("ClassCredits"))).alias("credits"),
        F.sum(F.when(graded, F.col("ClassCredits") * F.col("ClassGrade"))).alias("points"),
        F.max(F.when(F.col("Type") == "TF", F.col("foot"))).alias("foot"),
    )
    # Terms are numbered over all sections: what follows a section's header has no term before the section's first.
    whole = Window.partitionBy("section", "term")
    closed = low.withColumn("closed", (F.sum("heads").over(whole) > 0) & (F.sum("feet").over(whole) > 0))
    held = lambda c: F.when(F.col("closed"), F.col(c))
    by_dept = closed.groupBy("section", "Dept", *owners).agg(
        F.coalesce(F.sum(held("n")), F.lit(0)).alias("n"), F.sum(held("credits")).alias("credits"), F.sum(held("points")).alias("points"), F.max(held("foot")).alias("foot")
    )
    by_dept = by_dept.withColumn("last", F.when(F.col("foot").isNotNull(), F.struct("foot", "Major")))
    major = F.max("last").over(Window.partitionBy("section"))["Major"]
    own = F.col("Dept") == F.col("Major")
    none = F.lit(0)
    mean = lambda p, c: F.coalesce(p, none) / F.greatest(F.lit(1), F.coalesce(c, none))
    return (
        by_dept.withColumn("Major", major)
        .groupBy("section")
        .agg(
            F.max("StudentId").alias("StudentId"),
            F.max("StudentName").alias("StudentName"),
            (F.sum("n") + 1).cast("int").alias("SourceLines"),
            mean(F.sum("points"), F.sum("credits")).alias("GPA"),
            F.max("Major").alias("Major"),
            mean(F.sum(F.when(own, F.col("points"))), F.sum(F.when(own, F.col("credits")))).alias("MajorGPA"),
        )
        .select("StudentId", "StudentName", "SourceLines", "GPA", "Major", F.when(F.col("Major").isNotNull(), F.col("MajorGPA")).alias("MajorGPA"))
    )


@dataclass
class Snippet:
    """What a run of lines comes to, mergeable with the run after it.

    head: closed trimesters before the first header belong to a section that began earlier; open lines wait for a
    footer that may come in the next run.
    """

    before: Section | None = None
    done: list[Section] = field(default_factory=list)


@dataclass
class Section:
    """A student's lines so far: closed ones summed, the open trimester apart."""

    student: tuple[int, str] | None = None
    lines: int = 0
    credits: list[int] = field(default_factory=lambda: [0] * DEPARTMENTS)
    points: list[int] = field(default_factory=lambda: [0] * DEPARTMENTS)
    major: int | None = None
    #: Lines before any trimester header of this run: they close with a trimester that began in the run before.
    loose: list[tuple] | None = field(default_factory=list)
    loose_major: int | None = None
    #: Lines of the trimester that is open at the end; None if none is.
    open: list[tuple] | None = None

    def close(self, rows: list[tuple], n: int, major: int) -> None:
        self.lines += n
        self.major = major
        for dept, credits, grade in rows:
            self.credits[dept] += credits
            self.points[dept] += credits * grade

    def untouched(self) -> bool:
        """Whether this run has only seen lines that belong to a trimester of the run before."""
        return self.loose is not None and self.loose_major is None and self.open is None and not self.lines

    def add(self, row: dict) -> None:
        kind = row["Type"]
        if kind == "TH":
            self.open = []
        elif kind == "C":
            line = (row["Dept"], row["ClassCredits"], row["ClassGrade"])
            if self.open is not None:
                self.open.append(line)
            elif self.untouched():
                self.loose.append(line)
        elif kind == "TF" and self.open is not None:
            self.close(self.open, len(self.open) + 2, row["Major"])
            self.open = None
        elif kind == "TF" and self.untouched():
            self.loose_major = row["Major"]

    def then(self, other: Section) -> Section:
        """This section continued by the lines of the next run that precede its first header."""
        if self.open is not None:
            self.open += other.loose
            if other.loose_major is not None:
                self.close(self.open, len(self.open) + 2, other.loose_major)
            if other.loose_major is not None or other.open is not None or other.lines:
                self.open = None
        elif self.untouched():
            self.loose += other.loose
            self.loose_major = other.loose_major
        if other.lines:
            self.lines += other.lines
            self.major = other.major
            self.credits = [a + b for a, b in zip(self.credits, other.credits, strict=True)]
            self.points = [a + b for a, b in zip(self.points, other.points, strict=True)]
        self.open = other.open if other.open is not None else self.open
        return self

    def summary(self) -> tuple:
        mean = lambda p, c: p / max(1, c)
        own = None if self.major is None else mean(self.points[self.major], self.credits[self.major])
        return (*self.student, 1 + self.lines, mean(sum(self.points), sum(self.credits)), self.major, own)


def snippet_of(rows: Iterator[dict]) -> Snippet:
    out, now = Snippet(), Section()
    out.before = now
    for row in rows:
        if row["Type"] == "S":
            now = Section((row["StudentId"], row["StudentName"]), loose=None)
            out.done.append(now)
        else:
            now.add(row)
    return out


def joined(parts: list[Snippet]) -> Snippet:
    """Neighbouring snippets as one."""
    out = parts[0]
    for p in parts[1:]:
        last = out.done[-1] if out.done else out.before
        last.then(p.before)
        out.done += p.done
    return out


def summaries_by_state_machine(lines: DataFrame) -> DataFrame:
    """student_summaries by one pass over each section's lines, in Python: the second formulation.

    Sections follow one another in a partition, and lines come in batches: a worker holds a batch and an open trimester.
    """
    parts = parts_of(lines)
    typed = sparse_lines(section_ids(lines.repartition(parts, "file", "block"), F.col("value").startswith("S,"))).where("section > 0")
    fields = ("Type", "StudentId", "StudentName", "Dept", "ClassCredits", "ClassGrade", "Major")
    ordered = typed.select("section", *PLACE, *fields).repartition(parts, "section").sortWithinPartitions("section", *PLACE).select(*fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, now = to_arrow_schema(STUDENT_SUMMARY), None
        of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for b in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] != "S":
                    now.add(dict(zip(fields, row, strict=True)))
                    continue
                if now:
                    done.append(now.summary())
                now = Section(row[1:3], loose=None)
            if done:
                yield of(done)
        if now:
            yield of([now.summary()])

    return ordered.mapInArrow(run, STUDENT_SUMMARY)


def summaries_by_snippets(lines: DataFrame) -> DataFrame:
    """student_summaries by merging neighbouring snippets: an ordered aggregate that needs no section id.

    Its state holds every section's summary, so it suits inputs whose summaries fit one worker.
    """
    from .ordered import ordered_aggregate

    def fold(frames: Iterator[pd.DataFrame]) -> bytes:
        rows = (r for f in frames for r in f.astype(object).to_dict("records"))
        return pickle.dumps(snippet_of({k: (int(v) if isinstance(v, float) and k != "TriGPA" and v == v else v) for k, v in r.items()} for r in rows))

    def combine(states: list[bytes]) -> bytes:
        return pickle.dumps(joined([pickle.loads(s) for s in states]))

    one = ordered_aggregate(sparse_lines(lines), PLACE, fold, combine)

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for state in f["state"]:
                yield pd.DataFrame([s.summary() for s in pickle.loads(state).done], columns=STUDENT_SUMMARY.names)

    return one.mapInPandas(finish, STUDENT_SUMMARY)


def header_ranges(headers: DataFrame, order: str, name: str = "next") -> DataFrame:
    """headers with the place of the next one, null for the last.

    Headers are sorted in ranges, which are kept by checkpoint; the next one is found within a range, and for a range's
    last from the ranges' first ones, of which there is a row for each range. Headers with equal places follow one another.
    """
    checkpoints(headers.sparkSession)
    ranged = headers.sort(order).withColumn("__range", F.spark_partition_id()).checkpoint()
    firsts = ranged.groupBy("__range").agg(F.min(order).alias("__first"))
    firsts = firsts.select("__range", F.lead("__first").over(Window.orderBy("__range")).alias("__after"))
    within = F.lead(order).over(Window.partitionBy("__range").orderBy(order))
    return ranged.join(firsts, "__range").withColumn(name, F.coalesce(within, "__after")).drop("__range", "__after")
