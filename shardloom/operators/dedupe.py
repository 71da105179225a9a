"""Entity resolution: block, match, connect, merge. Each step is a DataFrame operator."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import could_be_similar, name_similarity, parts_score
from ..session import checkpoints
from .alike import Keys, candidate_pairs, candidates
from .components import connected_components

#: Names match from this similarity on (fixed value).
THRESHOLD = 0.9


def with_blocks(people: DataFrame, zip_code: str = "ZipCode", first: str = "FirstName", last: str = "LastName") -> DataFrame:
    """people with block: postal code as a number (null if it is none) and the names' first letters, as columns to join on."""
    letter = lambda c: F.substring(c, 1, 1)
    return people.withColumns({"block_zip": F.expr(f"try_cast({zip_code} AS int)"), "block_first": letter(first), "block_last": letter(last)})


def nest(records: DataFrame, blocks: Sequence[str], name: str = "Rows", part_rows: int = 10_000) -> DataFrame:
    """blocks, name: the records of each block as arrays of structs, of about part_rows each; a block with more has several."""
    sizes = records.groupBy(*blocks).agg(F.ceil(F.count(F.lit(1)) / part_rows).alias("__parts"))
    on = [F.col(f"r.{b}").eqNullSafe(F.col(f"s.{b}")) for b in blocks]
    dealt = records.alias("r").join(sizes.alias("s"), on).select("r.*", F.pmod(F.monotonically_increasing_id(), F.col("__parts")).alias("__part"))
    rest = [c for c in records.columns if c not in blocks]
    return dealt.groupBy(*blocks, "__part").agg(F.collect_list(F.struct(*rest)).alias(name)).drop("__part")


def unnest(nested: DataFrame, name: str = "Rows") -> DataFrame:
    """The records of nested blocks, one row each, beside the blocks' other columns."""
    return nested.select(*[c for c in nested.columns if c != name], F.explode(name).alias("__row")).select("*", "__row.*").drop("__row")


def matches(
    records: DataFrame,
    blocks: Sequence[str],
    names: Sequence[str],
    threshold: float = THRESHOLD,
    id_col: str = "id",
    source: str | None = None,
    similarity: Callable[[Column, Column], Column] = name_similarity,
) -> DataFrame:
    """left, right: pairs of records of one block all of whose names are alike, as far as they are needed to connect them.

    Records of one block with equal names are one class; a class is linked by its smallest id to the others. With
    name_similarity, only classes that share a key of the name with the most values are compared (alike.candidates; that
    name is found by a scan at once); otherwise, classes of a block are compared with one another. With a source column,
    records of one source don't match each other, so classes are also kept apart by source and linked where they differ.
    Null blocks and null names match nothing; one record alone gives no pair.
    """
    own = [source] if source else []
    classes = records.dropna(subset=[*blocks, *names]).groupBy(*blocks, *names, *own).agg(F.min(id_col).alias("__id"))
    a, b = classes.alias("a"), classes.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in blocks]
    if source:
        on.append(~F.col(f"a.{source}").eqNullSafe(F.col(f"b.{source}")))
    if similarity is name_similarity:
        on += [could_be_similar(F.col(f"a.{n}"), F.col(f"b.{n}"), threshold) for n in names]
        on += [name_similarity(F.col(f"a.{n}"), F.col(f"b.{n}")) >= threshold for n in names]
    if similarity is name_similarity and names and Keys(threshold).usable:
        seen = records.agg(*[F.struct(F.approx_count_distinct(n), F.coalesce(F.max(F.length(n)), F.lit(0))) for n in names]).first()
        _, longest, name = max((*s, n) for s, n in zip(seen, names, strict=True))
        near = candidates(classes, blocks, [n for n in names if n != name], name, threshold, longest, "__id").alias("p")
        pairs = near.join(a, F.col("p.left") == F.col("a.__id")).join(b, [F.col("p.right") == F.col("b.__id"), *on])
    else:
        pairs = a.join(b, [*on, F.col("a.__id") < F.col("b.__id")])
    if similarity is not name_similarity:
        for n in names:
            pairs = pairs.where(similarity(F.col(f"a.{n}"), F.col(f"b.{n}")) >= threshold)
    pairs = pairs.select(F.col("a.__id").alias("left"), F.col("b.__id").alias("right"))
    keyed = records.dropna(subset=[*blocks, *names])
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*blocks, *names, *own]]
    keyed = keyed.alias("r").join(classes.alias("c"), same).select(f"r.{id_col}", "c.__id")
    if source:
        # Copies in one source are connected by way of another source, if their class has a link.
        linked = pairs.select(F.explode(F.array("left", "right")).alias("__id")).distinct()
        keyed = keyed.join(linked, "__id", "left_semi")
    copies = keyed.where(F.col(id_col) != F.col("__id")).select(F.col("__id").alias("left"), F.col(id_col).alias("right"))
    return pairs.unionByName(copies)


def with_components(records: DataFrame, pairs: DataFrame, id_col: str = "id", name: str = "component") -> DataFrame:
    """records with the smallest id that their links reach; those without a link have their own."""
    folder = checkpoints(records.sparkSession)
    found = connected_components(pairs, "left", "right", folder).withColumnsRenamed({"node": id_col, "component": name})
    return records.join(found, id_col, "left").withColumn(name, F.coalesce(name, id_col))


def merged(
    records: DataFrame,
    component: str = "component",
    first: str = "FirstName",
    last: str = "LastName",
    street: str = "StreetAddress",
    city: str = "City",
    zip_code: str = "ZipCode",
    least: Sequence[str] = ("FieldA", "FieldB", "FieldC", "FieldD", "FieldE", "FieldF"),
    id_col: str = "id",
) -> DataFrame:
    """One row per component: the best name, the best address, the least of the other fields.

    Names are scored 2 for a last and 1 for a first one, addresses 4, 2 and 1 for postal code, city and street; ties go
    to the smaller last and first name, then to the smaller id. Name and address may come from different records.
    """
    tie = (last, first, id_col)
    by_name = F.struct(-parts_score((last, 2), (first, 1)), *tie)
    by_place = F.struct(-parts_score((zip_code, 4), (city, 2), (street, 1)), *tie)
    name = F.min_by(F.struct(first, last), by_name)
    place = F.min_by(F.struct(street, city, zip_code), by_place)
    out = records.groupBy(component).agg(name.alias("__name"), place.alias("__place"), F.count(F.lit(1)).alias("n_records"), *[F.min(c).alias(c) for c in least])
    return out.select(component, "__name.*", "__place.*", "n_records", *least)


def deduplicated(people: DataFrame, source: str | None = "SourceId", id_col: str = "id") -> DataFrame:
    """One merged row per person of people, which has an id for each row."""
    blocked = with_blocks(people)
    pairs = matches(blocked, ("block_zip", "block_first", "block_last"), ("FirstName", "LastName"), source=source, id_col=id_col)
    return merged(with_components(blocked, pairs, id_col), id_col=id_col)


def deduplicated_in_blocks(people: DataFrame, source: str | None = "SourceId", id_col: str = "id", threshold: float = THRESHOLD) -> DataFrame:
    """id, component by union-find within each block, in Python: the second formulation of matching and connecting.

    A block is one group, so it must fit a worker; the canonical form has no such bound. Within it, different names are
    compared where they share a key (alike.candidate_pairs).
    """

    def similar(a: str, b: str) -> bool:
        if a == b:
            return True
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return 1 - row[-1] / max(len(a), len(b)) >= threshold

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["__id"].tolist()
        root = {i: i for i in ids}

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        def union(i: int, j: int) -> None:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)

        def link(left: dict[str, list[int]], right: dict[str, list[int]]) -> None:
            for s, us in left.items():
                for t, vs in right.items():
                    if source is None or s != t:
                        # All of a name and source are linked by way of the other; from then on the first stands for them.
                        for held in (us, vs):
                            for i in held[1:]:
                                union(held[0], i)
                            del held[1:]
                        union(us[0], vs[0])

        of: dict[tuple[str, str], dict[str, list[int]]] = {}
        for i, s, *names in zip(ids, pdf["__s"], pdf["FirstName"], pdf["LastName"], strict=True):
            of.setdefault(tuple(names), {}).setdefault(s, []).append(i)
        by = max((0, 1), key=lambda n: len({names[n] for names in of}))
        exact, alike = Keys(threshold).exact, defaultdict(list)
        for names in of:
            other = names[1 - by]
            alike[other if len(other) <= exact else None].append(names)
        for some in alike.values():
            for names in some:
                link(of[names], of[names])
            for i, j in candidate_pairs([names[by] for names in some], threshold):
                if all(map(similar, some[i], some[j])):
                    link(of[some[i]], of[some[j]])
        return pd.DataFrame({"id": ids, "component": [find(i) for i in ids]})

    keys = ["block_zip", "block_first", "block_last"]
    rows = with_blocks(people).dropna(subset=[*keys, "FirstName", "LastName"])
    tag = F.col(source).cast("string") if source else F.lit("")
    return rows.select(*keys, F.col(id_col).cast("long").alias("__id"), tag.alias("__s"), "FirstName", "LastName").groupBy(*keys).applyInPandas(run, "id bigint, component bigint")


def best_of_groups(records: DataFrame, group: str, score: Column, ties: Sequence[str]) -> DataFrame:
    """The best row of each group, whole, by score and then by ties; by a window, so use merged() for large groups."""
    best = F.row_number().over(Window.partitionBy(group).orderBy(score.desc(), *ties))
    return records.withColumn("__best", best).where("__best = 1").drop("__best")


def label_check(records: DataFrame, label: str = "SecretKey", component: str = "component") -> DataFrame:
    """Where components and known labels disagree: kind (split: a label in several components; mixed: a component of
    several labels), name (the label's or component's, as text), parts (of how many). Null labels are left out."""
    pairs = records.where(F.col(label).isNotNull()).select(F.col(label).alias("l"), F.col(component).alias("c")).distinct()
    of = lambda kind, c: pairs.groupBy(c).agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("name"), "parts")
    return of("split", "l").unionByName(of("mixed", "c"))
