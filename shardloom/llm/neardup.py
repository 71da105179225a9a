"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

Texts with equal shingle sets are one class from the start. Each class's signature has one bin for each of BANDS * ROWS
ranges of a single hash; empty bins copy a bin that a hash of (bin, attempt) picks. Classes that agree in a band share
a bucket. First each class is compared with one centre of its buckets: a star, so candidates grow with the members.
Confirmed links give components. What a star can leave out are links between members of different components that share
a bucket. Members of such a bucket whose signatures say that they may be linked are sent, once for each main component
of their buckets, to the cells of that component, where they are compared on their full sets; a cell gives a forest of
confirmed links. Every link is confirmed on full sets.

Cells are bounded in rows and bytes. A component's cells are its members' blocks by the blocks of those outside it, so
a member of a component with s such strays is sent s / BLOCK times: what is sent grows with the members only as long as
strays fill a bounded number of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import LOWER, mixed, new_path, shared_dir, slices, stored, table, utf8, windows

#: Words of a shingle.
SHINGLE = 5
#: Bands and rows of a band. At similarity 0.85 a pair shares no band once in 10**9 times, at 0.8 once in 10**6.
BANDS, ROWS = 36, 5
#: Pairs whose signatures agree by this much less than the threshold are not confirmed: over six standard deviations, as
#: bins agree independently with the probability of the similarity, whatever the sets' sizes. tests/llm measure it.
SLACK = 0.2
#: Rows and bytes of one block of a bucket or component, and texts that are compared with one other text in one group.
BLOCK, BLOCK_BYTES, GROUP = 2000, 8 << 20, 256
_U64 = np.uint64


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles of all texts, text by text; how many each text has).

    A-Z are lower-cased. A text with fewer than SHINGLE words has its whole sequence as one shingle; without words, none.
    """
    split = [t.translate(LOWER).split() for t in texts]
    lengths = np.array([len(s) for s in split], np.int64)
    of = {w: xxhash.xxh3_64_intdigest(w) for w in dict.fromkeys(chain.from_iterable(split))}
    h = np.fromiter(map(of.__getitem__, chain.from_iterable(split)), _U64, int(lengths.sum()))
    all_windows = windows(h, SHINGLE)
    starts = np.cumsum(lengths) - lengths
    out = []
    for s, n in zip(starts.tolist(), lengths.tolist(), strict=True):
        if n >= SHINGLE:
            out.append(np.unique(all_windows[s : s + n - SHINGLE + 1]))
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[s : s + n].tobytes(), seed=n)], _U64))
        else:
            out.append(np.empty(0, _U64))
    return np.concatenate(out) if out else np.empty(0, _U64), np.array([len(o) for o in out], np.int64)


def signatures(hashes: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Densified one-permutation signatures, one row for each set; empty sets have rows of the largest number."""
    none = np.iinfo(np.uint64).max
    owner = np.repeat(np.arange(len(counts)), counts)
    at = owner * bins + (((hashes >> _U64(32)) * _U64(bins)) >> _U64(32)).astype(np.int64)
    sig = np.full(len(counts) * bins, none, _U64)
    np.minimum.at(sig, at, mixed(hashes ^ _U64(0x5851F42D4C957F2D)) >> _U64(1))
    sig = sig.reshape(-1, bins)
    full = sig != none
    rows, cols = np.nonzero(~full & full.any(1)[:, None])
    attempt = 0
    while len(rows):
        donor = (mixed(np.arange(bins, dtype=_U64) * _U64(0x100000001) + _U64(attempt * 0x632BE59BD9B4E019 % (1 << 64))) % _U64(bins)).astype(np.int64)[cols]
        ok = full[rows, donor]
        sig[rows[ok], cols[ok]] = sig[rows[ok], donor[ok]]
        rows, cols = rows[~ok], cols[~ok]
        attempt += 1
    return sig


def described(docs: DataFrame, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, node (one for each id and text), n_shingles, set_id, bands, sketch of every row.

    set_id is a 128-bit digest of the sorted set, so texts of one set_id have equal sets.
    """
    body = utf8(text_col)
    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, body).alias("node"), body.alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "body"):
            hashes, counts = shingles(b.column("body").to_pylist())
            sig = signatures(hashes, counts, bands * rows)
            ends = np.cumsum(counts)
            of_set = [xxhash.xxh3_128_digest(hashes[e - n : e].tobytes()) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            by_band = sig.reshape(len(counts), bands, rows)
            keys = np.zeros((len(counts), bands), _U64) + np.arange(bands, dtype=_U64)
            for i in range(rows):
                keys = mixed(keys * _U64(0x9E3779B97F4A7C15) + by_band[:, :, i])
            some = counts > 0
            ends = np.r_[0, np.cumsum(some * bands)].astype(np.int32)
            flat = pa.array(keys[some].ravel().view(np.int64))
            sketch = (sig & _U64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("node"), pa.array(counts), pa.array(of_set, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array([s.tobytes() for s in sketch], pa.binary())],
                ["doc_id", "node", "n_shingles", "set_id", "bands", "sketch"],
            )

    return wanted.mapInArrow(run, "doc_id bigint, node bigint, n_shingles bigint, set_id binary, bands array<bigint>, sketch binary")


def confirmed(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= threshold * union.

    A node with many partners is dealt to several groups, each with some of the partners.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts"))
    dealt = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    left = dealt.join(texts.select(F.col("node").alias("b"), "body"), "b").select("a", "part", "b", "body")
    own = texts.select(F.col("node").alias("centre"), F.col("body").alias("own"))
    groups = dealt.select(F.col("a").alias("centre"), F.col("part").alias("own_part")).distinct()
    right = groups.join(own, "centre").select("centre", "own_part", "own")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        own = shingles(right.column("own").to_pylist()[:1])[0]
        ok = []
        for piece in slices(iter(left.combine_chunks().to_batches()), "body"):
            hashes, counts = shingles(piece.column("body").to_pylist())
            shared = np.zeros(len(hashes) + 1, np.int64)
            shared[1:] = np.cumsum(np.isin(hashes, own))
            ends = np.cumsum(counts)
            both = shared[ends] - shared[ends - counts]
            ok.append(pa.table({"a": piece.column("a"), "b": piece.column("b")}).filter(pa.array(100 * both >= threshold * (counts + len(own) - both))))
        return pa.concat_tables(ok)

    return left.groupBy("a", "part").cogroup(right.groupBy("centre", "own_part")).applyInArrow(run, "a bigint, b bigint")


def _in_blocks(rows: DataFrame, group: str, size: Column, *carried: str) -> DataFrame:
    """rows of groups dealt into cells (group, all_at, stray_at) of about BLOCK strays and BLOCK members, or BLOCK_BYTES of each.

    Every stray meets every member of its group in one cell. Rows have rep and stray; in a cell, probe marks its strays.
    """
    blocks = lambda n, b: F.ceil(F.greatest(n / BLOCK, F.coalesce(b, F.lit(0)) / BLOCK_BYTES))
    sizes = rows.groupBy(group).agg(blocks(F.count(F.lit(1)), F.sum(size)).alias("n_all"), blocks(F.count_if("stray"), F.sum(F.when(F.col("stray"), size))).alias("n_stray")).where("n_stray > 0")
    rows, spot = rows.join(sizes, group), F.xxhash64("rep")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = rows.select(group, F.pmod(spot, "n_all").alias("all_at"), every("n_stray").alias("stray_at"), F.lit(False).alias("probe"), *carried)
    probe = rows.where("stray").select(group, every("n_all").alias("all_at"), F.pmod(spot, "n_stray").alias("stray_at"), F.lit(True).alias("probe"), *carried)
    return base.unionByName(probe)


class _Labels:
    """Components of a cell, merged as links are found; says which members are still apart."""

    def __init__(self, *sides: np.ndarray):
        self.names, at = np.unique(np.concatenate(sides), return_inverse=True)
        self.of = np.arange(len(self.names))
        self.sides = np.split(at, np.cumsum([len(s) for s in sides])[:-1])
        self.links: list[tuple[int, int]] = []

    def apart(self, i: int) -> np.ndarray:
        """Members of side 1 that aren't in the component of the stray i of side 0."""
        return np.flatnonzero(self.of[self.sides[1]] != self.of[self.sides[0][i]])

    def link(self, i: int, members: np.ndarray) -> None:
        """Joins the stray's component to those of the members, by one link each."""
        own = self.sides[0][i]
        for other in np.unique(self.of[self.sides[1][members]]).tolist():
            if other != self.of[own]:
                self.links.append((int(self.names[other]), int(self.names[own])))
                self.of[self.of == other] = self.of[own]

    def table(self) -> pa.Table:
        return pa.table({"a": pa.array([a for a, _ in self.links], pa.int64()), "b": pa.array([b for _, b in self.links], pa.int64())})


def _alike(sig: list[np.ndarray], n: list[np.ndarray], i: int, at: np.ndarray, threshold: int) -> np.ndarray:
    """Those of the members `at` of side 1 that sizes and signatures allow to be linked with the stray i of side 0."""
    at = at[100 * np.minimum(n[1][at], n[0][i]) >= threshold * np.maximum(n[1][at], n[0][i])]
    return at[(sig[1][at] == sig[0][i]).mean(1) >= threshold / 100 - SLACK]


def left_out(members: DataFrame, labelled: DataFrame, star: DataFrame, sketches: DataFrame, threshold: int, bins: int) -> DataFrame:
    """(main, rep): members of a bucket that may be linked, by their signatures, with one of another component there.

    members(h, rep), labelled(rep, component), star(a, b). main is the least component of a bucket, and a bucket's strays
    are its members outside it. A row for each member and main at most. Only buckets of two whose pair is in the star
    are left out: that pair has been compared on full sets.
    """
    rows = members.join(labelled, "rep")
    mains = rows.groupBy("h").agg(F.min("component").alias("main"), F.max("component").alias("other"), F.count(F.lit(1)).alias("k"), F.min("rep").alias("a"), F.max("rep").alias("b")).where("main <> other")
    mains = mains.join(star.select("a", "b", F.lit(2).cast("long").alias("k")), ["a", "b", "k"], "left_anti")
    rows = rows.join(mains.select("h", "main"), "h").withColumn("stray", F.col("component") != F.col("main")).join(sketches, "rep")

    def run(rows: pa.Table) -> pa.Table:
        sides = [rows.filter(pc.equal(rows.column("probe"), p)) for p in (True, False)]
        comp, n, rep = ([np.array(t.column(c)) for t in sides] for c in ("component", "n_shingles", "rep"))
        sig = [np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, bins) for t in sides]
        found = [np.empty(0, np.int64)]
        for i in range(len(comp[0])):
            at = _alike(sig, n, i, np.flatnonzero(comp[1] != comp[0][i]), threshold)
            if len(at):
                found += [rep[0][i : i + 1], rep[1][at]]
        found = np.unique(np.concatenate(found))
        return pa.table({"main": pa.array(np.repeat(np.array(rows.column("main")[:1]), len(found)), pa.int64()), "rep": pa.array(found, pa.int64())})

    cells = _in_blocks(rows, "h", F.octet_length("sketch"), "main", "rep", "component", "n_shingles", "sketch")
    return cells.groupBy("h", "all_at", "stray_at").applyInArrow(run, "main bigint, rep bigint").distinct()


def links_within(asked: DataFrame, labelled: DataFrame, texts: DataFrame, threshold: int, bins: int) -> DataFrame:
    """Pairs of components (a, b) that a link between two of the asked(main, rep) of one main joins, confirmed on full shingle sets.

    Those outside the main component are compared with all of other components, in cells; a cell gives one link for each
    component that it joins to another, and leaves out pairs that links found before have joined.
    """
    rows = asked.join(labelled, "rep").withColumn("stray", F.col("component") != F.col("main"))
    rows = rows.join(texts.withColumnRenamed("node", "rep"), "rep")

    def run(rows: pa.Table) -> pa.Table:
        sides = [rows.filter(pc.equal(rows.column("probe"), p)) for p in (True, False)]
        labels = _Labels(*[np.array(t.column("component")) for t in sides])
        sets = [[shingles(b.column("body").to_pylist()) for b in slices(iter(t.combine_chunks().to_batches()), "body")] for t in sides]
        hashes, n = ([np.concatenate([s[k] for s in side] or [np.empty(0, (_U64, np.int64)[k])]) for side in sets] for k in (0, 1))
        sig = [(signatures(h, c, bins) & _U64(255)).astype(np.uint8) for h, c in zip(hashes, n, strict=True)]
        own, every = (np.split(h, np.cumsum(c)[:-1]) if len(c) else [] for h, c in zip(hashes, n, strict=True))
        for i, mine in enumerate(own):
            at = _alike(sig, n, i, labels.apart(i), threshold)
            if not len(at):
                continue
            sizes, flat = n[1][at], np.concatenate([every[j] for j in at.tolist()])
            place = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
            both = np.add.reduceat((mine[place] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
            labels.link(i, at[100 * both >= threshold * (sizes + len(mine) - both)])
        return labels.table()

    cells = _in_blocks(rows, "main", F.octet_length("body"), "rep", "component", "body")
    return cells.groupBy("main", "all_at", "stray_at").applyInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, threshold: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, node, n_shingles, component, component_id, kept: one row per row of docs.

    Documents are linked if 100 * intersection >= threshold * union of their shingle sets; component_id is the smallest
    doc_id that links reach, and kept says that it is the document's own. Texts that are null or without words have no
    shingles and are linked with nothing. Repeated rows are linked as copies, and rows that repeat an id with another
    text are documents of their own with the same id. A null id takes part, but is never the smallest; without another
    one its component_id is null and it is kept. An empty table gives an empty result; other columns are ignored.
    node is a hash of id and text, to join the result to docs by. component tells components apart whose ids are equal or
    null: it is the node of a member, and null for texts without shingles.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/shardloom"
    about = stored(described(docs, bands, rows, id_col, text_col), "near-signatures")
    # Of equal sets, signatures are equal too.
    of_sets = about.where("n_shingles > 0").groupBy("set_id").agg(F.min("node").alias("rep"), F.min("doc_id").alias("doc_id"), *[F.any_value(c).alias(c) for c in ("n_shingles", "bands", "sketch")])
    classes = stored(of_sets, "near-classes")
    banded = classes.select("rep", F.explode("bands").alias("h"))
    shared = banded.groupBy("h").agg(F.min("rep").alias("centre"), F.count(F.lit(1)).alias("k")).where("k > 1")
    members = stored(banded.join(shared.select("h", "centre"), "h"), "near-members")
    # The texts that any comparison needs, stored once.
    wanted = members.select(F.col("rep").alias("node")).distinct()
    body = utf8(text_col)
    texts = docs.select(F.xxhash64(id_col, body).alias("node"), body.alias("body")).join(wanted, "node", "left_semi").dropDuplicates(["node"])
    path = new_path(spark, "near-texts")
    texts.write.option("compression", "zstd").parquet(path)
    texts = spark.read.schema(texts.schema).parquet(path)
    # A star: each class with the centre that it shares most buckets with.
    ways = members.where("rep <> centre").groupBy("rep", "centre").agg(F.count(F.lit(1)).alias("k"))
    best = ways.groupBy("rep").agg(F.min_by("centre", F.struct(-F.col("k"), "centre")).alias("centre"))
    star = stored(best.select(F.col("centre").alias("a"), F.col("rep").alias("b")), "near-star")
    links = confirmed(star, texts, threshold)
    labels = stored(connected_components(links, "a", "b", folder).withColumnRenamed("node", "rep"), "near-labels")
    ours = stored(texts.select(F.col("node").alias("rep")).join(labels, "rep", "left").select("rep", F.coalesce("component", "rep").alias("component")), "near-ours")
    asked = stored(left_out(members.select("h", "rep"), ours, star, classes.select("rep", "n_shingles", "sketch"), threshold, bands * rows), "near-asked")
    labelled = classes.select("set_id", "doc_id", "rep").join(ours, "rep", "left").select("set_id", "doc_id", F.coalesce("component", "rep").alias("component"))
    if not asked.isEmpty():
        more = connected_components(links_within(asked, ours, texts, threshold, bands * rows), "a", "b", folder)
        more = more.select(F.col("node").alias("component"), F.col("component").alias("joined"))
        labelled = labelled.join(more, "component", "left").select("set_id", "doc_id", F.coalesce("joined", "component").alias("component"))
    least = labelled.groupBy("component").agg(F.min("doc_id").alias("least"))
    of_set = labelled.join(least, "component").select("set_id", "component", "least")
    out = about.select("doc_id", "node", "n_shingles", "set_id").join(of_set, "set_id", "left")
    least_id = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "node", "n_shingles", "component", least_id.alias("component_id"), F.col("doc_id").eqNullSafe(least_id).alias("kept"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all documents, at 85 percent of shingles shared."""
    return near_duplicates(table(spark, sf_dir, "documents"), 85).select("doc_id", "n_shingles", "component_id", "kept")


OP2_SQL = """
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), lambda w: w <> '') AS w
  FROM documents),
g AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
                      WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END AS l
  FROM t),
s AS (SELECT DISTINCT doc_id, unnest(l) AS s FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d JOIN (SELECT doc_id, min(other) AS c FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
LEFT JOIN n ON n.doc_id = d.doc_id
"""
