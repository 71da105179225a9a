"""Which names may be alike by name_similarity: by keys that they must share, so that not all are compared with all.

Two names of at most L characters are alike with at most k = (1 - threshold) * L edits. Short ones, with k of 0 or 1, share
the name itself or the name without one character. Of longer ones, the longer is cut into k + 1 chunks of a fixed length, one
of which is left by k edits and stands in the other, k places away at most. Nothing is missed; what shares a key by chance is
to be compared.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Differences from float arithmetic.
EPS = 1e-9


class Keys:
    """The keys' lengths for a threshold."""

    def __init__(self, threshold: float) -> None:
        self.slack = 1 - threshold
        least = lambda k: ceil((k - EPS) / self.slack - EPS) if self.slack > EPS else 1 << 30
        #: Names of this length or more may have two edits; shorter ones have keys without one character.
        self.long = least(2)
        #: Names of this length or less are alike only if they are equal.
        self.exact = least(1) - 2
        #: The length of a chunk: a name of `long` or more characters has k + 1 of them.
        self.chunk = min(self.long, int(2 / (3 * max(self.slack, EPS)) + EPS))
        #: Names of this length or more may be alike with one of length `long`.
        self.near_long = ceil(self.long * threshold - EPS)

    @property
    def usable(self) -> bool:
        """False for thresholds so low that names without a chunk in common may be alike."""
        return self.chunk > 0

    def edits(self, length: int) -> int:
        return int(self.slack * length + EPS)


def _shorter(name: str) -> Column:
    """The name, and the name without one character."""
    c = F.col(name)
    cut = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    return F.array_distinct(F.concat(F.array(c), cut))


def candidates(records: DataFrame, same: Sequence[str], exact: Sequence[str], name: str, threshold: float, longest: int, id_col: str) -> DataFrame:
    """left, right: ids, the smaller first, of records that are equal in `same` and whose names may be alike, each once.

    exact are further names that must be alike too, and help where they are short. longest is the greatest length of a name.
    """
    k = Keys(threshold)
    n = F.length(name)
    edits = F.floor(F.lit(k.slack) * n + F.lit(EPS)).cast("int")
    tags = [F.when(F.length(c) <= k.exact, F.col(c)) for c in exact]
    hashed = lambda key: F.xxhash64(*same, *tags, key)
    short = records.where(n < k.long).select(F.col(id_col).alias("i"), F.explode(F.transform(F.when(edits > 0, _shorter(name)).otherwise(F.array(name)), hashed)).alias("h"))
    a, b = short.alias("a"), short.alias("b")
    found = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.i") < F.col("b.i"))).select(F.col("a.i").alias("left"), F.col("b.i").alias("right"))
    if longest >= k.long:
        part = lambda at: F.struct(at.alias("at"), hashed(F.substring(F.col(name), at + 1, F.lit(k.chunk))).alias("h"))
        keyed = lambda rows, places: rows.select(F.col(id_col).alias("i"), n.alias("n"), edits.alias("k"), F.explode(F.transform(places, part)).alias("p")).select("i", "n", "k", "p.*")
        chunks = keyed(records.where(n >= k.long), F.transform(F.sequence(F.lit(0), edits), lambda j: j * k.chunk)).alias("a")
        grams = keyed(records.where(n >= k.near_long), F.sequence(F.lit(0), F.greatest(n - k.chunk, F.lit(0)))).alias("b")
        gap = F.col("a.n") - F.col("b.n")
        near = (F.col("a.h") == F.col("b.h")) & gap.between(0, F.col("a.k")) & (F.abs(F.col("a.at") - F.col("b.at")) <= F.col("a.k")) & (F.col("a.i") != F.col("b.i"))
        pairs = chunks.join(grams, near).select(F.least("a.i", "b.i").alias("left"), F.greatest("a.i", "b.i").alias("right"))
        found = found.unionByName(pairs)
    return found.distinct()


def candidate_pairs(names: Sequence[str], threshold: float) -> Iterator[tuple[int, int]]:
    """The same in Python, for names that one worker holds: places in names, the smaller first, each pair once."""
    k = Keys(threshold)
    if not k.usable:
        yield from ((i, j) for j in range(len(names)) for i in range(j))
        return
    short, chunks = defaultdict(list), defaultdict(list)
    for i, s in enumerate(names):
        if len(s) >= k.long:
            for at in range(0, (k.edits(len(s)) + 1) * k.chunk, k.chunk):
                chunks[s[at : at + k.chunk]].append((i, at))
    for j, s in enumerate(names):
        n, near = len(s), set()
        if n < k.long:
            for key in {s} | ({s[:at] + s[at + 1 :] for at in range(n)} if k.edits(n) else set()):
                near.update(short[key])
                short[key].append(j)
        if chunks and n >= k.near_long:
            for at in range(n - k.chunk + 1):
                for i, start in chunks.get(s[at : at + k.chunk], ()):
                    m = len(names[i])
                    # Of two names of one length, each may be the one that is cut.
                    if 0 <= m - n <= k.edits(m) and abs(start - at) <= k.edits(m) and (m > n or i < j):
                        near.add(i)
        yield from ((min(i, j), max(i, j)) for i in near if i != j)
