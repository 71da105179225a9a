"""Repeated passages by sparse suffix arrays.

Of a text's suffixes (by word) only those are retained that start at content-selected minimiser positions: the place,
for each window of `least` words, at which its span of `span` words with the smallest hash begins first. Any two copies
of a window retain the same suffix, whatever stands around them. Retained suffixes are first counted by their leading
span, bucket by bucket: one whose span stands alone is no copy of anything. The others go on with their words, those
of all windows that they are the minimiser of: up to `least - span` words on the left and `least` on the right. In a
bucket they are sorted by their words from the retained place on, and each is compared with its neighbour: the words
that two neighbours have in common tell which suffixes match, and how far to the right; the same sort of the words on the left tells how far matches extend to the left. So windows
are compared word by word (a word being its 64-bit hash), and each copy learns the first document that has it.

Suffixes of one chunk with the same words are one record. A span with more than HOT occurrences is dealt to several
buckets, by its windows: each window then is a record of its own, one for each chunk that has it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .chunks import bucket_count, pack, squeeze, unpack, unsqueeze
from .common import mixed, slices, stored, table, utf8, windows

#: Fewest words of a repeated passage, and words of a minimiser's span.
LEAST, SPAN = 50, 20
#: Occurrences from which on a span is dealt to several buckets.
HOT = 10_000
_U64 = np.uint64
_NO_DOC = np.iinfo(np.int64).max


class Layout:
    """Where each text of a chunk begins and ends, in words."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.owner = np.repeat(np.arange(len(lengths)), lengths)


class Words(Layout):
    """The same with the words: numbers into the chunk's distinct words, and hashes."""

    def __init__(self, lengths: np.ndarray, ids: np.ndarray, distinct: list[bytes]):
        super().__init__(lengths)
        self.ids, self.distinct = ids, distinct
        self.of_id = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), _U64, len(distinct))
        self.hashes = self.of_id[ids]

    @classmethod
    def split(cls, texts: list[bytes]) -> Words:
        split = [t.split() for t in texts]
        lengths = np.array([len(s) for s in split], np.int64)
        distinct = list(dict.fromkeys(chain.from_iterable(split)))
        place = dict(zip(distinct, range(len(distinct)), strict=True))
        ids = np.fromiter(map(place.__getitem__, chain.from_iterable(split)), np.int64, int(lengths.sum()))
        # Frequent words get small numbers, which pack well.
        order = np.argsort(-np.bincount(ids, minlength=len(distinct)), kind="stable")
        rank = np.empty(len(distinct), np.int64)
        rank[order] = np.arange(len(distinct))
        return cls(lengths, rank[ids], [distinct[i] for i in order.tolist()])

    def packed(self) -> tuple[bytes, bytes, bytes]:
        return pack(self.lengths), pack(self.ids), squeeze(b"\n".join(self.distinct))

    @classmethod
    def opened(cls, lengths: bytes, ids: bytes, distinct: bytes) -> Words:
        words = unsqueeze(distinct)
        return cls(unpack(lengths), unpack(ids), words.split(b"\n") if words else [])

    def inside(self, width: int) -> np.ndarray:
        """Places at which `width` words of one text begin."""
        n = max(0, len(self.ids) - width + 1)
        return self.owner[:n] == self.owner[width - 1 :][:n] if n else np.zeros(0, bool)


def _first_least(x: np.ndarray, width: int) -> np.ndarray:
    """The place of the first least of each `width` neighbours."""
    y, at, have = x, np.arange(len(x)), 1
    while have < width:
        step = min(have, width - have)
        less = y[step:] < y[:-step]
        y, at = np.where(less, y[step:], y[:-step]), np.where(less, at[step:], at[:-step])
        have += step
    return at


def minimisers(words: Words, least: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Retained places by rising place: (first window, last window, place, span's hash); windows go by their first word."""
    window = np.flatnonzero(words.inside(least))
    if not len(window):
        return window, window, window, np.empty(0, _U64)
    spans = windows(words.hashes, span)
    place = _first_least(spans, least - span + 1)[window]
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[starts[1:], len(place)] - 1
    return window[starts], window[last], place[starts], spans[place[starts]]


def _buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Each key's bucket. Keys are mixed first, as the hashes of minimisers are small ones."""
    return (((mixed(keys) >> _U64(32)) * _U64(buckets)) >> _U64(32)).astype(np.int64)


def _runs(sorted_values: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(value, where it stands) of each run of equal values."""
    edges = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.empty(0, np.int64)
    for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(sorted_values)], strict=False):
        yield int(sorted_values[s]), slice(s, e)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for as many as each count says, one after another."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def _rows_sorted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows by their words, words that each has in common with the one before; 0 for the first)."""
    rows = np.ascontiguousarray(rows)
    order = np.argsort(rows.view(f"V{rows.itemsize * rows.shape[1]}").ravel(), kind="stable")
    by = rows[order]
    same = by[1:] == by[:-1]
    return order, np.r_[0, np.where(same.all(1), rows.shape[1], same.argmin(1))][: len(rows)]


def _classes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """For each row, the number of the run of sorted rows that share their first `depth` words."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.r_[False, common[1:] < depth][: len(order)])
    return out


class Records:
    """Retained suffixes with the words of their windows: the words left of the place, and the windows they have.

    left: words before the place; n: windows, the first of which begins `left` words before it; twice: whether the
    chunk has the record more than once; doc: the first document that has it; words: all records' words in a row.
    """

    def __init__(self, left: np.ndarray, n: np.ndarray, twice: np.ndarray, doc: np.ndarray, words: np.ndarray, least: int):
        self.left, self.n, self.twice, self.doc, self.words = left, n, twice, doc, words
        self.sizes = n + least - 1

    def packed(self, of_id: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
        ids, at = np.unique(self.words, return_inverse=True)
        return pack(np.concatenate([self.left, self.n, self.twice])), pack(self.doc), pack(at), of_id[ids].tobytes()

    @classmethod
    def joined(cls, rows: list[dict], least: int) -> Records:
        """The records of several chunks; words become numbers that hold for all of them."""
        parts, docs, words, seen, known = [], [], [], [], 0
        for r in rows:
            parts.append(unpack(r["a"]).reshape(3, -1))
            docs.append(unpack(r["b"]))
            words.append(unpack(r["c"]) + known)
            seen.append(np.frombuffer(r["d"], _U64))
            known += len(seen[-1])
        number = np.unique(np.concatenate(seen), return_inverse=True)[1].astype(np.int32)
        left, n, twice = np.concatenate(parts, 1)
        return cls(left, n, twice.astype(bool), np.concatenate(docs), number[np.concatenate(words)], least)

    def sides(self, least: int, span: int) -> tuple[np.ndarray, np.ndarray]:
        """The words from the place on, and those before it from the nearest on; -1 where a record has none."""
        starts = np.cumsum(self.sizes) - self.sizes
        owner, at = np.repeat(np.arange(len(self.n)), self.sizes), np.arange(len(self.words)) - np.repeat(starts + self.left, self.sizes)
        right, before = np.full((len(self.n), least), -1, np.int32), np.full((len(self.n), max(1, least - span)), -1, np.int32)
        on = at >= 0
        right[owner[on], at[on]] = self.words[on]
        before[owner[~on], -1 - at[~on]] = self.words[~on]
        return right, before


def matched(records: Records, least: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of each record: (whether another has its words, the first document that does, a number for the words).

    Suffixes are sorted by their words and compared with their neighbours, to the right and to the left. A window that
    begins `a` words before the place matches where least - a words on the right and a on the left are the same.
    """
    right, before = (_rows_sorted(side) for side in records.sides(least, span))
    total, offset = int(records.n.sum()), np.cumsum(records.n) - records.n
    again, first, number, given = np.zeros(total, bool), np.full(total, _NO_DOC), np.zeros(total, np.int64), 0
    for a in range(least - span + 1):
        some = np.flatnonzero((a <= records.left) & (a > records.left - records.n))
        if not len(some):
            continue
        key = _classes(*right, least - a)[some] * len(records.n) + _classes(*before, a)[some]
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        runs = np.diff(np.r_[starts, len(order)])
        by = some[order]
        at = offset[by] + records.left[by] - a
        again[at] = np.repeat((runs > 1) | np.logical_or.reduceat(records.twice[by], starts), runs)
        first[at] = np.repeat(np.minimum.reduceat(records.doc[by], starts), runs)
        number[at] = np.repeat(np.arange(len(starts)) + given, runs)
        given += len(starts)
    return again, first, number


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return squeeze(sink.getvalue().to_pybytes())


def _open(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(unsqueeze(data)) as r:
        return r.read_all().combine_chunks().to_batches()[0]


def _spans_of(flags: np.ndarray, words: Layout) -> list[list[tuple[int, int]]]:
    """Per text, the runs of flagged words as (first, end), counted in the text."""
    out: list[list[tuple[int, int]]] = [[] for _ in words.lengths]
    n = len(flags)
    if not n:
        return out
    first = words.starts[words.lengths > 0]
    new = np.zeros(n, bool)
    new[first] = True
    begin = np.flatnonzero(flags & (new | ~np.r_[False, flags[:-1]]))
    last = np.zeros(n, bool)
    last[words.ends[words.lengths > 0] - 1] = True
    end = np.flatnonzero(flags & (last | ~np.r_[flags[1:], False])) + 1
    for s, e, o in zip(begin.tolist(), end.tolist(), words.owner[begin].tolist(), strict=True):
        out[o].append((s - int(words.starts[o]), e - int(words.starts[o])))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text less the words of the spans and the white space before each of them."""
    if not spans:
        return text
    import re

    places = [m.span() for m in re.finditer(rb"[^ \t\n\x0b\x0c\r]+", text)]
    kept, at = [], 0
    for s, e in spans:
        kept.append(text[at : places[s - 1][1] if s else 0])
        at = places[e - 1][1]
    return b"".join([*kept, text[at:]]).lstrip(b" \t\n\x0b\x0c\r") if spans[0][0] == 0 else b"".join([*kept, text[at:]])


SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())]))
ADDED = (("n_words", T.LongType()), ("n_repeated", T.LongType()), ("n_removed", T.LongType()), ("repeated", SPANS), ("removed", SPANS), ("kept_in", T.ArrayType(T.LongType())))


#: What is sent: kind is one of the letters below; key is the chunk or, as its complement, the bucket that a row is for.
EXCHANGE = "key bigint, kind string, chunk bigint, bucket bigint, n bigint, a binary, b binary, c binary, d binary"
_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
_NAMES = [f.split()[0] for f in EXCHANGE.split(", ")]
#: Words of a chunk, its spans, its rows as they came, its records, where its windows stand, what is known of its windows.
WORDS, SPANS_IN, ROWS, RECORDS, PLACES, FOUND = "words", "spans", "rows", "records", "places", "found"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)], _NAMES)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows)])


def _no_rows(schema: T.StructType) -> pa.Table:
    return pa.Table.from_batches([], to_arrow_schema(schema))


def _of(rows: list[dict], kind: str) -> list[dict]:
    return [r for r in rows if r["kind"] == kind]


def repeats(docs: DataFrame, least: int = LEAST, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text", cut: bool = False) -> DataFrame:
    """docs (or with cut=False its ids alone) with what of each text stands elsewhere in the corpus.

    A window of `least` words is repeated if it occurs twice or more, in one text or several. n_words; n_repeated and
    repeated: words in repeated windows, and their spans (first, end) in words; n_removed and removed: those of them
    in windows of which a copy stands earlier in the text or in a document of a smaller id; kept_in: the ids of the
    documents that hold those copies. With cut, removed words are taken out of the text.

    Words are what ASCII white space separates, compared as they are. Null text has no words; texts of fewer than
    `least` words have no windows. Rows that repeat an id count as one document: none loses a passage to the other. A
    null id comes after all others. Columns of docs named like the ones added are replaced; other names can't clash. An
    empty table gives an empty result. Chunks are stored, so later steps don't depend on the order of docs' rows.
    """
    docs = docs.drop(*[n for n, _ in ADDED])
    docs = docs if cut else docs.select(id_col, text_col)
    buckets = bucket_count(docs, text_col)
    given = docs.schema.fields if cut else [docs.schema[id_col]]
    text_at = [f.name for f in given].index(text_col) if cut else None
    # The rows as they came, without the text, which is in body.
    carried = F.struct(*[F.lit(None).cast("string").alias("text") if i == text_at else F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(given)])
    rows = docs.select(carried.alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_DOC)).alias("order"), utf8(text_col).alias("body"))

    def retain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks, and the hashes of their retained spans with how often they have them."""
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "body"):
            number += 1
            words = Words.split(batch.column("body").to_pylist())
            keys, times = np.unique(minimisers(words, least, span)[3], return_counts=True)
            out = [(number, WORDS, number, -1, batch.num_rows, *words.packed(), _ipc(batch.select(["order"] if cut else ["row", "order"])))]
            if cut:
                out.append((number, ROWS, number, -1, batch.num_rows, _ipc(batch), pack(words.lengths), b"", b""))
            of = _buckets(keys, buckets)
            by = np.argsort(of, kind="stable")
            for bucket, at in _runs(of[by]):
                some = by[at]
                out.append((~bucket, SPANS_IN, number, bucket, len(some), keys[some].tobytes(), pack(times[some]), b"", b""))
            yield _batch(out)

    chunks = stored(rows.mapInArrow(retain, EXCHANGE), "suffix-chunks")

    def counted(rows: pa.Table) -> pa.Table:
        """Tells each chunk which of its spans occur elsewhere too, and which of them are hot."""
        rows = rows.to_pylist()
        every = np.concatenate([np.frombuffer(r["a"], _U64) for r in rows])
        keys, at = np.unique(every, return_inverse=True)
        total = np.bincount(at, np.concatenate([unpack(r["b"]) for r in rows]), len(keys))[at]
        ends = np.cumsum([r["n"] for r in rows])
        out = []
        for r, e in zip(rows, ends.tolist(), strict=True):
            own, n = every[e - r["n"] : e], total[e - r["n"] : e]
            if (n > 1).any():
                out.append((r["chunk"], FOUND, r["chunk"], r["bucket"], int((n > 1).sum()), own[n > 1].tobytes(), pack(n[n > 1] > HOT), b"", b""))
        return _table(out)

    live = chunks.where(F.col("kind") == SPANS_IN).groupBy("key").applyInArrow(counted, EXCHANGE)

    def extend(own: pa.Table, found: pa.Table) -> pa.Table:
        """The records of a chunk's live suffixes, and where its windows stand."""
        r = own.to_pylist()[0]
        words, order = Words.opened(r["a"], r["b"], r["c"]), np.array(_open(r["d"]).column("order"))
        first, last, place, key = minimisers(words, least, span)
        found = found.to_pylist()
        alive = np.concatenate([np.frombuffer(f["a"], _U64) for f in found] or [np.empty(0, _U64)])
        hot = alive[np.concatenate([unpack(f["b"]) for f in found] or [np.empty(0, np.int64)]) > 0]
        some = np.isin(key, alive)
        first, last, place, key = first[some], last[some], place[some], key[some]
        if len(hot) and len(key):
            # Each window of a hot span by itself, keyed by its own words.
            split = np.isin(key, hot)
            n = (last - first + 1)[split]
            one, at = _spread(first[split], n), np.repeat(place[split], n)
            first, last, place = (np.concatenate([x[~split], y]) for x, y in ((first, one), (last, one), (place, at)))
            key = np.concatenate([key[~split], windows(words.hashes, least)[one]])
        left, n = place - first, last - first + 1
        bucket = _buckets(key, buckets)
        # Suffixes with the same words and windows are one record.
        wide = np.full((len(first), 2 * least - span + 3), -1, np.int32)
        wide[:, 0], wide[:, 1], wide[:, 2] = bucket, left, n
        sizes = n + least - 1
        if len(first):
            wide[np.repeat(np.arange(len(first)), sizes), 3 + _spread(np.zeros_like(sizes), sizes)] = words.ids[_spread(first, sizes)]
        by, common = _rows_sorted(wide)
        new = common < wide.shape[1]
        if len(new):
            new[0] = True
        # Records by bucket; sorted rows with the same words stand together.
        starts = np.flatnonzero(new)
        times = np.diff(np.r_[starts, len(by)])
        turn = np.argsort(bucket[by[starts]], kind="stable")
        record = np.empty(len(first), np.int64)
        rank = np.empty(len(starts), np.int64)
        rank[turn] = np.arange(len(starts))
        record[by] = np.repeat(rank, times)
        chosen, twice = by[starts[turn]], times[turn] > 1
        doc_of = order[words.owner[first]] if len(first) else np.empty(0, np.int64)
        doc = np.minimum.reduceat(doc_of[by], starts)[turn] if len(starts) else doc_of
        out = [(r["chunk"], PLACES, r["chunk"], -1, len(first), pack(first), pack(record), pack(n[chosen]), b"")]
        if not cut:
            out.append((r["chunk"], ROWS, r["chunk"], -1, r["n"], r["d"], r["a"], b"", b""))
        for b, at in _runs(bucket[chosen]):
            c = chosen[at]
            ids = words.ids[_spread(first[c], sizes[c])]
            out.append((~b, RECORDS, r["chunk"], b, len(c), *Records(left[c], n[c], twice[at], doc[at], ids, least).packed(words.of_id)))
        return _table(out)

    plain = chunks.where(F.col("kind") == WORDS)
    # Records for buckets and places for chunks are one exchange, which both later steps read.
    extended = plain.groupBy("key").cogroup(live.groupBy("key")).applyInArrow(extend, EXCHANGE).repartition(2 * buckets, "key")

    def compare(rows: pa.Table) -> pa.Table:
        """Tells each chunk which windows of its records other suffixes have too, and which document is the first."""
        rows = sorted(_of(rows.to_pylist(), RECORDS), key=lambda r: r["chunk"])
        if not rows:
            return _table([])
        records = Records.joined(rows, least)
        again, first, number = matched(records, least, span)
        ends = np.cumsum(records.n)[np.cumsum([r["n"] for r in rows]) - 1]
        out = []
        for r, s, e in zip(rows, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            at = np.flatnonzero(again[s:e]) + s
            out.append((r["chunk"], FOUND, r["chunk"], r["bucket"], e - s, squeeze(np.packbits(again[s:e]).tobytes()), pack(first[at]), pack(number[at]), b""))
        return _table(out)

    found = extended.groupBy("key").applyInArrow(compare, EXCHANGE)
    wanted = T.StructType([*given, *[T.StructField(n, t) for n, t in ADDED]])

    def mark(own: pa.Table, found: pa.Table) -> pa.Table:
        """Marks the repeated words of a chunk's texts, and which of them go."""
        rows = own.to_pylist() + found.to_pylist()
        if not (places := _of(rows, PLACES)):
            return _no_rows(wanted)
        as_given = _of(rows, ROWS)[0]
        batch, texts = _open(as_given["a"]), Layout(unpack(as_given["b"]))
        order = np.array(batch.column("order"))
        first, record, n = (unpack(places[0][c]) for c in "abc")
        known = sorted(_of(rows, FOUND), key=lambda r: r["bucket"])
        total = int(n.sum())
        again = np.concatenate([np.unpackbits(np.frombuffer(unsqueeze(r["a"]), np.uint8), count=r["n"]) for r in known] or [np.empty(0, np.uint8)]).astype(bool)
        if len(again) != total:
            raise RuntimeError("a chunk's records and what was found for them don't match")
        holders, number = np.full(total, _NO_DOC), np.zeros(total, np.int64)
        holders[again] = np.concatenate([unpack(r["b"]) for r in known] or [np.empty(0, np.int64)])
        number[again] = np.concatenate([unpack(r["c"]) + (r["bucket"] << 32) for r in known] or [np.empty(0, np.int64)])
        counts = n[record]
        at = _spread((np.cumsum(n) - n)[record], counts)
        window = _spread(first, counts)[again[at]]
        at = at[again[at]]
        holder, number, owner = holders[at], number[at], texts.owner[window]
        # An earlier copy in the same text: the first window of each (text, words) stays.
        by = np.lexsort((window, number, owner))
        same = (owner[by][1:] == owner[by][:-1]) & (number[by][1:] == number[by][:-1])
        later = np.zeros(len(window), bool)
        later[by] = np.r_[False, same][: len(by)]
        goes = later | (holder < order[owner])

        def covered(some: np.ndarray) -> np.ndarray:
            edge = np.zeros(len(texts.owner) + 1, np.int64)
            np.add.at(edge, some, 1)
            np.add.at(edge, some + least, -1)
            return np.cumsum(edge[:-1]) > 0

        repeated, removed = _spans_of(covered(window), texts), _spans_of(covered(window[goes]), texts)
        kept_in: list[list] = [[] for _ in texts.lengths]
        for o, h in np.unique(np.stack([owner[goes], holder[goes]], 1), axis=0).tolist():
            if h != _NO_DOC:
                kept_in[o].append(h)
        total = lambda spans: [sum(e - s for s, e in x) for x in spans]
        pairs_type = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
        spans_of = lambda spans: pa.array([[{"first": s, "end": e} for s, e in x] for x in spans], pairs_type)
        columns = batch.column("row").flatten()
        if cut:
            bodies = batch.column("body").to_pylist()
            columns[text_at] = pa.array([str(without(t, s), "utf-8", "replace") for t, s in zip(bodies, removed, strict=True)], pa.string())
        added = [pa.array(texts.lengths), pa.array(total(repeated), pa.int64()), pa.array(total(removed), pa.int64()), spans_of(repeated), spans_of(removed), pa.array(kept_in, pa.list_(pa.int64()))]
        return pa.table([*columns, *added], wanted.names)

    told = found.unionByName(chunks.where(F.col("kind") == ROWS)) if cut else found
    return extended.groupBy("key").cogroup(told.groupBy("key")).applyInArrow(mark, wanted)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents."""
    return repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_repeated", "n_removed", "repeated", "removed", "kept_in")
