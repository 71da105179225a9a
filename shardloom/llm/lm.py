"""Language-model scores: marginal likelihood over a lattice of subwords.

The vocabulary is that of an existing piece model. Its own scores are ranks of merges, so they only give the start: the
piece of rank r has a share of 1 / (r + RANK_SHIFT). From there, ROUNDS times, each distinct training word's lattice
gives the expected count of each piece over all segmentations (forward and backward recursion in logs), times how often
the word is seen, and shares of these counts are the new scores. A document's probability is the product over its words,
and one end piece, of the sum over all segmentations of the word; the sum is a forward recursion in logs. Words never
share a piece, so each distinct word is worked on once a round.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import bucket_count, in_place, open_chunk, pack, pack_floats, unpack, unpack_floats, word_chunks, words_of
from .common import LOWER, crc_fold, stored, table, utf8

#: Added to every piece's count, as to every word's in the base model.
SMOOTHING = 0.1
#: Added to a piece's rank for its first share; rounds of expected counts.
RANK_SHIFT, ROUNDS = 20, 1
#: Expected counts are summed in units of one over this.
COUNT_UNIT = 1 << 20
#: Marks the start of a word in the piece vocabulary (fixed value).
WORD_START = "▁"
_LONGS = pa.list_(pa.int64())


def lowered(text: bytes) -> bytes:
    return text.translate(LOWER)


def pieces_of(model_file: str) -> tuple[dict[str, int], dict[int, int], dict[int, float]]:
    """The pieces of the model that stand for text: {piece: id}, {byte: id}, and first logs of shares, {id: log}."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    texts, by_byte = {}, {}
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            by_byte[int(sp.id_to_piece(i)[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            texts[sp.id_to_piece(i)] = i
    known = [*texts.values(), *by_byte.values()]
    shares = {i: 1 / (r + RANK_SHIFT) for r, i in enumerate(sorted(known, key=lambda i: (-sp.get_score(i), i)))}
    whole = math.log(sum(shares.values()))
    return texts, by_byte, {i: math.log(x) - whole for i, x in shares.items()}


class Lattice:
    """All segmentations of a word into pieces; texts and by_byte give pieces' ids, logs the natural logs of their shares.

    A word starts with WORD_START. That character within a word, as any that is no piece, is spelt in bytes, so two
    words never have the same segmentations.
    """

    def __init__(self, texts: dict[str, int], by_byte: dict[int, int], logs: dict[int, float]):
        self.by_byte, self.logs = by_byte, logs
        # Tries of the pieces that open a word, less the mark, and of the others; a node's "" holds a piece (ids, log).
        self.opening: dict = {}
        self.inner: dict = {}
        for p, i in texts.items():
            rest = p.removeprefix(WORD_START)
            if WORD_START not in rest:
                node = self.inner if rest == p else self.opening
                for c in rest:
                    node = node.setdefault(c, {})
                node[""] = ((i,), logs[i])

    def _spelt(self, text: str) -> tuple[tuple[int, ...], float]:
        ids = tuple([self.by_byte[b] for b in text.encode("utf-8", "replace")])
        return ids, sum([self.logs[b] for b in ids])

    def _ways(self, word: str) -> tuple[list[float], list[list[tuple]]]:
        """(log of the summed shares of all ways to each place, for each place the pieces that end there: (from, (ids, log))).

        Place 0 is before the mark, place 1 before the word's first character.
        """
        n, exp, log, inner = len(word), math.exp, math.log, self.inner
        ends: list[list[tuple]] = [[] for _ in range(n + 2)]
        come = [-math.inf] * (n + 2)
        come[0] = 0.0
        node = self.opening
        if "" not in node:
            ends[1].append((0, self._spelt(WORD_START)))
        for j in range(n + 1):
            piece = node.get("")
            if piece is not None:
                ends[j + 1].append((0, piece))
            if j == n:
                break
            node = node.get(word[j])
            if node is None:
                break
        for i in range(1, n + 2):
            some = [come[j] + piece[1] for j, piece in ends[i]]
            if not some:
                continue
            top = max(some)
            come[i] = top + log(sum([exp(x - top) for x in some])) if len(some) > 1 else top
            if i > n:
                break
            node, j = inner, i - 1
            while j < n:
                node = node.get(word[j])
                if node is None:
                    break
                j += 1
                piece = node.get("")
                if piece is not None:
                    ends[j + 1].append((i, piece))
            c = word[i - 1]
            if "" not in inner.get(c, ()):
                ends[i + 1].append((i, self._spelt(c)))
        return come, ends

    def score(self, word: str) -> float:
        """The natural log of the summed shares of the word's segmentations."""
        return self._ways(word)[0][-1]

    def expect(self, word: str, times: float, into: list[float]) -> None:
        """Adds the expected counts of the pieces in the word's segmentations, times how often it is seen."""
        come, ends = self._ways(word)
        exp = math.exp
        # The share of all ways that pass each place, from the end: what passes a piece passes both its places.
        passing = [0.0] * (len(come) - 1) + [times]
        for i in range(len(come) - 1, 0, -1):
            if passing[i]:
                rest = passing[i]
                for j, (ids, w) in ends[i]:
                    share = rest * exp(come[j] + w - come[i])
                    passing[j] += share
                    for p in ids:
                        into[p] += share


def _bucket_counts(rows: list[dict]) -> tuple[list[list[bytes]], dict[bytes, int]]:
    """The words of each row of a bucket, and all their training counts."""
    own, total = [], {}
    for r in rows:
        words = words_of(r)
        own.append(words)
        for w, c in zip(words, unpack(r["b"]).tolist(), strict=True):
            total[w] = total.get(w, 0) + c
    return own, total


def expected(chunks: DataFrame, texts: dict[str, int], by_byte: dict[int, int], logs: dict[int, float]) -> DataFrame:
    """tokens, distinct, piece, times of each bucket: training tokens, distinct training words, and its pieces' expected counts.

    Counts come in whole units of 1 / COUNT_UNIT, so their sums don't depend on the order of the buckets.
    """
    model = chunks.sparkSession.sparkContext.broadcast((texts, by_byte, logs))

    def learn(rows: pa.Table) -> pa.Table:
        _, total = _bucket_counts(rows.to_pylist())
        seen = {w: c for w, c in total.items() if c}
        lattice, into = Lattice(*model.value), [0.0] * (max(logs) + 1)
        for w in sorted(seen):
            lattice.expect(str(w, "utf-8", "replace"), seen[w], into)
        times = np.rint(np.array(into) * COUNT_UNIT).astype(np.int64)
        at = np.flatnonzero(times)
        return pa.table({"tokens": [sum(seen.values())], "distinct": [len(seen)], "piece": pa.array([at.tolist()], _LONGS), "times": pa.array([times[at].tolist()], _LONGS)})

    return chunks.where("is_words").groupBy("key").applyInArrow(learn, "tokens bigint, distinct bigint, piece array<bigint>, times array<bigint>")


def score_documents(docs: DataFrame, trains: Column, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; logs are decimal.

    trains is a boolean over docs: rows for which it holds are learned from. A-Z are lower-cased; tokens are the words
    and one end. Null text counts as empty: the end alone. Repeated rows count each time. Without training rows every
    count is 0 and scores come from the smoothing alone; an empty table gives an empty result. Ids may be null. Other
    columns of docs are ignored. Chunks are stored, so later steps don't depend on the order of docs' rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("body"), F.coalesce(trains, F.lit(False)).alias("trains"))
    chunks = stored(word_chunks(rows, bucket_count(docs, text_col), lowered, "trains"), "lm-chunks")

    texts, by_byte, logs = pieces_of(model_file)
    ends = rows.where("trains").count()
    for _ in range(ROUNDS):
        learned = stored(expected(chunks, texts, by_byte, logs), "lm-learned")
        # One row for each piece at most.
        counts = {r["piece"]: r["times"] / COUNT_UNIT for r in learned.select(F.inline(F.arrays_zip("piece", "times"))).groupBy("piece").agg(F.sum("times").alias("times")).collect()}
        drawn = math.log(sum(counts.values()) + ends + SMOOTHING * (len(logs) + 1))
        logs = {i: math.log(counts.get(i, 0) + SMOOTHING) - drawn for i in logs}
    tokens, distinct = (x or 0 for x in learned.agg(F.sum("tokens"), F.sum("distinct")).first())
    n_all, v_all = tokens + ends, distinct + (ends > 0)
    # Bounded by the piece vocabulary.
    model = spark.sparkContext.broadcast((texts, by_byte, logs))
    end_score = (math.log(ends + SMOOTHING) - drawn) / math.log(10)
    floor = math.log10(n_all + SMOOTHING * (v_all + 1))
    end_base, end_known = math.log10(ends + SMOOTHING) - floor, int(ends > 0)

    def find(rows: pa.Table) -> pa.Table:
        """Gives every chunk the training counts and scores of its words."""
        rows = rows.to_pylist()
        own, total = _bucket_counts(rows)
        score, tens = Lattice(*model.value).score, math.log(10)
        scores = {w: score(str(w, "utf-8", "replace")) / tens for w in total}
        return pa.table({
            "chunk": [r["chunk"] for r in rows], "bucket": [r["bucket"] for r in rows], "n": [len(words) for words in own],
            "counts": pa.array([pack(np.array([total[w] for w in words])) for words in own], pa.binary()),
            "scores": pa.array([pack_floats(np.array([scores[w] for w in words])) for words in own], pa.binary()),
        })

    found = chunks.where("is_words").groupBy("key").applyInArrow(find, "chunk bigint, bucket bigint, n bigint, counts binary, scores binary")

    def place(own: pa.Table, found: pa.Table) -> pa.Table:
        info, lengths, at, which = open_chunk(own.to_pylist()[0])
        order, found = in_place(which, found.to_pylist())
        count, score = np.zeros(len(which), np.int64), np.zeros(len(which))
        if found:
            count[order] = np.concatenate([unpack(r["counts"]) for r in found])
            score[order] = np.concatenate([unpack_floats(r["scores"]) for r in found])
        base = np.log10(count + SMOOTHING) - floor
        of = np.repeat(np.arange(len(lengths)), lengths)
        total = lambda x: np.bincount(of, x[at], len(lengths))
        return pa.table({
            "doc_id": info.column("doc_id"), "held_out": pa.array(~np.array(info.column("counted"))), "n_tokens": lengths + 1,
            "n_known": total((count > 0).astype(float)).astype(np.int64) + end_known, "train_tokens": np.full(len(lengths), n_all, np.int64),
            "base_score": total(base) + end_base, "score": total(score) + end_score,
        })

    return chunks.where("not is_words").groupBy("key").cogroup(found.groupBy("chunk")).applyInArrow(
        place, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    )


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from nine tenths of them (those whose crc32 of the id isn't 0 modulo 10)."""
    import public_tokenizers as P

    return score_documents(table(spark, sf_dir, "documents"), crc_fold("doc_id", 10) != 0, P.path("piece_bpe_32k.model"))
