"""Quality rules: counts of a text's words, symbols and repeats, and the share of its words in lines of content.

Lines are marked content or boilerplate by Viterbi decoding of a linear-chain conditional random field. Its weights
are learned from labelled documents as in quality_classifier, with all of them, as no score is held out here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, slices, table, utf8, windows
from .crf import viterbi
from .lines import OWN, SYMBOLS, lines_of, with_neighbours
from .quality_classifier import LineModel, fit

#: A text is kept if at least this share of its words is in lines of content.
CONTENT_SHARE = 0.5
#: Fewest words, window of repeated words, and most percent of words in repeated windows.
FEWEST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_words")


def repeated_words(texts: list[list[bytes]]) -> np.ndarray:
    """Per text, how many words are in a window of WINDOW words that the text has twice or more."""
    lengths = np.array([len(w) for w in texts], np.int64)
    total, out = int(lengths.sum()), np.zeros(len(texts), np.int64)
    if total < WINDOW:
        return out
    h = np.fromiter((hash(w) for words in texts for w in words), np.int64, total).view(np.uint64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    w = windows(h, WINDOW)
    n = len(w)
    within = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
    key = w[within] ^ (owner[within].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = within[order[np.r_[same, False] | np.r_[False, same]]] if len(order) else within
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + WINDOW, -1)
    return np.bincount(owner, np.cumsum(edge[:-1]) > 0, len(texts)).astype(np.int64)


def measure(model: LineModel, texts: list[bytes]) -> list[np.ndarray]:
    """The COUNTS of each text."""
    words = [t.split() for t in texts]
    got = [lines_of(t) for t in texts]
    lengths = np.array([len(n) for _, n in got], np.int64)
    x = with_neighbours(np.concatenate([x for x, _ in got]).astype(np.float64), lengths)
    content = viterbi(model.crf, x, lengths) * np.concatenate([n for _, n in got])
    owner = np.repeat(np.arange(len(texts)), lengths)
    seen_at = OWN.index("seen")
    return [
        np.array([len(w) for w in words], np.int64),
        np.array([len(str(t.translate(None, SPACES), "utf-8", "replace")) for t in texts], np.int64),
        np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64),
        np.array([np.count_nonzero(f[:, seen_at]) for f, _ in got], np.int64),
        repeated_words(words),
        np.bincount(owner, content, len(texts)).astype(np.int64),
    ]


def apply_rules(docs: DataFrame, model: LineModel, text_col: str = "text") -> DataFrame:
    """docs with the COUNTS, base_failed and kept; columns of these names are replaced.

    Null and empty texts count nothing, fail the base rules and aren't kept. A text fails them with fewer than
    FEWEST_WORDS words, or with more than MOST_REPEATED percent of words in repeated windows; else it is kept if at
    least CONTENT_SHARE of its words is in lines decoded as content, a text being one chain however many lines it has.
    Repeated rows get equal results; other columns may have any names. An empty table gives an empty result.
    """
    docs = docs.drop(*COUNTS, "base_failed", "kept")
    rows = docs.select(F.struct("*").alias("row"), utf8(text_col).alias("body"))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "body"):
            counts = measure(model, b.column("body").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.column("row").flatten(), *[pa.array(c, pa.int64()) for c in counts]], [*schema.names, *COUNTS])

    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + [f"{c} bigint" for c in COUNTS])
    counted = rows.mapInArrow(run, fields)
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    counted = counted.withColumn("base_failed", failed)
    return counted.withColumn("kept", ~F.col("base_failed") & (F.col("content_words") >= CONTENT_SHARE * F.col("n_words")))


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> LineModel:
    return fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ruled = apply_rules(docs.select("doc_id", "text"), fitted(spark, docs, sf_dir))
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words")
