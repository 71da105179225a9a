"""Document quality from a conditional random field over lines.

Learning: a document's label is given to its lines; lines of low documents that a line-wise model takes for good ones
are relabelled good, so that a prose line beside junk isn't learned as junk. Scoring: forward-backward marginals of
each line, averaged over the words, then put on the scale of label shares by a logistic curve fitted to the same
documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_fold, packed, slices, stored, table, utf8
from .crf import Crf, fit_logistic, forward_backward, train
from .lines import OWN, lines_of, with_neighbours

#: Bounds of the labelled sample a model is fitted on: documents, and lines of all of them; documents are taken whole.
SAMPLE_DOCS, SAMPLE_LINES = 6_000, 360_000


@dataclass(frozen=True)
class LineModel:
    crf: Crf
    scale: np.ndarray
    empty: float


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, most: int = SAMPLE_DOCS) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(features, words a line, label) of at most `most` labelled documents, those with the smallest hashes of their ids.

    Each has all its lines. No document is taken after the one with which they come to SAMPLE_LINES. Of rows that repeat
    an id, the one with the least text is taken, so the sample is bounded in rows too.
    """
    known = labels.where(F.col(target).isin(0, 1)).groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", utf8("text").alias("body")).join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("body").alias("body"), F.max("y").alias("y"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "body"):
            got = [lines_of(t) for t in b.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("y"), pa.array([len(n) for _, n in got], pa.int64()), packed([x.tobytes() for x, _ in got]), packed([n.tobytes() for _, n in got])], ["doc_id", "y", "lines", "x", "n"]
            )

    found = stored(rows.mapInArrow(features, "doc_id bigint, y int, lines bigint, x binary, n binary"), "labelled-sample")
    each = found.groupBy("doc_id").agg(F.sum("lines").alias("lines"))
    upto = F.sum("lines").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")) - F.col("lines")
    taken = each.withColumn("before", upto).where(F.col("before") < SAMPLE_LINES).select("doc_id")
    found = found.join(F.broadcast(taken), "doc_id").select("doc_id", "y", "x", "n").orderBy("doc_id").toArrow().to_pylist()
    return [(np.frombuffer(r["x"], np.float32).reshape(-1, len(OWN)), np.frombuffer(r["n"], np.int64), r["y"]) for r in found]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def line_labels(sample: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features with neighbours, chain lengths, label of each line, words of each line) for training."""
    own = np.concatenate([x for x, _, _ in sample]).astype(np.float64)
    lengths = np.array([len(n) for _, n, _ in sample])
    words = np.concatenate([n for _, n, _ in sample])
    labels = np.repeat(np.array([y for _, _, y in sample]), lengths)
    share = np.clip(labels.mean(), 0.02, 0.98)
    first = fit_logistic(own, labels)
    # A line of a low document is taken for good if it looks better than the classes' shares alone would make it.
    labels = np.where((labels == 0) & (_sigmoid(own @ first) > share), 1, labels)
    return with_neighbours(own, lengths), lengths, labels, words


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality") -> LineModel:
    """A model from labelled documents; without both labels among them, one that scores all alike."""
    sample = labelled_sample(docs, labels, target)
    y = np.array([s[2] for s in sample])
    used = [s for s in sample if len(s[1])]
    if len(set(s[2] for s in used)) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return LineModel(Crf(np.zeros((3 * len(OWN), 2)), np.zeros((2, 2))), np.array([np.log(max(share, 1e-3) / max(1 - share, 1e-3)), 0.0]), share)
    x, lengths, line_y, words = line_labels(used)
    heavy = np.minimum(words, 100) / np.minimum(words, 100).mean()
    crf = train(x, lengths, line_y, heavy * np.where(line_y == 1, 0.5 / max(line_y.mean(), 0.02), 0.5 / max(1 - line_y.mean(), 0.02)))
    good = weighted_share(crf, x, lengths, words)
    z = np.log(np.clip(good, 1e-4, 1 - 1e-4) / (1 - np.clip(good, 1e-4, 1 - 1e-4)))
    scale = fit_logistic(np.stack([np.ones(len(z)), z], 1), np.array([s[2] for s in used]))
    # Documents without a line: their own share of label 1, drawn to one half.
    blank = [s[2] for s in sample if not len(s[1])]
    return LineModel(crf, scale, (sum(blank) + 0.2) / (len(blank) + 1))


def weighted_share(crf: Crf, x: np.ndarray, lengths: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Per text with a line, the mean over its words of the marginal probability that their line is good."""
    p = forward_backward(crf, x, lengths)[0][:, 1]
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    return np.add.reduceat(p * words, starts) / np.add.reduceat(words, starts)


def score(model: LineModel, texts: list[bytes]) -> np.ndarray:
    """0 to 1 for each text; texts without a word get the model's value for them."""
    got = [lines_of(t) for t in texts]
    lengths = np.array([len(n) for _, n in got])
    out = np.full(len(texts), model.empty)
    if lengths.sum():
        x = with_neighbours(np.concatenate([x for x, _ in got]).astype(np.float64), lengths)
        good = np.clip(weighted_share(model.crf, x, lengths, np.concatenate([n for _, n in got])), 1e-4, 1 - 1e-4)
        out[lengths > 0] = _sigmoid(model.scale[0] + model.scale[1] * np.log(good / (1 - good)))
    return out


def score_documents(docs: DataFrame, model: LineModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row; null text scores as empty, repeated rows score alike, ids may be null.

    A text is one chain however many lines it has. Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "body"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score(model, b.column("body").to_pylist()), pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from four fifths of the labels (those whose crc32 of the id isn't 0 modulo 5)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(crc_fold("doc_id", 5) != 0)
    scored = score_documents(docs, fit(docs, labels))
    return scored.select("doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
