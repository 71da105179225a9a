"""Chunks of documents and the exchange of values for their distinct words.

A chunk is a few MB of neighbouring documents. It is written as one row that holds, compressed, its documents' words
as numbers into the chunk's distinct words, and as one row for each bucket of words with the distinct words of that
bucket. Buckets are grouped, so that each distinct word of the corpus is worked on once; what is found for a word
goes back to the chunks as one packed row for each chunk and bucket, and is put in place by position there.

So a word of the corpus is sent once for each chunk that has it, not once for each place; a frequent word is a row
entry for each chunk, never a hot key; and a worker holds one chunk, or one bucket, at a time. The number of buckets
grows with the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Bytes of text for which there is one bucket of words.
BUCKET_BYTES = 6 << 20
#: Rows of both kinds: key is the chunk or the bucket the row is for.
CHUNK_FIELDS = "key bigint, is_words boolean, chunk bigint, bucket bigint, n bigint, a binary, b binary, c binary"
#: Names of the same.
CHUNK_NAMES = ["key", "is_words", "chunk", "bucket", "n", "a", "b", "c"]


class Numbers(dict):
    """Numbers words in the order they are first looked up."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack(x: np.ndarray) -> bytes:
    """An array of whole numbers, its bytes by place, compressed."""
    x = np.asarray(x)
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(x) or 0 <= x.min() and int(x.max()) < 1 << (8 * w))
    x = np.ascontiguousarray(x, f"<u{width}" if width < 8 else "<i8")
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + squeeze(planes.tobytes())


def unpack(data: bytes, kind: type = np.int64) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(unsqueeze(data[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}" if width < 8 else "<i8").ravel().astype(kind)


def pack_floats(x: np.ndarray) -> bytes:
    return squeeze(np.ascontiguousarray(x, "<f8").tobytes())


def unpack_floats(data: bytes) -> np.ndarray:
    return np.frombuffer(unsqueeze(data), "<f8")


def bucket_count(docs: DataFrame, text_col: str) -> int:
    """Buckets of words for these documents: by their bytes alone, so work doesn't grow with the number of partitions."""
    size = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    return max(1, -(-size // BUCKET_BYTES))


def word_chunks(docs: DataFrame, buckets: int, change: Callable[[bytes], bytes] | None = None, counted: str | None = None) -> DataFrame:
    """The rows of both kinds for docs(doc_id, body binary), words being split at ASCII white space.

    A chunk's own row: n documents, a ids and the numbers of words, b the words by rank, c the rank's bucket.
    A row of words: n words, a the words by rank, b how often documents have them for which the boolean column
    `counted` holds (if there is one). Chunks are numbered by input partition and place in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "body"):
            number += 1
            # One text's words at a time: those of a chunk as objects take many times its bytes.
            place, lengths, parts = Numbers(), np.empty(batch.num_rows, np.int64), []
            for i, t in enumerate(batch.column("body")):
                own = (change(t.as_py()) if change else t.as_py()).split()
                lengths[i] = len(own)
                parts.append(np.fromiter(map(place.__getitem__, own), np.int32, len(own)))
            own, at, parts = None, np.concatenate(parts), None
            words, place = list(place), None
            times = np.bincount(at, minlength=len(words))
            order = np.argsort(-times, kind="stable")
            rank = np.empty(len(words), np.int32)
            rank[order] = np.arange(len(words))
            at = rank[at]
            words = [words[i] for i in order.tolist()]
            which = (np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % buckets).astype(np.int32)
            ids = batch.column("doc_id")
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([batch.schema.field("doc_id"), ("counted", pa.bool_())])) as w:
                flags = batch.column(counted) if counted else pa.array([True] * len(lengths))
                w.write_batch(pa.RecordBatch.from_arrays([ids, flags], ["doc_id", "counted"]))
            rows = [(number, False, number, -1, len(lengths), squeeze(sink.getvalue().to_pybytes()), pack(lengths), pack(np.concatenate([at, which])))]
            if counted:
                of = np.repeat(np.array(flags), lengths)
                seen = np.bincount(at[of], minlength=len(words))
            by = np.argsort(which, kind="stable")
            starts = np.flatnonzero(np.r_[True, which[by][1:] != which[by][:-1]][: len(by)])
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(by)], strict=False):
                own = by[s:e]
                bucket = int(which[own[0]])
                rows.append((~bucket, True, number, bucket, len(own), squeeze(b"\n".join([words[i] for i in own.tolist()])), pack(seen[own]) if counted else b"", b""))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()], strict=True)], CHUNK_NAMES)

    return docs.mapInArrow(run, CHUNK_FIELDS)


def open_chunk(row: dict) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]:
    """(ids and flags, words per document, ranks of the words in order, bucket of each rank)."""
    with pa.ipc.open_stream(unsqueeze(row["a"])) as r:
        ids = r.read_all().combine_chunks().to_batches()[0]
    lengths = unpack(row["b"])
    both, total = unpack(row["c"], np.int32), int(lengths.sum())
    return ids, lengths, both[:total], both[total:]


def words_of(row: dict) -> list[bytes]:
    return unsqueeze(row["a"]).split(b"\n")


def in_place(which: np.ndarray, found: list[dict], buckets: str = "bucket") -> tuple[np.ndarray, list[dict]]:
    """(ranks in the order of the found rows' entries, the rows by bucket); an entry is missing if any row is."""
    found = sorted(found, key=lambda r: r[buckets])
    if sum(r["n"] for r in found) != len(which) or [r[buckets] for r in found] != np.unique(which).tolist():
        raise RuntimeError("a chunk's words and the values found for them don't match; its documents were read in another order the second time")
    return np.argsort(which, kind="stable"), found
