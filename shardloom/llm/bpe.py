"""BPE encoding and decoding by a table of distinct words.

Words are what ASCII white space separates; the tokenizer never joins across it. Each distinct word of the corpus is
encoded once; ids go back to the documents by position. For decoding, the distinct ids of a chunk are joined with the
id-to-piece table, which is broadcast: it is as large as the vocabulary, whatever the corpus.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import bucket_count, in_place, open_chunk, pack, unpack, word_chunks, words_of
from .common import table, utf8

#: Words whose ids and texts are put together at once, unless one document has more.
SPAN_WORDS = 1 << 17
ENCODED = "doc_id bigint, ids array<int>, decoded string"


def piece_table(spark: SparkSession, tokenizer_file: str) -> DataFrame:
    """id, piece: one row for each entry of the vocabulary, added tokens included. Its size is the vocabulary's."""
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_file(tokenizer_file).get_vocab(with_added_tokens=True)
    return spark.createDataFrame([(i, p) for p, i in vocab.items()], "id int, piece string")


def decode(encoded: DataFrame, pieces: DataFrame, separator: str = " ", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, decoded: pieces of the ids in order, joined by the separator, by a join with the id-to-piece table.

    Null or empty ids decode to ''; an id that the table lacks is skipped. Every row needs an id of its own.
    """
    long = encoded.select(F.col(id_col).alias("doc_id"), F.posexplode_outer(ids_col).alias("at", "id")).join(F.broadcast(pieces), "id", "left")
    ordered = F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("at", "piece"))))
    return long.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), separator).alias("decoded"))


def piece_rows(tokenizer_file: str) -> pa.Table:
    """The same as an Arrow table, pieces as bytes."""
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_file(tokenizer_file).get_vocab(with_added_tokens=True)
    return pa.table({"id": pa.array(vocab.values(), pa.int64()), "piece": pa.array([p.encode() for p in vocab], pa.binary())})


@cache
def encoder(tokenizer_file: str):
    """The library's tokenizer without truncation and padding, read once in a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file)
    t.no_truncation()
    t.no_padding()
    return t


def joined_pieces(ids: np.ndarray, pieces: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """The distinct ids, rising, and their pieces, by a join; an id that the table lacks raises."""
    distinct = np.unique(ids)
    found = pa.table({"id": pa.array(distinct, pa.int64())}).join(pieces, "id", join_type="inner").sort_by("id")
    if found.num_rows != len(distinct):
        raise ValueError("an id has no piece, or several")
    return distinct, found.column("piece").to_pylist()


def full_rows(ids: pa.Array, flat: np.ndarray, counts: np.ndarray, decoded: list[bytes]) -> pa.RecordBatch:
    """doc_id, ids, decoded."""
    ends = np.r_[0, np.cumsum(counts)].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))
    return pa.RecordBatch.from_arrays([ids, lists, pa.array([d.decode() for d in decoded], pa.string())], ["doc_id", "ids", "decoded"])


def encode_decode(docs: DataFrame, tokenizer_file: str, finish: Callable = full_rows, schema: str = ENCODED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its ids without added special tokens, and the text that they decode to.

    finish makes the rows of some documents of a chunk from (doc ids, all ids in a row, ids per document, decoded texts as bytes);
    schema is theirs. Null text counts as empty and has no ids; special strings in a text are special tokens, as by
    the library's default; ids may be null or repeated, and repeated rows come out as often as they go in. An empty
    table gives an empty result. Other columns of docs are ignored. Documents must be read in the same order if an
    executor is lost, as from files; else the job fails rather than mix words up.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("body"))
    buckets = bucket_count(docs, text_col)
    # About a partition for each chunk and bucket.
    sent = word_chunks(rows, buckets).repartition(2 * buckets, "key")
    pieces = docs.sparkSession.sparkContext.broadcast(piece_rows(tokenizer_file))

    def find(rows: pa.Table) -> pa.Table:
        """Encodes the distinct words of a bucket, and gives every chunk the ids of its words, packed."""
        rows = [r for r in rows.to_pylist() if r["is_words"]]
        names, kinds = ["chunk", "bucket", "n", "ids"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        if not rows:
            return pa.table([pa.array([], t) for t in kinds], names)
        t, own = encoder(tokenizer_file), [words_of(r) for r in rows]
        distinct = list(dict.fromkeys(w for words in own for w in words))
        ids: dict[bytes, list[int]] = {}
        for at in range(0, len(distinct), 4096):
            some = distinct[at : at + 4096]
            for w, e in zip(some, t.encode_batch_fast([str(w, "utf-8", "replace") for w in some], add_special_tokens=False), strict=True):
                ids[w] = e.ids
        out = []
        for r, words in zip(rows, own, strict=True):
            found = [ids[w] for w in words]
            flat = np.array([len(f) for f in found] + [i for f in found for i in f], np.int64)
            out.append((r["chunk"], r["bucket"], len(words), pack(flat)))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    found = sent.groupBy("key").applyInArrow(find, "chunk bigint, bucket bigint, n bigint, ids binary")

    def place(own: pa.Table, found: pa.Table) -> pa.Table:
        """Puts the ids of a chunk's words in their places."""
        own = [r for r in own.to_pylist() if not r["is_words"]]
        if not own:
            return pa.table(finish(pa.array([], pa.int64()), np.empty(0, np.int64), np.empty(0, np.int64), []))
        info, lengths, at, which = open_chunk(own[0])
        order, found = in_place(which, found.to_pylist())
        flats = [unpack(r["ids"]) for r in found]
        counts, start = np.empty(len(which), np.int64), np.empty(len(which), np.int64)
        sizes = np.concatenate([f[: r["n"]] for f, r in zip(flats, found, strict=True)]) if found else np.empty(0, np.int64)
        all_ids = np.concatenate([f[r["n"] :] for f, r in zip(flats, found, strict=True)]) if found else np.empty(0, np.int64)
        counts[order], start[order] = sizes, np.cumsum(sizes) - sizes
        distinct, piece = joined_pieces(all_ids, pieces.value)
        texts, at_id = [b""] * len(which), np.searchsorted(distinct, all_ids).tolist()
        for i, s, k in zip(order.tolist(), (np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True):
            texts[i] = b" ".join([piece[x] for x in at_id[s : s + k]])
        ends = np.r_[0, np.cumsum(lengths)]
        some_empty = not counts.all()
        out, first = [], 0
        while first < len(lengths):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + SPAN_WORDS, "right")) - 1)
            here = at[ends[first] : ends[last]]
            n = counts[here]
            flat = all_ids[np.repeat(start[here] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            before = np.r_[0, np.cumsum(n)]
            ranks, local = here.tolist(), ends[first : last + 1] - ends[first]
            decoded = []
            for s, e in zip(local[:-1].tolist(), local[1:].tolist(), strict=True):
                parts = [texts[i] for i in ranks[s:e]]
                decoded.append(b" ".join([p for p in parts if p] if some_empty else parts))
            out.append(finish(info.column("doc_id").slice(first, last - first), flat, np.diff(before[local]), decoded))
            first = last
        return pa.Table.from_batches(out)

    # The rows for chunks and for buckets are one exchange, which both sides read.
    return sent.groupBy("key").cogroup(found.groupBy("chunk")).applyInArrow(place, schema)


def digests(ids: pa.Array, flat: np.ndarray, counts: np.ndarray, decoded: list[bytes]) -> pa.RecordBatch:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded text."""
    ends = np.r_[0, np.cumsum(counts)].tolist()
    data = memoryview(flat.astype("<u4").tobytes())
    of_ids = [hashlib.sha256(data[4 * s : 4 * e]).hexdigest() for s, e in zip(ends[:-1], ends[1:], strict=True)]
    return pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes all documents with word_bpe_49k."""
    import public_tokenizers as P

    return encode_decode(table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"), digests, DIGESTS)
