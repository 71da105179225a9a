import hashlib
import os

import pytest

from shardloom.llm import token_counts
from shardloom.llm.bpe import DIGESTS, decode, digests, encode_decode, joined_pieces, piece_rows, piece_table
from shardloom.llm.token_counts import byte_bpe_counter, count_tokens, tokenizer_version

from .corpus import corpus, documents, saved

P = pytest.importorskip("public_tokenizers")
Tokenizer = pytest.importorskip("tokenizers").Tokenizer


def text(x):
    return "" if x is None else x


def test_encode_decode_is_the_library(spark, tmp_path):
    rows = corpus()
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    wanted = sorted(((i is None, i or 0, e.ids, t.decode(e.ids, skip_special_tokens=False)) for i, x in rows for e in [t.encode(text(x), add_special_tokens=False)]), key=str)
    docs = saved(spark, tmp_path / "d", rows)
    out = encode_decode(docs, P.path("word_bpe_49k.json"))
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["ids"], r["decoded"]) for r in out.collect()), key=str) == wanted
    of = {r["doc_id"]: r for r in encode_decode(docs, P.path("word_bpe_49k.json"), digests, DIGESTS).collect()}
    for missing, i, ids, decoded in wanted:
        if not missing:
            assert of[i]["n_tokens"] == len(ids)
            assert of[i]["ids_sha256"] == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
            assert of[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_decode_is_a_join(spark):
    pieces = piece_table(spark, P.path("word_bpe_49k.json"))
    assert pieces.count() == 49408
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = t.encode("the cat's 12 <|endoftext|> été", add_special_tokens=False).ids
    df = spark.createDataFrame([(1, ids), (2, []), (3, None), (4, [10**6])], "doc_id long, ids array<int>")
    found = {r["doc_id"]: r["decoded"] for r in decode(df, pieces).collect()}
    assert found == {1: t.decode(ids, skip_special_tokens=False), 2: "", 3: "", 4: ""}


def test_pieces_are_joined():
    import numpy as np

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids, pieces = joined_pieces(np.array([5, 3, 5, 49407]), piece_rows(P.path("word_bpe_49k.json")))
    assert ids.tolist() == [3, 5, 49407] and pieces == [t.id_to_token(int(i)).encode() for i in ids]
    with pytest.raises(ValueError):
        joined_pieces(np.array([10**6]), piece_rows(P.path("word_bpe_49k.json")))


def test_encode_nothing(spark):
    assert encode_decode(documents(spark, []), P.path("word_bpe_49k.json")).count() == 0
    only = encode_decode(documents(spark, [(1, None), (2, "")], 1), P.path("word_bpe_49k.json")).collect()
    assert [(r["ids"], r["decoded"]) for r in only] == [([], ""), ([], "")]


def test_documents_are_put_together_in_spans(spark, tmp_path):
    """A chunk of many documents comes in parts of bounded size, and one long document alone; results are the library's."""
    import pyarrow as pa

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = [(i, " ".join(["the", "of", f"x{i}"][(i + k) % 3] for k in range(i % 900))) for i in range(700)]
    rows += [(700, ""), (701, "the " * 200_000), (702, None), (703, "end")]
    docs = saved(spark, tmp_path / "d", rows).coalesce(1)

    def handed(ids, flat, counts, decoded):
        ends, data = counts.cumsum().tolist(), flat.astype("<u4").tobytes()
        own = pa.array([data[4 * (e - c) : 4 * e] for e, c in zip(ends, counts.tolist(), strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([ids, own, *(pa.array([x] * len(counts), pa.int64()) for x in (len(flat), len(counts)))], ["doc_id", "ids", "n", "docs"])

    found = encode_decode(docs, P.path("word_bpe_49k.json"), handed, "doc_id bigint, ids binary, n bigint, docs bigint").collect()
    wanted = {i: t.encode(text(x), add_special_tokens=False).ids for i, x in rows}
    assert {r["doc_id"]: r["ids"] for r in found} == {i: b"".join(x.to_bytes(4, "little") for x in ids) for i, ids in wanted.items()} and len(found) == len(rows)
    assert max(r["n"] for r in found if r["docs"] > 1) < sum(len(w) for w in wanted.values()) / 2
    decoded = {r["doc_id"]: r["decoded"] for r in encode_decode(docs, P.path("word_bpe_49k.json")).collect()}
    assert decoded == {i: t.decode(ids, skip_special_tokens=False) for i, ids in wanted.items()}


def test_words_of_a_chunk_are_split_text_by_text(monkeypatch):
    """Splitting a chunk holds the words of one text as objects, not those of all."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    from shardloom.llm import chunks

    monkeypatch.setattr(chunks, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    run = chunks.word_chunks(SimpleNamespace(mapInArrow=lambda f, schema: f), 5)
    texts = [" ".join(f"w{(i * k) % 5000}" for k in range(500)).encode() for i in range(1000)]
    batch = pa.record_batch([pa.array(range(1000), pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "body"])
    tracemalloc.start()
    rows = [r for b in run(iter([batch])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    _, lengths, at, which = chunks.open_chunk(rows[0])
    words = {r["bucket"]: iter(chunks.words_of(r)) for r in rows[1:]}
    ranked = [next(words[b]) for b in which.tolist()]
    assert [ranked[i] for i in at.tolist()] == [w for t in texts for w in t.split()] and lengths.tolist() == [500] * 1000
    assert peak < 6 * sum(map(len, texts))


RANKS = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def test_counter_is_the_library():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    count = byte_bpe_counter(*RANKS)
    some = [text(x) for _, x in corpus()]
    if os.path.exists("/root/testdata/sf0.001/documents.parquet"):
        import pyarrow.parquet as pq

        some += [text(x) for x in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()]
    for x in some:
        assert count(x) == len(t.encode(x, add_special_tokens=False).ids), x[:80]


@pytest.mark.parametrize("few", [0, 10**6])
def test_hot_texts_and_clashing_names(spark, tmp_path, monkeypatch, few):
    """A third of the rows share a text; columns bear the names that the operator uses itself."""
    monkeypatch.setattr(token_counts, "FEW", few)
    monkeypatch.setattr(token_counts, "HOT_SHARE", 10)
    rows = [(i % 7 or None, ["one two", None, f"text {i}"][i % 3], "p", i, 5, "d", 9) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string, parts int, place int, digest string, copies int").repartition(3)
    out = count_tokens(docs, str(tmp_path / "cache"), *RANKS, "v")
    assert out.columns == ["doc_id", "text", "part", "parts", "place", "copies", "digest", "n_bytes", "n_tokens"]
    count = byte_bpe_counter(*RANKS)
    assert sorted((r["parts"], r["part"], r["n_tokens"]) for r in out.collect()) == sorted((i, "p", count(text(t))) for _, t, _, i, _, _, _ in rows)
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 32


def test_cache_is_used_and_grows(spark, tmp_path):
    rows, cache = corpus(), str(tmp_path / "cache")
    version = tokenizer_version(P.path("byte_bpe_50k.json"))
    count = byte_bpe_counter(*RANKS)
    docs = documents(spark, rows)
    half = count_tokens(documents(spark, rows[::2]), cache, *RANKS, version)
    assert half.count() == len(rows[::2])
    held = spark.read.parquet(cache).count()
    assert held == len({text(x) for _, x in rows[::2]})
    found = count_tokens(docs, cache, *RANKS, version)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in found.collect()) == sorted((str(i), len(text(x).encode()), count(text(x))) for i, x in rows)
    assert found.columns.count("digest") == 1 and spark.read.parquet(cache).count() == len({text(x) for _, x in rows})
    # What the cache holds is not encoded again: a wrong entry comes back.
    spark.createDataFrame([("v", hashlib.sha256(b"one").digest(), 77)], "tokenizer string, digest binary, n_tokens long").write.mode("append").parquet(cache)
    assert count_tokens(documents(spark, [(1, "one")]), cache, *RANKS, "v").first()["n_tokens"] == 77
    held = spark.read.parquet(cache).count()
    assert count_tokens(docs, cache, *RANKS, version).count() == len(rows) and spark.read.parquet(cache).count() == held
    assert count_tokens(documents(spark, []), cache, *RANKS, version).count() == 0
