import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shardloom.llm import mixing, topk
from shardloom.llm.mixing import mix, mixed_documents
from shardloom.llm.topk import top_k
from shardloom.llm.warc import canonical_url, page_captures, parse_record, read_records, resolve_revisits

from .corpus import corpus, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    free, out, left = set(names), {}, float(sum(sizes.values()))
    while free:
        whole = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / whole > 3 * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / whole for s in free}
            break
        for s in over:
            out[s] = 3.0 * sizes[s]
        left -= sum(out[s] for s in over)
        free -= over
    return out


def test_mix_takes_each_budget(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    monkeypatch.setattr(mixing, "RUN", 2)
    docs = documents(spark, corpus())
    out = mix(docs).collect()
    assert len(out) == len(corpus())
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in out:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["epochs"] * r["size"] + r["part"]
    wanted = targets(sizes)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - wanted[r["source"]]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= 1
    key = lambda rows: sorted(map(str, rows))
    assert key(out) == key(mix(docs.repartition(5)).collect())
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[r["source"]] += len(WORD.findall(r["text"]))
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in taken.items() if n}


def test_mix_of_little(spark):
    assert mix(documents(spark, [])).count() == 0 and mixed_documents(documents(spark, [])).count() == 0
    assert [r["taken"] for r in mix(documents(spark, [(1, None), (2, "")])).collect()] == [0, 0]


def test_mix_with_clashing_names(spark):
    """Columns bear names that the operator uses itself; rows that differ only there are rows of their own."""
    rows = [(i % 4, f"a b c {i % 3}", "st"[i % 2], f"d{i}", "r", i, [i], "w") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, doc string, row string, whole int, parts array<int>, words string")
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    found = out.collect()
    assert {r["doc"]: (r["doc_id"], r["whole"], r["parts"], r["words"]) for r in found}.items() <= {r[3]: (r[0], r[5], r[6], r[7]) for r in rows}.items()
    assert sum(len(r["text"].split()) for r in found) == sum(r["taken"] for r in mix(docs).collect())


def brute_top(rows, k, scale=256):
    import math

    fine = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in reversed(fine) if i % 5 == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q and len(w) == len(v))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e5, 3e6])
def test_top_k(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "ROW_BLOCK", 9)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    r = random.Random(5)
    rows = [(i, [r.choice([-1.0, -0.5, 0.25, 0.5, r.uniform(-1, 1)]) * scale for _ in range(6)]) for i in range(80)]
    rows += [(80, None), (None, [1.0] * 6), (85, [None] + [1.0] * 5), (90, [float("nan")] * 6), (95, [float("inf")] + [0.0] * 5), (100, [1.0, 2.0]), (105, []), (110, []), (33, rows[33][1]), (20, rows[20][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found = sorted(tuple(x) for x in top_k(df, F.col("vec_id") % 5 == 0, 5).select("query_id", "rank", "vec_id", "score").collect())
    assert found == brute_top(rows, 5)
    assert sorted(tuple(x) for x in top_k(df, F.col("vec_id") % 5 == 0, 3, 100.0).collect()) == brute_top(rows, 3, 100)
    assert top_k(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def record(kind, i, url, at, status, fields, body=b""):
    http = b"HTTP/1.1 %d X\r\n" % status + b"".join(f"{n}: {v}\r\n".encode() for n, v in fields) + b"\r\n" + body
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{i}>\r\nWARC-Target-URI: {url}\r\nWARC-Date: 2024-01-01T00:{at // 60:02d}:{at % 60:02d}Z\r\nContent-Length: {len(http)}\r\n\r\n"
    return head.encode() + http + b"\r\n\r\n"


def test_revisits(spark):
    u, tag = "https://www.A.example/p/", ("ETag", '"x"')
    raw = [
        record("response", "r1", u, 10, 200, [tag, ("Date", "1"), ("Content-Type", "t"), ("Content-Length", "3")], b"abc"),
        record("revisit", "v1", "http://a.example/p#f", 20, 304, [("etag", 'W/"x"'), ("Date", "2"), ("Server", "no"), ("Content-Length", "0")]),
        record("revisit", "v2", u, 10, 304, [tag]),
        record("response", "r2", u, 30, 200, [("ETag", '"y"')], b"new"),
        record("revisit", "v3", u, 40, 304, [tag]),
        record("revisit", "v4", u, 40, 304, [("Last-Modified", "q")]),
        record("revisit", "v5", u, 40, 304, []),
        record("response", "v6", u, 41, 304, [("ETag", '"y"')]),
        record("revisit", "v7", "https://b.example/", 50, 304, [tag]),
        record("request", "q1", u, 5, 0, []),
        record("revisit", "v8", "not a url", 50, 304, [tag]),
        b"", b"junk", None,
    ]
    raw += [record("response", f"h{i}", "https://hot.example/", i, 200, [("ETag", f'"{i}"')], b"%d" % i) for i in range(0, 40, 4)]
    raw += [record("revisit", f"w{i}", "https://hot.example/", i, 304, [("ETag", f'"{(i - 1) // 4 * 4}"')]) for i in range(1, 40)]
    df = read_records(spark.createDataFrame([(x,) for x in raw], "data binary").repartition(3))
    out = resolve_revisits(df).collect()
    assert len(out) == len(raw)
    by = {r["record_id"]: r for r in out}
    got = {i: (by[f"<{i}>"]["outcome"], by[f"<{i}>"]["refers_to"]) for i in ("r1", "v1", "v2", "v3", "v4", "v5", "v6", "v7", "v8", "q1")}
    assert got == {
        "r1": ("full", None), "v1": ("resolved", "<r1>"), "v2": ("missing", None), "v3": ("mismatch", "<r2>"), "v4": ("mismatch", "<r2>"),
        "v5": ("unvalidated", "<r2>"), "v6": ("resolved", "<r2>"), "v7": ("missing", None), "v8": ("missing", None), "q1": ("other", None),
    }
    v1 = by["<v1>"]
    assert v1["status"] == 200 and v1["n_bytes"] == 3 and v1["digest"] == by["<r1>"]["digest"]
    assert {f["name"]: f["value"] for f in v1["fields"]} == {"etag": 'W/"x"', "date": "2", "content-type": "t", "content-length": "3"}
    for i in range(1, 40):
        assert by[f"<w{i}>"]["refers_to"] == f"<h{(i - 1) // 4 * 4}>" and by[f"<w{i}>"]["outcome"] == "resolved"
    assert resolve_revisits(df.limit(0)).count() == 0


def test_records_without_ids(spark):
    """Records that share an id, or have none, at one second of two URLs each get their own URL's response."""
    name = "struct<name:string,value:string>"
    etag = [("ETag", '"x"')]
    rows = [("r1" if i % 2 else None, "response", f"https://{h}.example/", at, 200, etag, n, f"{h}{at}", "extra") for i, (h, at, n) in enumerate([("a", 1, 5), ("b", 1, 7), ("b", 2, 8), ("b", 10**9, 9)])]
    rows += [(None, "revisit", f"https://{h}.example/", 3, 304, etag, 0, "", "extra") for h in "aabc"] + [("v", "revisit", f"https://{h}.example/", 3, 304, etag, 0, "", "extra") for h in "ab"]
    df = spark.createDataFrame(rows, f"record_id string, kind string, url string, at long, status int, fields array<{name}>, n_bytes long, digest string, canonical string")
    found = sorted((str(r["record_id"]), r["canonical"], r["outcome"], r["n_bytes"], r["digest"]) for r in resolve_revisits(df).collect() if r["kind"] == "revisit")
    assert found == sorted([("None", "a.example", "resolved", 5, "a1")] * 2 + [("None", "b.example", "resolved", 8, "b2"), ("None", "c.example", "missing", 0, ""), ("v", "a.example", "resolved", 5, "a1"), ("v", "b.example", "resolved", 8, "b2")])


def test_urls(spark):
    given = ["HTTP://WWW.Example.com:80/a/?b=2&utm_source=x&a=1#f", "https://example.com", "https://example.com/?fbclid=1", "no", None, "", "http://x/a?"]
    found = [r["c"] for r in spark.createDataFrame([(i, u) for i, u in enumerate(given)], "i int, u string").orderBy("i").select(canonical_url("u").alias("c")).collect()]
    assert found == ["example.com/a?a=1&b=2", "example.com", "example.com", None, None, None, "x/a"]


def test_records_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://x/", "<p>é</p>"), (2, None, None)], "page_id long, url string, html string")
    rows = read_records(page_captures(pages)).collect()
    assert sorted(r["kind"] for r in rows) == ["response", "response", "revisit", "revisit"] and {r["n_bytes"] for r in rows} == {0, len("<p>é</p>".encode())}
    assert parse_record(b"WARC/1.0\r\nWARC-Date: 2024-13-01T00:00:00Z\r\nContent-Length: x\r\n\r\n")["at"] is None
