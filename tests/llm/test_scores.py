import math
import random
import re
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest

from shardloom.llm.common import crc_fold
from shardloom.llm import quality_classifier
from shardloom.llm.crf import Crf, forward_backward, train, viterbi
from shardloom.llm.lm import Lattice, pieces_of, score_documents
from shardloom.llm.quality_classifier import LineModel, fit, labelled_sample, score, score_documents as quality_of
from shardloom.llm.lines import OWN, lines_of, with_neighbours
from shardloom.llm.quality_rules import apply_rules, measure

from .corpus import corpus, documents, saved, texts

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shares(word, pieces, by_byte, logs):
    """(sum over all segmentations, expected counts of their pieces), by recursion over the rest of the word."""
    s = "▁" + word
    fits = lambda i, p: "▁" not in p if i else p[0] == "▁" and "▁" not in p[1:]

    @cache
    def rest(i):
        if i == len(s):
            return 1.0, Counter()
        ways = [((pieces[s[i:j]],), j) for j in range(i + 1, min(len(s), i + 20) + 1) if s[i:j] in pieces and fits(i, s[i:j])]
        if s[i] not in pieces or not fits(i, s[i]):
            ways.append((tuple(by_byte[b] for b in s[i].encode()), i + 1))
        total, counts = 0.0, Counter()
        for ids, j in ways:
            x = math.exp(sum(logs[k] for k in ids))
            after, inner = rest(j)
            total += x * after
            for k, n in inner.items():
                counts[k] += x * n
            for k in ids:
                counts[k] += x * after
        return total, counts

    whole, counts = rest(0)
    return whole, Counter({i: n / whole for i, n in counts.items()})


def test_lattice_sums_all_segmentations():
    some = {"▁": 0.1, "a": 0.05, "b": 0.1, "ab": 0.2, "▁a": 0.1, "ba": 0.04, "▁abab": 0.01, "bab": 0.03, "▁▁": 0.1, "a▁": 0.1}
    by_byte = {b: 100 + b for b in range(256)}
    pieces = {p: i for i, p in enumerate(some)}
    logs = {i: math.log(some[p]) for p, i in pieces.items()} | {i: math.log(0.001) for i in by_byte.values()}
    for known in (pieces, {p: i for p, i in pieces.items() if p != "▁"}):
        lattice = Lattice(known, by_byte, logs)
        for w in ("a", "ab", "abab", "babab", "aéb", "z", "😀", "▁a", "a▁b", "▁"):
            whole, counts = shares(w, known, by_byte, logs)
            assert math.isclose(lattice.score(w), math.log(whole), rel_tol=1e-12)
            into = [0.0] * 400
            lattice.expect(w, 3, into)
            assert all(math.isclose(x, 3 * counts[i], abs_tol=1e-12) for i, x in enumerate(into))
    assert math.isfinite(lattice.score("ab" * 50_000))
    into = [0.0] * 400
    lattice.expect("ab" * 20_000, 2, into)
    assert math.isclose(sum(x * len(p.replace("▁", "")) for p, x in zip(some, into)), 2 * 40_000, rel_tol=1e-6)


def test_language_model_scores(spark, tmp_path):
    rows = corpus()
    trains = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0
    tokens = [[*WORD.findall(lower(t)), None] for _, t in rows]
    counts = Counter(w for (i, _), ws in zip(rows, tokens, strict=True) if trains(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    pieces, by_byte, first = pieces_of(P.path("piece_bpe_32k.model"))
    assert math.isclose(sum(map(math.exp, first.values())), 1, rel_tol=1e-9) and set(first) == {*pieces.values(), *by_byte.values()}
    used = Counter()
    for w, c in counts.items():
        if w is not None:
            for i, x in shares(w, pieces, by_byte, first)[1].items():
                used[i] += c * x
    drawn = math.log(sum(used.values()) + counts[None] + 0.1 * (len(first) + 1))
    logs = {i: math.log(used[i] + 0.1) - drawn for i in first}
    of_word = {w: math.log(shares(w, pieces, by_byte, logs)[0]) for w in {w for ws in tokens for w in ws if w is not None}} | {None: math.log(counts[None] + 0.1) - drawn}
    wanted = []
    for (i, _), ws in zip(rows, tokens, strict=True):
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        wanted.append((str(i), not trains(i), len(ws), sum(counts[w] > 0 for w in ws), n, base, sum(of_word[w] for w in ws) / math.log(10)))
    docs = saved(spark, tmp_path / "d", rows)
    found = score_documents(docs, crc_fold("doc_id", 10) != 0, P.path("piece_bpe_32k.model")).collect()
    found = sorted((str(r["doc_id"]), *[r[c] for c in ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")]) for r in found)
    assert len(found) == len(wanted)
    for a, b in zip(found, sorted(wanted), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-5)


def test_language_model_without_documents(spark):
    from pyspark.sql import functions as F

    assert score_documents(documents(spark, []), F.lit(True), P.path("piece_bpe_32k.model")).count() == 0
    blank = score_documents(documents(spark, [(1, None), (2, " ")], 1), F.lit(True), P.path("piece_bpe_32k.model")).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in blank] == [(1, 1, 2)] * 2
    one = score_documents(documents(spark, [(1, "a b")], 1), F.lit(False), P.path("piece_bpe_32k.model")).first()
    assert one["train_tokens"] == 0 and one["n_known"] == 0 and math.isfinite(one["score"]) and one["score"] < 0


def paths(crf, x):
    import itertools

    for labels in itertools.product((0, 1), repeat=len(x)):
        s = sum(x[t] @ crf.emit[:, y] for t, y in enumerate(labels)) + sum(crf.step[a, b] for a, b in zip(labels, labels[1:]))
        yield labels, s


def test_crf_against_all_paths():
    r = np.random.default_rng(2)
    crf = Crf(r.normal(size=(3, 2)), r.normal(size=(2, 2)))
    lengths = np.array([4, 1, 0, 6, 2])
    x = r.normal(size=(lengths.sum(), 3))
    p, steps, norm = forward_backward(crf, x, lengths)
    best = viterbi(crf, x, lengths)
    at, total, wanted_steps = 0, 0.0, np.zeros((2, 2))
    for n in lengths:
        if n:
            own = list(paths(crf, x[at : at + n]))
            z = math.log(sum(math.exp(s) for _, s in own))
            total += z
            for t in range(n):
                assert math.isclose(p[at + t, 1], sum(math.exp(s - z) for y, s in own if y[t]), rel_tol=1e-9)
            for y, s in own:
                for a, b in zip(y, y[1:]):
                    wanted_steps[a, b] += math.exp(s - z)
            assert tuple(best[at : at + n]) == max(own, key=lambda o: o[1])[0]
        at += n
    assert math.isclose(total, norm, rel_tol=1e-9) and np.allclose(steps, wanted_steps)


def test_crf_learns_runs():
    r = np.random.default_rng(3)
    labels = np.concatenate([np.repeat([0, 1, 0], [5, 10, 5]) for _ in range(40)])
    x = np.stack([np.ones(len(labels)), labels + r.normal(0, 0.8, len(labels))], 1)
    lengths = np.full(40, 20)
    crf = train(x, lengths, labels, np.ones(len(labels)))
    assert (viterbi(crf, x, lengths) == labels).mean() > ((x[:, 1] > 0.5) == labels).mean() + 0.05


def junk(seed):
    r = random.Random(seed)
    good, words = texts(1, seed)
    kind = seed % 3
    line = " | ".join(r.choice(words) for _ in range(20)) if kind == 0 else " ".join(r.choice(words).upper() + "!!" for _ in range(20)) if kind == 1 else " ".join(r.choice(words) + r.choice(["###", "%%%"]) for _ in range(20))
    return good[0][:30] + "\n" + line + "\n" + line


def test_quality_on_held_out_documents(spark):
    rows = [(i, texts(1, i)[0][0] if i % 4 else junk(i)) for i in range(400)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(300)] + [(7, None), (None, 1)], "doc_id long, quality int")
    model = fit(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in quality_of(docs, model).collect()}
    assert sum((scores[i] >= 0.3) == (i % 4 > 0) for i in range(300, 400)) >= 97
    odd = quality_of(documents(spark, corpus()), model).collect()
    assert len(odd) == len(corpus()) and all(0 <= r["score"] <= 1 for r in odd)
    assert quality_of(documents(spark, []), model).count() == 0
    flat = fit(docs, labels.where("quality = 1"))
    assert all(math.isfinite(r["score"]) for r in quality_of(docs, flat).collect())
    kept = {r["doc_id"]: r["kept"] for r in apply_rules(docs, model).collect()}
    assert sum(kept[i] for i in range(400) if i % 4 == 0) <= 3
    assert sum(not kept[i] for i in range(400) if i % 4 and len(rows[i][1].split()) >= 20) <= 3


def brute_counts(t):
    t = t or ""
    w, lines, seen, dup = WORD.findall(t), t.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    where = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if where[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def test_rules_count(spark):
    rows = corpus()
    docs = documents(spark, rows)
    model = fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    out = apply_rules(docs, model)
    found = sorted(str((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])) for r in out.collect())
    wanted = []
    for i, t in rows:
        c = brute_counts(t)
        wanted.append(str((i, *c, c[0] < 20 or 100 * c[4] > 30 * c[0])))
    assert found == sorted(wanted)
    assert not out.where("kept and base_failed").count() and set(docs.columns) <= set(out.columns)
    assert apply_rules(documents(spark, []), model).count() == 0


def test_long_texts_are_one_chain():
    """Strong steps carry the first line's label past any number of lines; a cut would lose it."""
    text = ("Good words end. " * 3 + "\n" + "12 34 ## 56\n" * 1300).encode()
    x, n = lines_of(text)
    r = np.random.default_rng(5)
    crf = Crf(r.normal(size=(3 * len(OWN), 2)), np.array([[0.0, -9.0], [-9.0, 0.0]]))
    rows, whole = with_neighbours(x.astype(np.float64), np.array([len(n)])), np.array([len(n)])
    cut = np.array([512, 512, len(n) - 1024])
    assert len(n) > 1200 and not np.allclose(forward_backward(crf, rows, cut)[0], forward_backward(crf, rows, whole)[0], atol=1e-12)
    share = (forward_backward(crf, rows, whole)[0][:, 1] * n).sum() / n.sum()
    good = np.clip(share, 1e-4, 1 - 1e-4)
    assert np.isclose(score(LineModel(crf, np.array([0.0, 1.0]), 0.5), [text])[0], good, rtol=1e-9, atol=0)
    # Labels of the last block hang on its own start if the chain is cut there.
    swing = np.r_[3.0, np.zeros(len(n) - 1)]
    held = Crf(np.array([[0.0, 1.0]]), np.array([[1.0, 0.0], [0.0, 1.0]]))
    assert viterbi(held, swing[:, None], whole).sum() == len(n) and viterbi(held, swing[:, None], cut).sum() == 512
    steady = Crf(np.zeros((3 * len(OWN), 2)), np.array([[1.0, 0.0], [0.0, 1.0]]))
    steady.emit[OWN.index("stop")] = [0.0, 3.0]
    assert measure(LineModel(steady, np.zeros(2), 0.5), [text])[5][0] == n.sum()


def test_rules_with_clashing_names(spark):
    """Columns bear names that the operator uses itself, or gives."""
    flat = LineModel(Crf(np.zeros((3 * len(OWN), 2)), np.zeros((2, 2))), np.zeros(2), 0.5)
    docs = spark.createDataFrame([(1, "a b " * 30, "p", "q", 7), (2, None, "p", "q", 7)], "doc_id long, text string, body string, row string, n_words int")
    out = apply_rules(docs, flat)
    assert out.columns[:4] == ["doc_id", "text", "body", "row"] and sorted((r["doc_id"], r["n_words"], r["body"], r["row"]) for r in out.collect()) == [(1, 60, "p", "q"), (2, 0, "p", "q")]
    assert apply_rules(docs.limit(0), flat).count() == 0


def test_sample_is_bounded_in_rows(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(200)] + [(2, "good"), (3, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    assert len(labelled_sample(docs, labels, "quality", 2)) == 2 and len(labelled_sample(docs, labels, "quality", 9)) == 3


def brute_marginals(crf, x):
    """Viterbi labels and marginals of label 1 by plain recursion over one chain, in Python floats."""
    score = [[float(v) for v in row] for row in x @ crf.emit]
    step = crf.step.tolist()
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    ahead, best, come = [score[0]], [score[0]], []
    for s in score[1:]:
        a, m = ahead[-1], best[-1]
        ahead.append([s[y] + add(a[0] + step[0][y], a[1] + step[1][y]) for y in (0, 1)])
        come.append([0 if m[0] + step[0][y] >= m[1] + step[1][y] else 1 for y in (0, 1)])
        best.append([s[y] + max(m[0] + step[0][y], m[1] + step[1][y]) for y in (0, 1)])
    back = [[0.0, 0.0]]
    for s in reversed(score[1:]):
        b = back[-1]
        back.append([add(step[y][0] + s[0] + b[0], step[y][1] + s[1] + b[1]) for y in (0, 1)])
    back.reverse()
    labels = [0 if best[-1][0] >= best[-1][1] else 1]
    for c in reversed(come):
        labels.append(c[labels[-1]])
    whole = add(*ahead[-1])
    return labels[::-1], [math.exp(a[1] + b[1] - whole) for a, b in zip(ahead, back, strict=True)]


@pytest.mark.parametrize("n", [600, 5000])
def test_scores_and_rules_against_brute_force(spark, n):
    """kept and score of texts with few and with very many lines, by a model with real weights and strong steps."""
    r = np.random.default_rng(n)
    model = LineModel(Crf(r.normal(scale=0.4, size=(3 * len(OWN), 2)), np.array([[1.5, -0.5], [-0.5, 1.0]])), np.array([0.2, 0.7]), 0.25)
    lines = texts(400, 5)[0]
    some = random.Random(n)
    long = "\n".join(some.choice(lines).split("\n")[0] if some.random() < 0.6 else "| x | # | !!" for _ in range(n))
    every = [long, *lines[:25], "", "# | # |"]
    docs = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    ruled = {x["doc_id"]: x for x in apply_rules(docs, model).collect()}
    scored = {x["doc_id"]: x["score"] for x in quality_of(docs, model).collect()}
    for i, t in enumerate(every):
        own, sizes = lines_of(t.encode())
        if not len(sizes):
            assert scored[i] == 0.25 and not ruled[i]["kept"]
            continue
        labels, good = brute_marginals(model.crf, with_neighbours(own.astype(np.float64), np.array([len(sizes)])))
        share = min(max(float(np.dot(good, sizes)) / sizes.sum(), 1e-4), 1 - 1e-4)
        assert math.isclose(scored[i], 1 / (1 + math.exp(-(0.2 + 0.7 * math.log(share / (1 - share))))), rel_tol=1e-9)
        content = int(np.dot(labels, sizes))
        assert ruled[i]["content_words"] == content and ruled[i]["kept"] == (not ruled[i]["base_failed"] and 2 * content >= sizes.sum())


def test_sampled_documents_are_whole(spark, monkeypatch):
    texts_of = {i: "\n".join(f"line {j} of {i}" for j in range(n)) for i, n in enumerate([100, 7, 61, 0, 300])}
    docs = documents(spark, list(texts_of.items())).select("doc_id", "text")
    labels = spark.createDataFrame([(i, i % 2) for i in texts_of], "doc_id long, quality int")
    sample = labelled_sample(docs, labels, "quality")
    assert [len(n) for _, n, _ in sample] == [len(x) for x, _, _ in sample] == [100, 7, 61, 0, 300] and [y for _, _, y in sample] == [0, 1, 0, 1, 0]
    monkeypatch.setattr(quality_classifier, "SAMPLE_LINES", 1)
    assert 0 < len(few := labelled_sample(docs, labels, "quality")) < 5 and all(len(n) in (100, 7, 61, 0, 300) for _, n, _ in few)
