import random
import re
from collections import defaultdict

import numpy as np
import pytest

from shardloom.llm import neardup, suffixes
from shardloom.llm.neardup import near_duplicates, shingles, signatures
from shardloom.llm.suffixes import repeats, without

from .corpus import corpus, documents, saved, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(t):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows, threshold):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(i)
    out = []
    for group in members.values():
        least = min((rows[i][0] for i in group if rows[i][0] is not None), default=None)
        out += [(rows[i][0], len(sets[i]), least) for i in group]
    return sorted(out, key=str)


def family(seed, n):
    """Variants of one text, most of them near the threshold of one another."""
    r = random.Random(seed)
    words = texts(1, seed, 400)[0][0].split()
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(r.randint(0, max(2, len(w) // 40))):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("threshold", [80, 85])
def test_near_duplicates(spark, threshold):
    rows = corpus()
    rows += [(1000 + i, t) for i, t in enumerate(family(3, 40) + family(4, 25))]
    found = near_duplicates(documents(spark, rows), threshold).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str) == brute_components(rows, threshold)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)
    monkeypatch.setattr(neardup, "GROUP", 3)
    rows = [(i, t) for i, t in enumerate(family(8, 60))]
    found = near_duplicates(documents(spark, rows), 85).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str) == brute_components(rows, 85)


def test_chains_of_three(spark):
    """Many chains a-b-c whose links are exactly at the threshold: a and c hold the first and the last 80 percent of b's shingles."""
    rows = []
    for i in range(300):
        w = [f"c{i}w{j}" for j in range(204)]
        rows += [(3 * i, " ".join(w)), (3 * i + 1, " ".join(w[:164])), (3 * i + 2, " ".join(w[40:]))]
    found = near_duplicates(documents(spark, rows), 80).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(i, i - i % 3) for i in range(900)]


def test_no_documents(spark):
    assert near_duplicates(documents(spark, []), 80).count() == 0
    assert [r["component_id"] for r in near_duplicates(documents(spark, [(3, None), (2, "")]), 80).orderBy("doc_id").collect()] == [2, 3]


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    for n in (1, 3, 20, 400, 5000):
        a = r.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[: max(1, int(0.85 * n))], r.integers(0, 2**63, n - max(1, int(0.85 * n))).astype(np.uint64)])
        sig = signatures(np.concatenate([a, b]), np.array([n, n]), 180)
        same = len(np.intersect1d(a, b))
        assert abs((sig[0] == sig[1]).mean() - same / (2 * n - same)) < 0.2
    assert (signatures(np.empty(0, np.uint64), np.array([0]), 12) == np.iinfo(np.uint64).max).all()


def test_slack_of_signatures():
    """Pairs at the threshold, from the smallest sets that can be there, agree far more than the slack lets pass."""
    r = np.random.default_rng(2)
    bins = neardup.BANDS * neardup.ROWS
    for n, same in [(5, 4), (7, 6), (10, 8), (20, 17), (100, 85), (180, 160), (1000, 890), (4000, 3560)]:
        pairs = []
        for _ in range(400):
            a = r.integers(0, 2**63, 2 * n - same).astype(np.uint64)
            pairs += [a[:n], a[n - same :]] if same / (2 * n - same) >= 0.8 else [a[:n], a[:same]]
        sig = signatures(np.concatenate(pairs), np.array([len(p) for p in pairs]), bins) & np.uint64(255)
        agree = (sig[::2] == sig[1::2]).mean(1)
        assert agree.min() > 0.8 - neardup.SLACK + 0.03, (n, agree.min())


def test_shingles_are_sets_of_lower_cased_words():
    h, n = shingles([b"A b c d e f", b"a B c d e f", b"a b", b"A  B", b"b a", b"", b"x x x x x x x"])
    parts = np.split(h, np.cumsum(n)[:-1])
    assert n.tolist() == [2, 2, 1, 1, 1, 0, 1]
    assert (parts[0] == parts[1]).all() and parts[2] == parts[3] and parts[2] != parts[4]


def brute_repeats(rows, least):
    occurrences, words = defaultdict(list), []
    for n, (i, t) in enumerate(rows):
        w = (t or "").encode().split()
        words.append(w)
        order = 2**63 - 1 if i is None else i
        for j in range(len(w) - least + 1):
            occurrences[tuple(w[j : j + least])].append((order, n, j))
    rep, gone = ([set() for _ in rows] for _ in range(2))
    for found in occurrences.values():
        if len(found) > 1:
            low = min(o for o, _, _ in found)
            first = {}
            for o, n, j in sorted(found):
                rep[n].update(range(j, j + least))
                if o > low or n in first:
                    gone[n].update(range(j, j + least))
                first.setdefault(n, j)
    return sorted(((str(rows[n][0]), len(words[n]), sorted(rep[n]), sorted(gone[n])) for n in range(len(rows))), key=str)


@pytest.mark.parametrize("least, span, hot", [(50, 20, 10_000), (12, 4, 10_000), (12, 4, 2), (50, 20, 1)])
def test_repeats(spark, tmp_path, monkeypatch, least, span, hot):
    """Also with spans that are dealt to several buckets, as those with many occurrences are."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    rows = corpus()
    found = repeats(saved(spark, tmp_path / "d", rows), least, span).collect()
    spread = lambda spans: [i for s in spans for i in range(s["first"], s["end"])]
    assert sorted(((str(r["doc_id"]), r["n_words"], spread(r["repeated"]), spread(r["removed"])) for r in found), key=str) == brute_repeats(rows, least)
    assert all(r["n_repeated"] == len(spread(r["repeated"])) and r["n_removed"] == len(spread(r["removed"])) for r in found)


def test_neighbours_of_sorted_rows():
    r = np.random.default_rng(1)
    rows = r.integers(0, 3, (200, 6)).astype(np.int32)
    order, shared = suffixes._rows_sorted(rows)
    for depth in range(7):
        of = suffixes._classes(order, shared, depth)
        assert all((of[i] == of[j]) == (rows[i, :depth] == rows[j, :depth]).all() for i in range(0, 200, 7) for j in range(200))
    assert [len(x) for x in suffixes._rows_sorted(np.empty((0, 5), np.int32))] == [0, 0]
    x = r.integers(0, 9, 100).astype(np.uint64)
    assert all(suffixes._first_least(x, w).tolist() == [i + int(x[i : i + w].argmin()) for i in range(101 - w)] for w in (1, 2, 3, 31))


def test_cut_removes_all_but_one_copy(spark, tmp_path):
    rows = [(i, t) for i, t in corpus() if i is not None and i != 20]
    docs = saved(spark, tmp_path / "d", rows).drop("n_words")
    cut = repeats(docs, cut=True)
    assert cut.columns[: len(docs.columns)] == docs.columns
    after = [(r["doc_id"], r["text"]) for r in cut.collect()]
    before = {w for _, t in rows for w in windows_of(t)}
    left = defaultdict(int)
    for _, t in after:
        for w in windows_of(t):
            left[w] += 1
    assert len(after) == len(rows) and sum(n > 1 and w in before for w, n in left.items()) == 0
    same = {i: t for i, t in rows}
    clean = {int(i) for i, _, _, gone in brute_repeats(rows, 50) if not gone}
    assert clean and all((t or "") == (same[i] or "") for i, t in after if i in clean)


def test_repeats_with_clashing_names(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(2, passage + " two", "r", 7, "o"), (1, "one " + passage, "r", 8, "o"), (None, None, "r", 9, None)], "doc_id long, text string, row string, body int, order string")
    cut = {r["doc_id"]: r for r in repeats(docs, cut=True).collect()}
    assert list(cut[1].asDict())[:5] == docs.columns
    assert (cut[1]["text"], cut[1]["body"], cut[1]["order"], cut[1]["n_removed"], cut[1]["n_repeated"]) == ("one " + passage, 8, "o", 0, 60)
    assert (cut[2]["text"], cut[2]["kept_in"], cut[2]["n_removed"]) == ("two", [1], 60) and (cut[None]["text"], cut[None]["row"], cut[None]["order"]) == ("", "r", None)


def windows_of(t):
    w = (t or "").split()
    return [tuple(w[j : j + 50]) for j in range(len(w) - 49)]


def test_no_repeats(spark):
    assert repeats(documents(spark, [])).count() == 0
    few = [(1, None), (2, ""), (3, "a few words")]
    for cut in (False, True):
        assert [(r["doc_id"], r["n_words"], r["n_repeated"], r["kept_in"]) for r in repeats(documents(spark, few, 1).drop("n_words"), cut=cut).orderBy("doc_id").collect()] == [(1, 0, 0, []), (2, 0, 0, []), (3, 3, 0, [])]
    assert without(b" a  b\tc d", [(1, 3)]) == b" a d" and without(b"a b c", [(0, 3)]) == b"" and without(b"a b c", [(0, 1), (2, 3)]) == b"b" and without(b"a", []) == b"a"
