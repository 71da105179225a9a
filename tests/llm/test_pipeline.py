import re

import pytest

import corpus_pipeline
from shardloom.llm import entry

from .corpus import corpus, texts
from .test_dedup import brute_components, windows_of

pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rows = corpus() + [(5000 + i, "\n".join(" ".join(w.upper() + "!!" for w in t.split()) for t in texts(1, i)[0])) for i in range(30)]
    full = [(i, t, "en", ["a", "b", "b", None][n % 4], None if t is None else len(t)) for n, (i, t) in enumerate(rows)]
    spark.createDataFrame(full, SCHEMA).repartition(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 5000), 0) for i, _ in rows if i is not None and i % 2], "doc_id long, quality int, toxic int").dropDuplicates(["doc_id"]).write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "suffix_dedup", "mix_sources", "bpe"]
    stages, at = dict(corpus_pipeline.STAGES), folder
    kept = {}
    for name in ("quality_rules", "near_dedup", "suffix_dedup", "mix_sources"):
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        out = stages[name](spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(at := f"{at}-{name}")
        docs = spark.read.parquet(at)
        kept[name] = (before, [(r["doc_id"], r["text"]) for r in docs.collect()])
    before, after = kept["quality_rules"]
    assert after and all(len(WORD.findall(t)) >= 20 for _, t in after) and not any(t.endswith("!!") for _, t in after)
    before, after = kept["near_dedup"]
    components = brute_components(before, 80)
    assert len(after) == len({(c, i if c is None else None) for i, _, c in components}) and set(after) <= set(before)
    before, after = kept["suffix_dedup"]
    every = [w for _, t in after for w in windows_of(t)]
    old = {w for _, t in before for w in windows_of(t)}
    assert len([w for w in every if w in old]) == len({w for w in every if w in old})
    before, after = kept["mix_sources"]
    assert abs(sum(len(WORD.findall(t)) for _, t in after) - sum(len(WORD.findall(t)) for _, t in before)) <= 5
    assert stages["bpe"](spark, docs, folder).count() == len(after)


def test_near_dedup_with_repeated_and_null_ids(spark):
    every = texts(30, 9, 300)[0]
    a, b, c = (" ".join(every[i::3]) for i in range(3))
    near = lambda t: t.replace(t.split()[len(t.split()) // 2], "other", 1)
    rows = [(1, a), (1, b), (5, near(a)), (6, near(b)), (None, c), (None, near(c)), (None, c)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], SCHEMA)
    after = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert len(after) == 3 and {(1, a), (1, b)} < set(after) and [t in (c, near(c)) for i, t in after if i is None] == [True]


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and out.count() > 0


def test_entries():
    names = list(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and set(entry.oracle_sql()) <= set(names)
