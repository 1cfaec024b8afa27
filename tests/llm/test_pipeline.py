"""The pipeline's stages on the smallest tables, each against brute force over its own input."""

import os
import random

import pytest

import corpus_pipeline
from curate.llm import queries as llm
from curate.llm import simhash

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, FOLDER), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    assert set(seen["language"]) <= set(before)
    texts = [r["text"] for r in seen["near_duplicates"].values()]
    assert len(set(texts)) == len(texts)
    assert set(seen["repeated_substrings"]) == set(seen["near_duplicates"])
    windows = set()
    for _, r in sorted(seen["repeated_substrings"].items()):
        assert r["n_chars"] == len(r["text"])
    for key, r in sorted(seen["near_duplicates"].items()):
        raw = r["text"].encode()
        own = {raw[i : i + 100] for i in range(len(raw) - 99)}
        if not own & windows and len(own) == max(0, len(raw) - 99):
            assert seen["repeated_substrings"][key]["text"] == r["text"]
        windows |= own
    items = [r["text"].lower() for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    kept = seen["decontamination"]
    for key, r in seen["repeated_substrings"].items():
        if any(item in r["text"].lower() for item in items):
            assert key not in kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r["doc_id"] for r in packed} == set(kept)
    assert len(corpus_pipeline.run(spark, FOLDER).collect()) == len(packed)


def test_rows_that_share_an_id_or_have_none_are_judged_one_by_one(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(4000)}" for _ in range(60)) for _ in range(6)]
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first()["text"]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (8, texts[0]), (None, item), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", None, 0, "x", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, gone int")
    kept = corpus_pipeline.near_duplicates(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    assert sorted(str(r["text"]) for r in kept.collect()) == sorted([*texts[:4], item, "None"])
    kept = corpus_pipeline.decontaminate(spark, docs, FOLDER)
    assert sorted(str(r["text"]) for r in kept.collect()) == sorted(str(t) for _, t in rows if t != item)
    kept = corpus_pipeline.language(spark, docs, FOLDER)
    assert kept.columns == docs.columns and kept.count() == len(rows)


def test_near_duplicates_are_components_of_fingerprints(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(12):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.randint(3, 150))]
        for i in range(12):
            copy = list(words)
            for _ in range(i % 4):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(50)}"
            rows.append(" ".join(copy))
    rows += ["", None, " ", "One two", "one  TWO", "a b c d", "a b c d e"]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(rows)], schema).repartition(5)
    marks = [simhash.fingerprint((t or "").encode()) for t in rows]
    label = list(range(len(rows)))
    close = [(a, b) for b in range(len(rows)) for a in range(b) if (marks[a] ^ marks[b]).bit_count() <= 2]
    for _ in rows:
        for a, b in close:
            label[a] = label[b] = min(label[a], label[b])
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()}
    assert kept == {i for i, v in enumerate(label) if i == v}
    assert len(kept) < len({" ".join((t or "").lower().split()) for t in rows})
    with pytest.raises(ValueError):
        simhash.links(docs.select("doc_id"), 3)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_an_empty_table(spark, name):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert dict(corpus_pipeline.STAGES)[name](spark, none, FOLDER).collect() == []


def test_every_operator_has_its_query():
    names = sorted(llm.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert set(llm.oracle_sql()) <= set(names)
