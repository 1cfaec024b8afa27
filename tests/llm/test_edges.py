"""Empty tables, very long texts and repeated rows."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from curate.llm import (
    brown_lm,
    chat,
    decontamination,
    line_crf,
    packing,
    quality_rules,
    simhash,
    suffix_array,
    suffix_tree,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _leaks(df, spark):
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    return decontamination.leaks(df, bench)


@pytest.mark.parametrize("run", [
    lambda df, spark: suffix_array.remove_repeats(df),
    lambda df, spark: brown_lm.score_texts(df, F.col("doc_id") == 1),
    lambda df, spark: packing.pack(packing.pieces(df)),
    _leaks,
    lambda df, spark: decontamination.leaks(df, spark.createDataFrame([], "item_id long, text string")),
    lambda df, spark: quality_rules.apply_rules(df),
    lambda df, spark: chat.read_back(chat.assemble(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))),
    lambda df, spark: simhash.near_duplicates(df),
    lambda df, spark: suffix_tree.remove_repeats(df),
    lambda df, spark: line_crf.score(df, line_crf.train(df, spark.createDataFrame([], "key long, label int"))),
], ids=["op1", "op2", "op4", "op5", "op5 items", "op6", "op7", "op8", "op9", "op10"])
def test_empty_tables(spark, none, run):
    assert run(none, spark).collect() == []


def test_bytes_of_very_long_texts(spark):
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(700))
    parts = ["".join(rng.choice("abcdefgh ") for _ in range(150_000)) for _ in range(4)]
    # Copies on both sides of the places where long texts are cut.
    rows = [(1, passage.join(parts), "en", None, 0), (2, parts[1][:131_000] + passage + parts[0][149_000:] + "x", "en", None, 0)]
    seen, want = set(), {}
    for key, text, *_ in rows:
        raw = text.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            window = hash(raw[i : i + 100])
            if window in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(window)
        want[key] = bytes(b for b, g in zip(raw, gone) if not g)
    found = {r["key"]: bytes(r["kept"]) for r in suffix_array.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == want and len(want[1]) < len(rows[0][1])


def test_words_of_very_long_texts(spark):
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    words = [f"w{rng.randrange(100_000)}" for _ in range(290_000)]
    words[262_100:262_160] = passage
    rows = [(1, " ".join(words), "en", None, 0), (2, " ".join(passage[5:50] + ["z"] * 36), "en", None, 0)]
    count = collections.Counter()
    split = {key: text.split() for key, text, *_ in rows}
    for found in split.values():
        count.update(hash(tuple(found[i : i + 35])) for i in range(len(found) - 34))
    out = {r["key"]: r for r in suffix_tree.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    for key, found in split.items():
        gone = [False] * len(found)
        for i in range(len(found) - 34):
            if count[hash(tuple(found[i : i + 35]))] > 1:
                gone[i : i + 35] = [True] * 35
        assert out[key]["n_removed"] == sum(gone)
        assert out[key]["kept"] == " ".join(w for w, g in zip(found, gone) if not g)
    assert out[1]["n_removed"] == 45 and out[2]["n_removed"] == 81


def test_repeated_rows_get_the_same_score(spark):
    rows = [(i % 40, f"line {i % 40} of text\n*** ###\nmore", "en", None, 0) for i in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "key long, label int")
    scores = collections.defaultdict(set)
    out = line_crf.score(df, line_crf.train(df, labels)).collect()
    for r in out:
        scores[r["key"]].add(r["score"])
    assert len(out) == 80 and all(len(s) == 1 for s in scores.values())
