"""Phrase collocations against brute force."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from curate.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, first string, size long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(rows, min_count, top, longest=5, percent=100):
    counts, words = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower(text)):
            found = re.findall(r"[^ \t]+", piece)
            words[lang] += len(found)
            for size in range(1, longest + 1):
                for i in range(len(found) - size + 1):
                    counts[lang, tuple(found[i : i + size])] += 1
    often = {k: c for k, c in counts.items() if c >= min_count}
    out = collections.defaultdict(list)
    for (lang, phrase), a in often.items():
        if len(phrase) < 2:
            continue
        longer = [c for (other, p), c in often.items() if other == lang and len(p) > len(phrase)
                  and any(p[i : i + len(phrase)] == phrase for i in range(len(p) - len(phrase) + 1))]
        if any(100 * c >= percent * a for c in longer):
            continue
        n = words[lang]
        score, _, l, r = min(
            (1000 * a * n // (counts[lang, phrase[:k]] * counts[lang, phrase[k:]]), k, counts[lang, phrase[:k]], counts[lang, phrase[k:]])
            for k in range(1, len(phrase))
        )
        out[lang].append((-score, -a, " ".join(phrase).encode(), l, r, n))
    return sorted(
        (lang, rank + 1, p.decode(), -a, l, r, n, -score)
        for lang, found in out.items()
        for rank, (score, a, p, l, r, n) in enumerate(sorted(found)[:top])
    )


def made_rows():
    rng = random.Random(11)
    words = ["New", "york", "the", "of", "été", "ABC", "z", "l'eau", " x", "É"]
    rows = []
    for i in range(150):
        text = "".join(rng.choice(words[: 3 + i % 8]) + rng.choice([" ", "  ", "\t", " ", ". ", "\n", "\r", "\x0b"]) for _ in range(rng.randint(0, 60)))
        rows.append((i, text, ["en", "fr", None, "und"][i % 4], "x", 1))
    rows += [(None, None, "en", "x", 1), (3, "", "fr", "x", 1), (3, "of the New york", None, None, None)]
    return rows + rows[:20]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made_rows(), SCHEMA).repartition(4)


def found(df):
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize(("bits", "min_count", "percent"), [(64, 8, 100), (3, 20, 100), (1, 40, 60), (64, 3, 50)])
def test_collocations_are_those_of_brute_force(docs, bits, min_count, percent):
    out = co.collocations(docs, min_count=min_count, top=30, bits=bits, percent=percent)
    want = brute(made_rows(), min_count, 30, percent=percent)
    assert found(out) == want and len(want) > 5


def test_counts_do_not_depend_on_flushes_or_on_a_full_sieve(docs, monkeypatch):
    monkeypatch.setattr(co, "HELD", 16)
    counted = co.phrase_counts(docs, min_count=8, most=1 << 10)
    want = {tuple(r[:4]) for r in co.phrase_counts(docs, min_count=8).collect()}
    assert {tuple(r[:4]) for r in counted.collect()} == want


def test_examples_hold_their_phrase(docs):
    where = collections.defaultdict(set)
    for key, text, lang, *_ in made_rows():
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower(text)):
            found = re.findall(r"[^ \t]+", piece)
            for size in range(1, 6):
                for i in range(len(found) - size + 1):
                    where["und" if lang is None else lang, " ".join(found[i : i + size])].add(key)
    out = co.phrase_counts(docs, min_count=8).where("size > 0").collect()
    assert out and all(r["example"] in where[r["lang"], r["phrase"]] for r in out)


def test_scores_are_exact_beyond_64_bits(spark):
    big = 10**16 + 7
    counts = spark.createDataFrame(
        [("en", 0, "", 3 * big, None), ("en", 1, "a", big + 2, None), ("en", 1, "b", big + 4, None), ("en", 2, "a b", big, None)],
        "lang string, size int, phrase string, count long, example long",
    )
    r = co.score_cuts(counts).first()
    assert r["score"] == 1000 * big * 3 * big // ((big + 2) * (big + 4))


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert co.collocations(none).collect() == []
    assert co.collocations(none.withColumn("lang", F.lit(None).cast("string")), min_count=1).collect() == []
