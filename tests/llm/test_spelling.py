"""Spelling variants against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from curate.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, near string"
LETTERS = "abceinst"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows, typo_in=199, length=6, count=5, factor=5):
    counts = collections.Counter()
    for key, text, *_ in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if typo_in and h % typo_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= length and n >= count}
    out = {}
    for w, n in words.items():
        found = [v for v in words if near(w, v)]
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= factor * n else None
        out[w] = (n, len(found), form, words.get(form))
    result = {}
    for w in out:
        root = w
        while out[root][2] is not None:
            root = out[root][2]
        result[w] = (*out[w], root)
    return result


def made_rows(seed=4, n=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(5, 12))) for _ in range(25)]
    base += ["été" + w for w in base[:5]] + ["aaaaaa", "aaaaaaa", "aaaaab", "baaaaa", "abaaaa", "z" * 40, "z" * 41, "Ünïcödé", "ünïcödé"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 150)):
            w = base[min(int(rng.expovariate(0.1)), len(base) - 1)]
            if rng.random() < 0.3:
                at = rng.randrange(len(w) + 1)
                w = w[:at] + rng.choice([rng.choice(LETTERS), "", rng.choice(LETTERS)]) + w[at + rng.randint(0, 1) :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", ", ", "1", "×", "\n"]).join(words), "w", 1, None))
    return rows + [(None, None, None, None, None), (None, "aaaaaa baaaaa", "w", 1, None), (3, "", "w", 1, None)] + rows[:3]


def found(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


@pytest.mark.parametrize(("options", "index"), [({}, 4096), ({"typo_in": 7, "count": 2}, 4), ({"typo_in": None, "length": 2, "count": 1, "factor": 2}, 16)])
def test_variants_are_those_of_brute_force(spark, options, index):
    rows = made_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = spelling.spelling_variants(df, **options, index=index)
    collected = out.collect()
    want = brute(rows, **options)
    assert found(out) == want and len(collected) == len(want)
    assert any(w[2] for w in want.values())


def test_one_large_group_is_cut_into_blocks(spark):
    rng = random.Random(1)
    words = {"stone" + "".join(rng.choice("abc") for _ in range(rng.randint(5, 6))) for _ in range(400)}
    vocabulary = spark.createDataFrame([(w, rng.randint(5, 99)) for w in sorted(words)], "word string, n long")
    pairs = [(r["word"], r["near"]) for r in spelling.near_words(vocabulary, index=32).collect()]
    assert sorted(pairs) == sorted((a, b) for a in words for b in words if near(a, b))


@pytest.mark.parametrize("seed", range(5))
def test_bitsets_agree_with_letters(seed):
    rng = random.Random(seed)
    length = rng.randint(2, 7)
    word = lambda n: "".join(rng.choice("abé") for _ in range(n))
    words = sorted({word(rng.choice([length, length + 1])) for _ in range(150)})
    queries = sorted({word(length) for _ in range(300)})
    got = set()
    for side in "ab":
        asked, answered = spelling._pairs(length, side, queries, words)
        pairs = list(zip(asked.tolist(), answered.tolist()))
        assert not got & set(pairs) and len(pairs) == len(set(pairs))
        got |= set(pairs)
    assert got == {(i, j) for i, q in enumerate(queries) for j, w in enumerate(words) if near(q, w)}
    assert np.array(spelling._letters(["é"], 2)).tolist() == [[233, 0]]


def test_empty_table_and_bad_parameters(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert spelling.spelling_variants(none).collect() == []
    for options in ({"length": 1}, {"factor": 1}):
        with pytest.raises(ValueError):
            spelling.spelling_variants(none, **options)
