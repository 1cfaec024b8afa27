import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from curate import operators as op
from curate.functions import scores
from curate.operators import similarity


def lcs(a, b):
    """Longest common subsequence by the table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain(a, b):
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial(a, b):
    a, b = sorted((a, b), key=len)
    best = 0.0
    for short, long in {(a, b), (b, a)} if len(a) == len(b) else {(a, b)}:
        for i in range(len(long)):
            for size in range(1, len(short) + 1):
                if i == 0 or i + size >= len(long) or size == len(short):
                    best = max(best, plain(short, long[i : i + size]))
    return best


def weighted(a, b):
    """The weighted ratio by its definition."""
    spread = max(len(a), len(b)) / min(len(a), len(b))
    words = [sorted(t.split()) for t in (a, b)]
    sets = [set(w) for w in words]
    shared = sorted(sets[0] & sets[1])
    rest = [sorted(sets[0] - sets[1]), sorted(sets[1] - sets[0])]
    head, sides = " ".join(shared), [" ".join(shared + r) for r in rest]
    if spread < 1.5:
        token = 0.0
        if sets[0] and sets[1]:
            token = max(plain(*map(" ".join, words)), plain(*sides))
            if shared:
                token = max([token, *(plain(head, s) for s in sides)])
                if not rest[0] or not rest[1]:
                    token = 100.0
        return max(plain(a, b), 0.95 * token)
    weight = 0.9 if spread <= 8 else 0.6
    token = 0.0
    if sets[0] and sets[1]:
        token = 100.0 if shared else max(partial(*map(" ".join, words)), partial(*map(" ".join, map(sorted, sets))))
    return max(plain(a, b), weight * partial(a, b), weight * 0.95 * token)


def _texts(seed, n):
    """Names that share words, differ by slips, word order and extra words."""
    rng = random.Random(seed)
    words = ["bet", "betting", "jackpot", "jackpots", "arcade", "amusements", "limited", "ltd", "a", "&", "shop", "the"]
    texts = set()
    while len(texts) < n:
        text = " ".join(rng.choices(words, k=rng.randrange(1, 5)))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(["", rng.choice("abe t"), text[at : at + 1] * 2]) + text[at + 1 :]
        if text:
            texts.add(text)
    return sorted(texts | {" ", "  ", "a  " + " " * 12 + "b", "x", "xy", "été bet", "bet été"})


SCORES = {
    "indel": plain,
    "levenshtein": lambda a, b: (1 - levenshtein(a, b) / max(len(a), len(b))) * 100.0,
    "wratio": weighted,
}


@pytest.mark.parametrize("metric, least", [
    ("indel", 67), ("indel", 77), ("indel", 90), ("levenshtein", 51), ("levenshtein", 80),
    ("wratio", 77), ("wratio", 86), ("wratio", 90), ("wratio", 95), ("wratio", 99),
])
def test_search_finds_what_brute_force_finds(spark, metric, least, monkeypatch):
    # Salting at three texts, so that nearly every key is salted.
    monkeypatch.setattr("curate.operators.similarity.TEXTS_PER_SALT", 3)
    texts = _texts(least, 100)
    expected = {}
    for a, b in combinations(texts, 2):
        score = SCORES[metric](a, b)
        if least <= score < 100:
            expected[a, b] = score
    df = spark.createDataFrame([(t,) for t in texts + texts[:20]] + [(None,), ("",)], "t string").repartition(4)
    out = op.similar_values(df, "t", least, metric)
    assert out.columns == ["t", "matched_t", "similarity_score"]
    found = {(r[0], r[1]): r[2] for r in out.collect()}
    assert found.keys() == expected.keys()
    assert expected or least == 99
    for pair, score in found.items():
        assert score == pytest.approx(expected[pair])


@pytest.mark.parametrize("seed", range(3))
def test_scores(seed):
    texts = _texts(seed, 40)
    for a, b in combinations(texts, 2):
        assert scores.common_length(a, b) == lcs(a, b)
        assert scores.partial_ratio(a, b) == pytest.approx(partial(a, b))
        assert scores.weighted_ratio(a, b) == pytest.approx(weighted(a, b))


def test_known_scores():
    assert scores.weighted_ratio("", "x") == 0.0
    assert scores.ratio("new quay", "newquay") == pytest.approx(100 * 14 / 15)
    assert scores.weighted_ratio("shop bet", "bet shop") == pytest.approx(95.0)
    assert scores.weighted_ratio("casino", "casino 2005") == pytest.approx(90.0)
    assert scores.weighted_ratio("Casino", "casino") == pytest.approx(100 * 10 / 12)


def test_no_pairs_is_an_empty_table(spark):
    df = spark.createDataFrame([("abc",), ("xyz",)], "t string")
    assert op.similar_values(df, "t").collect() == []


def test_arguments(spark):
    df = spark.createDataFrame([("abc",)], "t string")
    for wrong in ({"min_score": 76}, {"min_score": 100}, {"min_score": 66, "metric": "indel"}, {"min_score": 50, "metric": "levenshtein"}, {"metric": "jaro"}, {"method": "guess"}):
        with pytest.raises(ValueError):
            op.similar_values(df, "t", **wrong)


@pytest.mark.parametrize("metric, least", [("indel", 75), ("indel", 80), ("indel", 90), ("levenshtein", 75), ("levenshtein", 90)])
def test_banded_search_finds_nearly_all(spark, metric, least):
    rng = random.Random(least)
    texts = set(_texts(7, 80))
    while len(texts) < 260:
        text = "".join(rng.choice("abcdefghij klmnop") for _ in range(rng.randint(8, 60)))
        texts.add(text)
        for _ in range(3):
            copy = list(text)
            for _ in range(rng.randint(1, max(1, len(text) // 6))):
                copy[rng.randrange(len(copy))] = rng.choice(["", "x", "yz"])
            texts.add("".join(copy))
    df = spark.createDataFrame([(t,) for t in sorted(texts - {""})], "t string")
    exact = {tuple(r) for r in op.similar_values(df, "t", least, metric).collect()}
    banded = {tuple(r) for r in op.similar_values(df, "t", least, metric, method="lsh").collect()}
    assert banded <= exact and len(exact) > 50
    assert len(banded) >= 0.99 * len(exact)


def test_bands_refuse_what_they_would_miss(spark):
    df = spark.createDataFrame([("abc",)], "t string")
    with pytest.raises(ValueError):
        op.similar_values(df, "t", 55, "levenshtein", method="lsh")
    for least in (60, 75, 80, 90, 99):
        size, bands, values = similarity._bands(least)
        spoiled = size * (100 - least) / 100
        assert bands <= similarity.MOST_BANDS
        assert (1 - ((1 - spoiled) / (1 + spoiled)) ** values) ** bands <= similarity.MISSED


@pytest.mark.parametrize("length", [4, 20, 300])
def test_values_agree_as_often_as_stretches_overlap(length):
    rng = random.Random(length)
    agreed, overlap = 0.0, 0.0
    for _ in range(60):
        a = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz😀é") for _ in range(length))
        b = a[: length // 2] + "".join(rng.choice("ABCDEFG") for _ in range(length - length // 2))
        least = similarity._least_by_bin([a, b, a], 2, 96)
        assert (least[0] == least[2]).all()
        agreed += (least[0] == least[1]).mean()
        x, y = ({t[i : i + 2] for i in range(length - 1)} for t in (a, b))
        overlap += len(x & y) / len(x | y)
    assert agreed / 60 == pytest.approx(overlap / 60, abs=0.08)


def test_rows_of_the_search_do_not_hold_texts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(2000)) for _ in range(40)]
    texts += [t[:1000] + "zz" + t[1002:] for t in texts[:10]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    stored = similarity._texts(df, "t")
    listed = similarity._listed(stored, False)
    total = sum(map(len, texts))
    assert dict(listed.dtypes) == {"id": "bigint", "chars": "int", "key": "string", "place": "int"}
    assert listed.count() <= len(similarity.PIECE_SIZES) * total and listed.selectExpr("max(length(key))").first()[0] == 4
    kept = similarity._kept_pieces(stored, listed.groupBy("key").agg(F.count("*").alias("texts")), 90, "indel", False)
    assert kept.count() < 0.5 * total and "text" not in kept.columns
    before = _shuffle_bytes(spark)
    assert len(op.similar_values(df, "t", 90, "indel").collect()) == 10
    # Four keys a character, each a few fixed numbers, dealt a few times: far from a text for every key.
    assert _shuffle_bytes(spark) - before < 400 * total


def _shuffle_bytes(spark):
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_bands_look_at_few_pairs(spark):
    rng = random.Random(11)
    urls = [f"https://{rng.choice(['a', 'b'])}.example/{rng.randrange(10**8)}/{rng.choice(['list', 'page'])}-{rng.randrange(10**6)}" for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in urls], "text string")
    pairs = len(urls) * (len(urls) - 1) / 2
    assert similarity._banded(similarity._texts(df, "text"), 90, "indel").count() < 0.05 * pairs


@pytest.mark.parametrize("method", ["lsh", "exact"])
def test_no_keys_go_through_the_driver(spark, method):
    rng = random.Random(5)
    urls = [f"https://{rng.choice('abc')}.example/{rng.randrange(10**6)}" for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in urls], "t string")
    out = op.similar_values(df, "t", 90, "indel", method=method)
    # The texts are few enough to be broadcast, by the size of their files; their keys are many more.
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10 << 20
    assert "Broadcast" not in out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


@pytest.mark.parametrize("metric, least", [("indel", 75), ("levenshtein", 80)])
def test_blocks_find_what_keys_find(spark, metric, least, monkeypatch):
    rng = random.Random(least)
    texts = _texts(least, 60) + [f"https://{rng.choice('ab')}.example/{rng.randrange(10**4)}" * rng.choice([1, 1, 4]) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    stored = similarity._texts(df, "t")
    monkeypatch.setattr(similarity, "MET_AT_ONCE", 50)
    monkeypatch.setattr(similarity, "CHARS_AT_ONCE", 200)
    monkeypatch.setattr(similarity, "TEXTS_PER_BLOCK", 30)
    found = []
    # No key is frequent, some are, all are.
    for least_texts, share in ((10**9, 0), (30, 0), (1, 0)):
        monkeypatch.setattr(similarity, "FREQUENT_FROM", least_texts)
        monkeypatch.setattr(similarity, "FREQUENT_SHARE", share)
        found.append(sorted(tuple(r) for r in similarity._banded(stored, least, metric).collect()))
    assert len(found[0]) > 100 and len(set(found[0])) == len(found[0])
    assert found[0] == found[1] == found[2]


def test_pairs_of_blocks_are_scored_once_and_where_they_meet(spark, monkeypatch):
    rng = random.Random(12)
    urls = [f"https://www.alike.example.com/{'long/' * (i % 7 == 0) * 12}{rng.randrange(10**4):04}?é" for i in range(250)] + ["x", "é" * 300, "é" * 299]
    df = spark.createDataFrame([(t,) for t in urls], "t string")
    met, plain = [], similarity._score
    monkeypatch.setattr(similarity, "_score", lambda pairs, *rest: met.append(pairs.count()) or plain(pairs, *rest))
    exact = {tuple(r) for r in op.similar_values(df, "t", 90, "indel").collect()}
    out = op.similar_values(df, "t", 90, "indel", method="lsh")
    assert {tuple(r) for r in out.collect()} == exact and len(exact) > 10_000
    # Only pairs of long texts are left to be scored one by one.
    assert 0 < met[1] < 0.1 * met[0]
    # Sorting reads its input twice, so nothing but reading stands below it.
    plan = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "MapIn" not in plan and "FlatMapGroups" not in plan


def test_pairs_that_share_frequent_keys_are_met_once(spark):
    rng = random.Random(8)
    urls = sorted({f"https://www.alike.example.com/en/{rng.randrange(10**6):06}?utm_source=feed" for _ in range(400)})
    df = spark.createDataFrame([(t,) for t in urls], "t string")
    before = _shuffle_bytes(spark)
    pairs = similarity._banded(similarity._texts(df, "t"), 90, "indel").count()
    # Each pair shares many keys, but texts are shuffled, not pairs.
    assert pairs > 50_000 and _shuffle_bytes(spark) - before < 16 * pairs


def test_ratios_of_many_pairs():
    rng = random.Random(2)
    sizes = [0, 1, 5, 40, 63, 64, 65, 90, 256, 257]
    a, b = (["".join(rng.choice("abcé😀") for _ in range(rng.choice(sizes))) for _ in range(300)] for _ in range(2))
    assert scores.ratios(a, b).tolist() == [scores.ratio(x, y) for x, y in zip(a, b)]
    assert scores.ratios([], []).tolist() == []


@pytest.mark.parametrize("length", [1, 30, 200])
def test_bits_differ_no_more_than_characters_come_or_go(length):
    rng = random.Random(length)
    for _ in range(100):
        a = "".join(rng.choice("abcé😀") for _ in range(length))
        b = list(a)
        for _ in range(rng.randrange(12)):
            b.insert(rng.randrange(len(b) + 1), rng.choice("abx")) if rng.random() < 0.5 or not b else b.pop(rng.randrange(len(b)))
        b = "".join(b)
        bits = similarity._counted_bits([a, "", b, a])
        assert not bits[1].any() and (bits[0] == bits[3]).all()
        assert np.bitwise_count(bits[0] ^ bits[2]).sum() <= len(a) + len(b) - 2 * lcs(a, b)


def test_suggestions(spark, rows):
    texts = ["middlesbrough"] * 3 + ["middlesborough"] + ["leeds"] * 2
    df = spark.createDataFrame([(t,) for t in texts], "city string")
    out = op.suggest_replacements(df, "city", 90, "indel")
    assert rows(out.drop("similarity_score")) == [("middlesborough", "middlesbrough", 1, 3)]
