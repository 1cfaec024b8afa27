"""Language evidence fused by Bayes' rule, against brute force."""

import collections
import math
import random

import numpy as np
import pytest

from curate.llm import language_id

SCHEMA = "doc_id long, text string, lang string, source string, suffix string, teacher string, evidence string"


def made_rows():
    rng = random.Random(12)
    pools = {
        "en": ["the", "and", "with", "thing", "other"], "fr": ["les", "une", "avec", "chose", "autre"], "de": ["der", "und", "mit", "ding", "ander"],
    }
    rows = []
    for i in range(160):
        own = rng.choice(["en", "en", "fr", "de"])
        mixed = rng.choice(list(pools)) if rng.random() < 0.3 else own
        words = [rng.choice(pools[rng.choice([own, mixed])]) for _ in range(rng.randint(0, 9))]
        host = rng.choice([f"{own}.example.org", "www.example.org", f"a.{own}.net", "plain", None])
        rows.append((i, " ".join(words), rng.choice([own, own, mixed, None]), host, rng.choice([own, "com", None]), own, None))
    rows += [(None, None, None, None, None, None, None), (500, "", "fr", "new.example.org", "de", None, None), (501, "ab", None, None, "com", "en", None)]
    return rows + rows[:15]


def brute(rows, uses):
    names = sorted({r[5] for r in rows if r[5] is not None})
    n = len(names)
    cells = [language_id._cells(np.frombuffer((r[1] or "").encode(), np.uint8)) if len((r[1] or "").encode()) > 2 else [] for r in rows]
    table = np.full((n, language_id.CELLS), 0.5)
    for r, found in zip(rows, cells):
        for c in found:
            if r[5] is not None:
                table[names.index(r[5]), c] += 1
    table = np.log(table / table.sum(1, keepdims=True))
    text = [[sum(table[i, c] for c in found) * len(found) ** (language_id.POWER - 1) if len(found) else 0.0 for i in range(n)] for found in cells]
    guess = [max(range(n), key=lambda i: (e[i], -i)) for e in text]

    def counted(of):
        out = collections.defaultdict(lambda: [0] * n)
        for r, g in zip(rows, guess):
            out[of(r)][g] += 1
        return out

    def shrunk(counts, prior, strength):
        return [(c + strength * p) / (sum(counts) + strength) for c, p in zip(counts, prior)]

    overall = [(guess.count(i) + 1) / (len(rows) + n) for i in range(n)]
    host = (lambda r: r[3]) if "host" in uses else (lambda r: None)
    domain = lambda r: None if host(r) is None else ".".join(host(r).split(".")[-2:])
    by_host, by_domain = counted(host), counted(domain)
    found = []
    for r, evidence in zip(rows, text):
        prior = shrunk(by_host[host(r)], shrunk(by_domain[domain(r)], overall, 100.0), 20.0)
        fused = [e + math.log(p) for e, p in zip(evidence, prior)]
        for name, at in (("declared", 2), ("suffix", 4)):
            if name in uses and r[at] is not None:
                values = counted(lambda r, at=at: r[at])
                values.pop(None, None)
                total = [sum(v[i] for v in values.values()) for i in range(n)]
                share = sum(values[r[at]]) / sum(total)
                for i in range(n):
                    fused[i] += math.log((values[r[at]][i] + 5.0 * share) / (total[i] + 5.0))
        best = max(range(n), key=lambda i: (fused[i], -i))
        found.append((str(r[0]), names[best], 1 / sum(math.exp(f - fused[best]) for f in fused)))
    return sorted(found)


@pytest.mark.parametrize("uses", [("declared", "host", "suffix"), ("declared", "host"), ("suffix",), ()])
def test_fused_posteriors_are_those_of_brute_force(spark, uses):
    rows = made_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    names = {"declared": "lang", "host": "source", "suffix": "suffix"}
    chosen = {kind: column if kind in uses else None for kind, column in names.items()}
    out = language_id.identify(df, learn_from="teacher", **chosen).collect()
    got = sorted((str(r["key"]), r["language"], r["posterior"]) for r in out)
    want = brute(rows, uses)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-5)
    assert all(r["accepted"] == (r["posterior"] >= 0.6) for r in out)
    # Each kind of evidence counts: without it the posteriors are others.
    for kind in uses:
        less = brute(rows, [u for u in uses if u != kind])
        assert max(abs(a[2] - b[2]) for a, b in zip(want, less)) > 0.01


def test_empty_table(spark):
    assert language_id.identify(spark.createDataFrame([], SCHEMA), suffix="suffix").collect() == []
