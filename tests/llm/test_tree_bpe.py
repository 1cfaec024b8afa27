"""BPE in joined parts against the tokenizers library over whole texts."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from curate.llm import tree_bpe

SCHEMA = "doc_id long, text string, ids string, number long"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tree_bpe.default_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def expected(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def long_texts():
    rng = random.Random(3)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    yield "a" * 5000
    yield "ab" * 2500 + " the end"
    yield pick("abcdefghijklmnopqrstuvwxyz", 6000)
    yield pick("ABCDEÉéİßſ", 3000)
    yield pick("the and ing ", 6000)
    yield pick("=-_.!'", 3000)
    yield pick("日本語漢字한글", 3000)
    yield pick("éä ñ", 3000)
    yield pick("0123456789٣", 2000)
    yield ("don't we'll " + "x" * 40 + "<|endoftext|>" + "y" * 90 + "<|startoftext|> <|ENDOFTEXT|>") * 30
    yield "".join(rng.choice(["in", "ing", "th", "the", "er", "</w>", "'s", "😀", "‍", " ", "\t"]) for _ in range(4000))
    yield " \n\t" * 2000


def test_parts_give_the_ids_of_the_whole(spark, library):
    texts = [*long_texts(), None, "", " ", "Hello, World!", "<|endoftext|>", "x<|endoftext|>y", "<|startoftext|>"]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, texts[2], "x", 1), (None, texts[2], None, None), (3, texts[4], "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for long, unit in ((300, 64), (100, 7), (10**6, 10**6)):
        got = tree_bpe.decode(tree_bpe.encode(df, long=long, unit=unit)).collect()
        want = [(r[0], expected(library, r[1])) for r in rows]
        assert sorted((str(r["key"]), r["ids"], r["decoded"]) for r in got) == sorted(
            (str(k), ids, library.decode(ids, skip_special_tokens=False)) for k, ids in want
        )


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80) | st.text("aeinrst '<|>", max_size=120), st.integers(1, 9))
def test_units_of_any_text(text, most):
    bpe = tree_bpe.bpe(tree_bpe.default_path())
    ids, parts = [], []
    for kind, content, mark in bpe.units(text, most):
        found = bpe.encode_unit(kind, content, mark)
        if kind in (tree_bpe._OPEN, tree_bpe._CLOSED):
            parts.append(found)
            if kind == tree_bpe._CLOSED:
                ids += bpe.join_all(parts)
                parts = []
        else:
            ids += found
    assert ids == bpe.whole.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(bpe.encode([text])[0], np.int32).tolist() == ids


def test_words_are_looked_up_as_the_library_splits_them(library):
    bpe = tree_bpe.bpe(tree_bpe.default_path())
    plain = [chr(c) for c in [*range(0x300), *range(0x2010, 0x2028)]]
    texts = [f"{a}{c}{b}" for c in plain for a, b in (("", ""), ("x", "y"), ("'", "s"), ("1", "2"), (" ", " "), ("É", "İ"), ("!", "\xa0"))]
    rng = random.Random(1)
    texts += ["".join(rng.choices(plain, k=60)) for _ in range(300)]
    for text in texts:
        found = bpe.looked_up(text)
        assert found is not None and np.frombuffer(found, np.int32).tolist() == expected(library, text), text
    for text in ("e\u0301", "ΟΔΥΣΣΕΥΣ", "日本", "<|endoftext|>", "a<|startoftext|>"):
        assert bpe.looked_up(text) is None


def test_the_memory_of_words_is_bounded(monkeypatch, library):
    monkeypatch.setattr(tree_bpe, "REMEMBERED", 3)
    bpe = tree_bpe.Bpe(tree_bpe.default_path())
    text = "one two three four five one " + "six" * 40
    assert np.frombuffer(bpe.encode([text])[0], np.int32).tolist() == expected(library, text) and len(bpe.known) <= 3


def test_windows_grow_until_both_sides_agree(monkeypatch):
    monkeypatch.setattr(tree_bpe, "WINDOW", 1)
    bpe = tree_bpe.bpe(tree_bpe.default_path())
    rng = random.Random(9)
    for n in range(2, 400, 7):
        word = "".join(rng.choice("aeinrstho") for _ in range(n))
        cut = rng.randint(1, n - 1)
        joined = bpe.join(bpe.part(word[:cut], False), bpe.part(word[cut:], True), True)
        assert joined == bpe.part(word, True)
        for word in ("a" * n, "ab" * n):
            assert bpe.join(bpe.part(word[:cut], False), bpe.part(word[cut:], True), True) == bpe.part(word, True)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert tree_bpe.decode(tree_bpe.encode(none)).collect() == []


def test_other_files(spark, tmp_path, library):
    import json

    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(path)
    texts = ["the  quick\n\n brown <|endoftext|> fox" * 20, "z" * 300]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    got = {r["key"]: r["ids"] for r in tree_bpe.encode(df, path=path, long=50, unit=16).collect()}
    assert got == {i: other.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    told = json.load(open(path))
    told["added_tokens"][0]["lstrip"] = True
    (tmp_path / "t.json").write_text(json.dumps(told))
    with pytest.raises(ValueError):
        tree_bpe.Bpe(str(tmp_path / "t.json"))
