"""The ten operators against brute force, on small rows with nulls, ties, repeats and odd columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curate.llm import brown_lm, chat, decontamination, language_id, line_crf, packing, quality_rules, simhash, suffix_array, suffix_tree
from curate.llm.bpe import encode
from curate.llm.components import components
from curate.llm.repeats import group_column, group_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string"


def made_rows(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(30)]
    texts += [f"{' '.join(word() for _ in range(9))} {passage} {word()}" for _ in range(4)]
    texts += [texts[0]] * 3 + [passage[7:], "ab " * 300, "a" * 350, "x" * 99, "x" * 100, "", None, "\n\n", "One two\nOne two\nthree"]
    rows = [(i, t, "en" if i % 2 else "fr", f"h{i % 3}.example.org" if i % 7 else None, None, 1.0, "k") for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made_rows(), SCHEMA).repartition(3)


def texts_of(rows):
    return sorted((r[0], (r[1] or "").encode()) for r in rows)


def brute_bytes(rows, width=100):
    seen, out = set(), {}
    for key, raw in texts_of(rows):
        gone = bytearray(len(raw))
        for i in range(len(raw) - width + 1):
            if raw[i : i + width] in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(raw[i : i + width])
        out[key] = bytes(b for b, g in zip(raw, gone) if not g)
    return out


def test_suffix_array_removes_what_stands_earlier(spark, docs):
    out = {r["key"]: r for r in suffix_array.remove_repeats(docs).collect()}
    want = brute_bytes(made_rows())
    assert {k: bytes(r["kept"]) for k, r in out.items()} == want
    for key, raw in texts_of(made_rows()):
        kept, at = b"", 0
        for span in out[key]["spans"]:
            kept, at = kept + raw[at : span["start"]], span["end"]
        assert kept + raw[at:] == want[key]
    again = suffix_array.remove_repeats(docs, as_text=True, carry=("lang", "key")).collect()
    assert all(r["carried_1"] == "k" for r in again) and len(again) == len(want)


@pytest.mark.parametrize("letters", [1, 2, 4, 250])
def test_suffixes_are_in_order(letters):
    rng = np.random.default_rng(letters)
    base = rng.integers(0, letters, 400).astype(np.uint8)
    data = np.concatenate([base, base[50:300], base[:200], np.zeros(5 * suffix_array.V, np.uint8)])
    places = rng.permutation(750)
    raw = data.tobytes()
    found = [raw[places[i] : places[i] + 124] for i in suffix_array.sort_suffixes(data, places)]
    assert found == sorted(found)


def test_suffix_trees_remove_all_copies(spark, docs):
    count = collections.Counter()
    for _, raw in texts_of(made_rows()):
        found = raw.split()
        count.update(tuple(found[i : i + 35]) for i in range(len(found) - 34))
    out = {r["key"]: r for r in suffix_tree.remove_repeats(docs).collect()}
    for key, raw in texts_of(made_rows()):
        found = raw.split()
        gone = [False] * len(found)
        for i in range(len(found) - 34):
            if count[tuple(found[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        kept = b" ".join(w for w, g in zip(found, gone) if not g).decode()
        assert (out[key]["kept"], out[key]["n_words"], out[key]["n_removed"]) == (kept, len(found), sum(gone))


def _window(words, place, window):
    return tuple(words[place : place + window].tolist())


def test_partitions_take_longer_prefixes_until_small():
    words = np.concatenate([np.array([1, 1, 1, 2] * 40 + [3] * 140 + list(range(4, 60)), np.uint64), np.zeros(35, np.uint64)])
    places = np.arange(len(words) - 35)
    groups = list(suffix_tree.partitions(words, places, members=20))
    assert sorted(np.concatenate([g for _, g in groups]).tolist()) == places.tolist()
    owner = {}
    for i, (known, group) in enumerate(groups):
        assert len({_window(words, p, known) for p in group}) == 1
        whole = {_window(words, p, 35) for p in group}
        assert len(group) <= 20 or len(whole) == 1
        # Equal windows never part.
        assert all(owner.setdefault(w, i) == i for w in whole)
    assert max(len(g) for _, g in groups) > 20


@pytest.mark.parametrize(("letters", "window"), [(2, 5), (3, 35), (1, 8), (40, 6)])
def test_internal_nodes_are_those_of_brute_force(letters, window):
    rng = np.random.default_rng(letters)
    words = rng.integers(1, letters + 1, 160).astype(np.uint64)
    words = np.concatenate([words, words[20:90], np.zeros(window, np.uint64)])
    places = rng.permutation(len(words) - window)[:150]
    ordered, depth = suffix_tree.leaves(words, places, 0, window)
    suffixes = [_window(words, p, window) for p in ordered]
    assert sorted(suffixes) == suffixes
    found = {(d, frozenset(ordered[a : b + 1].tolist())) for d, a, b in suffix_tree.internal_nodes(depth)}
    assert len(found) == len(suffix_tree.internal_nodes(depth))
    want = set()
    for length in range(window + 1):
        by_prefix = collections.defaultdict(list)
        for p in places.tolist():
            by_prefix[_window(words, p, length)].append(p)
        for members in by_prefix.values():
            # A node: several suffixes that go on in different ways, or end as equals.
            if len(members) > 1 and (length == window or len({words[p + length] for p in members}) > 1):
                want.add((length, frozenset(members)))
    assert found == want


def test_groups_agree_with_spark(spark):
    ids, signs = [0, 1, -5, 2**62, -(2**63)], [0, 7, 2**32 - 1, 2**31, 5]
    df = spark.createDataFrame(list(zip(ids, signs)), "i long, s long").select("i", group_column(F.col("i"), F.col("s"), 97).alias("g"))
    assert {r["i"]: r["g"] for r in df.collect()} == dict(zip(ids, group_of(np.array(ids), np.array(signs), 97).tolist()))


def test_texts_of_one_id_are_spread():
    groups = group_of(np.full(1000, -(2**63)), np.random.default_rng(0).integers(0, 2**32, 1000), 10)
    assert np.bincount(groups, minlength=10).max() < 150


def test_equal_and_null_ids(spark):
    long = "abc def ghi " * 12
    rows = [(None, long, "en", None, 1, 0.0, "")] * 2 + [(3, long, "en", None, 1, 0.0, ""), (3, "other", "en", None, 1, 0.0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = suffix_array.remove_repeats(df).collect()
    assert len(out) == 4 and {r["key"] for r in out} == {None, 3}
    # The null id comes first, so the copy under 3 goes; equal rows are one document.
    assert [len(r["kept"]) for r in out if r["key"] == 3 and r["n_bytes"] > 5] == [0]
    kept = [bytes(r["kept"]) for r in out if r["key"] is None]
    assert kept[0] == kept[1] != b""
    assert len(simhash.near_duplicates(df).collect()) == 4


def brute_fingerprint(text):
    import xxhash

    found = (text or "").encode().lower().split()
    grams = [b" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or ([b" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark):
    rows = made_rows()
    rows += [(100 + i, f"{rows[0][1]} {'w' * i}", "en", None, 1, 0.0, "") for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r["key"]: r for r in simhash.near_duplicates(df).collect()}
    fps = {r[0]: brute_fingerprint(r[1]) for r in rows}
    assert {k: r["fp"] % 2**64 for k, r in out.items()} == fps
    label = {k: k for k in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 2 and label[b] < label[a]:
                    label[a], changed = label[b], True
    assert {k: r["component"] for k, r in out.items()} == label
    assert df.select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64 == __import__("xxhash").xxh64_intdigest(b"a b c", 42)


def test_links_find_every_close_pair(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << p for p in rng.sample(range(64), k)) for b in base for k in (0, 1, 2, 2, 3, 4)}
    signed = [(x - 2**64 if x >= 2**63 else x,) for x in fps]
    out = simhash.links(spark.createDataFrame(signed, "fp long")).collect()
    found = [tuple(sorted((r["a"] % 2**64, r["b"] % 2**64))) for r in out]
    want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}
    assert len(found) == len(set(found)) and set(found) == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 140)]
    out = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert out == {i: 0 for i in range(21)} | {i: 100 for i in range(100, 140)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing_holds_every_id_once(spark, docs):
    big = [(500, "word and " * 1500, None, None, None, None, None), (501, "a<|endoftext|> b", None, None, None, None, None)]
    df = docs.unionByName(spark.createDataFrame(big, SCHEMA))
    cut = packing.pieces(df, with_ids=True)
    out = packing.pack(cut).collect()
    ranks = packing.bpe.default_ranks()
    by_doc = collections.defaultdict(list)
    for r in out:
        by_doc[r["key"]].append(r)
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for key, text in [(r[0], r[1]) for r in made_rows() + big]:
        parts = sorted(by_doc[key], key=lambda r: r["piece"])
        ids = np.concatenate([np.frombuffer(bytes(r["ids"]), "<u4") for r in parts])
        assert ids.tolist() == [*encode(ranks, text or "", packing.bpe.default_file()).tolist(), 0]
        assert all(r["length"] == 2048 for r in parts[1:]) and [r["start"] for r in parts] == np.cumsum([0] + [r["length"] for r in parts[:-1]]).tolist()
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048


def test_equal_rows_are_packed_in_different_shards(spark):
    df = spark.createDataFrame([(None, "one two three")] * 400, "doc_id long, text string")
    out = packing.pack(packing.pieces(df), shard=40).collect()
    assert len(out) == 400
    shards = collections.Counter(r["sequence_id"] >> 32 for r in out)
    assert len(shards) == 10 and max(shards.values()) < 80


def test_packing_is_nearly_full():
    rng = np.random.default_rng(1)
    sizes = rng.integers(20, 1900, 3000)
    sequence, _ = packing.pack_lengths(sizes)
    assert np.bincount(sequence, sizes).max() <= 2048
    assert sequence.max() + 1 <= math.ceil(sizes.sum() / 2048) * 1.02 + 3


@pytest.mark.parametrize("mix", ["even", "middle", "short", "two", "long"])
def test_packing_is_never_worse_than_best_fit(mix):
    rng = np.random.default_rng(len(mix))
    sizes = {
        "even": rng.integers(1, 2049, 600), "middle": rng.integers(500, 1100, 1500), "short": rng.integers(1, 300, 4000),
        "two": rng.choice([683, 1024, 400], 600), "long": rng.integers(1000, 2049, 400),
    }[mix]
    sequence, offset = packing.pack_lengths(sizes, nodes=2000)
    best = packing.best_fit(collections.Counter(sizes.tolist()), 2048)
    assert sorted(size for filling in best for size in filling) == sorted(sizes.tolist()) and max(map(sum, best)) <= 2048
    assert np.bincount(sequence, sizes).max() <= 2048
    assert sequence.max() + 1 <= len(best)
    for i in np.argsort(sequence, kind="stable"):
        others = np.flatnonzero((sequence == sequence[i]) & (offset < offset[i]))
        assert offset[i] == sizes[others].sum()
    if mix == "middle":
        assert sequence.max() + 1 < len(best)


def test_small_shards_take_as_few_sequences_as_any_packing():
    def optimum(sizes, length):
        best = len(sizes)

        def place(i, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if i == len(sizes):
                best = len(rooms)
                return
            for j in range(len(rooms)):
                if rooms[j] >= sizes[i]:
                    place(i + 1, [*rooms[:j], rooms[j] - sizes[i], *rooms[j + 1 :]])
            place(i + 1, [*rooms, length - sizes[i]])

        place(0, [])
        return best

    rng = np.random.default_rng(7)
    cases = [([6, 6, 5, 5, 4, 4, 3, 3, 2, 2], 10), ([44, 24, 24, 22, 21, 17, 8, 8, 6, 6], 60), ([7, 5, 5, 4, 4, 3, 2], 15)]
    for _ in range(150):
        length = int(rng.integers(8, 40))
        cases.append((sorted(rng.integers(1, length + 1, int(rng.integers(1, 10))).tolist(), reverse=True), length))
    for sizes, length in cases:
        assert packing.pack_lengths(np.array(sizes), length)[0].max() + 1 == optimum(sizes, length)


def test_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    json = Tokenizer.from_file(packing.bpe.default_file())
    ranks, file = packing.bpe.default_ranks(), packing.bpe.default_file()
    added = [token.content for token in json.get_added_tokens_decoder().values()]
    assert added
    marked = [f"{a}{mark}{b}" for mark in added for a in ("", " ", "x", "x ", "\n\n") for b in ("", " y", "y", mark, mark[1:])]
    for text in ["", "a  b\n\n c\t", "<|x|>  naïve—‘quoted’ 12345 !!!", *marked, *(r[1] or "" for r in made_rows())]:
        assert encode(ranks, text, file).tolist() == json.encode(text, add_special_tokens=False).ids
    # Without the file nothing is special: content can't make a mark.
    assert len(encode(ranks, added[0])) > 1


def test_leaks_by_brute_force(spark, docs):
    rows = made_rows()
    rng = random.Random(9)
    items = [(0, rows[3][1]), (1, "a short item"), (2, None), (3, " ".join(f"q{i}" for i in range(70))), (4, "only two")]
    changed = [f"q{i}" for i in range(70)]
    changed[35] = "zz"
    more = [(200, "intro words here " + " ".join(changed) + " and an end", 0), (201, "x y " + items[1][1].upper() + " z", 0), (202, "q1 q2 q3 q4 q5 q6", 0)]
    more += [(203, " ".join(rng.choice(["q1", "q2", "zz"]) for _ in range(90)), 0)]
    df = spark.createDataFrame([(r[0], r[1]) for r in rows] + [(m[0], m[1]) for m in more], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["key"], r["item"]): round(r["similarity"], 9) for r in decontamination.leaks(df, bench).collect()}
    want = {}
    for item, text in items:
        goal = (text or "").lower().split()
        if not goal:
            continue
        width = min(5, len(goal))
        grams = collections.Counter(tuple(goal[i : i + width]) for i in range(len(goal) - width + 1))
        for key, doc in [(r[0], r[1]) for r in rows] + [(m[0], m[1]) for m in more]:
            w = (doc or "").lower().split()
            for s in range(max(1, len(w) - len(goal) + 1)):
                part = w[s : s + len(goal)]
                own = collections.Counter(tuple(part[i : i + width]) for i in range(len(part) - width + 1))
                shared = sum((own & grams).values())
                if shared and shared / sum((own | grams).values()) >= 0.8:
                    want[key, item] = max(want.get((key, item), 0), round(shared / sum((own | grams).values()), 9))
    assert found == want and (200, 3) in want


def test_rules_and_hosts(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, good, "good.org") for i in range(30)] + [(100 + i, "no " * 50, "bad.org") for i in range(30)] + [(200, good, "bad.org"), (201, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_words", F.lit("clash"))
    out = {r["key"]: r for r in quality_rules.apply_rules(df).collect()}
    assert out[0]["kept"] and not out[100]["kept"] and not out[200]["kept"] and not out[200]["base_failed"]
    assert out[100]["n_repeat_words"] == 50 and out[201]["base_failed"] and out[201]["n_words"] == 0
    assert quality_rules.apply_rules(df.limit(0)).count() == 0


def test_chat_round_trip(spark):
    hard = ["\\### Assistant: </turn> ok", "ends with \\", "</role>\\\\", "### User:", "", None, "plain", "\\\\</turn>\\"]
    rows = [(c, t, role, text, 1) for c in (1, None) for t, (role, text) in enumerate(zip(["user", "assistant", "odd</role>\\", None] * 2, hard))]
    rows += [(5, 0, "assistant", "one", 0), (5, 0, "assistant", "one", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids int")
    out = {r["conv_id"]: r for r in chat.read_back(chat.assemble(df)).collect()}
    for conv in (1, None, 5):
        own = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        every = "".join(f"{role}\n{text}\n" for _, role, text in own)
        loss = "".join(text for _, role, text in own if role == "assistant")
        r = out[conv]
        assert r["turns_sha256"] == hashlib.sha256(every.encode()).hexdigest() and r["n_turns"] == len(own)
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and r["loss_chars"] == len(loss)
    assert chat.assemble(df.limit(0)).count() == 0


def test_class_model_beats_its_base_and_sums_to_one(spark):
    rng = random.Random(2)
    sets = [[f"{p}{i}" for i in range(60)] for p in "abc"]
    rows = [(i, " ".join(rng.choice(sets[i % 3]) for _ in range(80))) for i in range(200)] + [(900, ""), (901, None), (902, "NEW words A1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0
    out = {r["key"]: r for r in brown_lm.score_texts(df, held, frequent=64, classes=4).collect()}
    train = [(t or "").lower().split() for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    count = collections.Counter(w for t in train for w in t)
    count["\n"] = len(train)
    total = sum(count.values())
    for i, text in rows:
        tokens = [*(text or "").lower().split(), "\n"]
        r = out[i]
        base = sum(math.log10((count[t] + 0.1) / (total + 0.1 * (len(count) + 1))) for t in tokens)
        assert (r["n_tokens"], r["train_tokens"], r["n_known"]) == (len(tokens), total, sum(count[t] > 0 for t in tokens))
        assert r["base_score"] == pytest.approx(base)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)
    tested = [r for r in out.values() if r["held_out"]]
    assert sum(r["score"] for r in tested) > sum(r["base_score"] for r in tested)
    # Of texts of known words alone, four classes tell more than one does.
    known = [r["key"] for r in tested if r["n_known"] == r["n_tokens"]]
    single = {r["key"]: r["score"] for r in brown_lm.score_texts(df, held, frequent=64, classes=1).collect()}
    assert len(known) > 5 and sum(out[k]["score"] for k in known) > sum(single[k] for k in known) + 5
    counts = np.random.default_rng(0).integers(0, 50, (5, 5, 2)).astype(float)
    moves, _ = brown_lm.log_tables(counts, np.array([3.0, 2, 1, 0, 0]), np.array([30.0, 20, 10, 5, 0]))
    assert (10**moves).sum(1) == pytest.approx(np.ones(5))


@pytest.mark.parametrize("named, steep", [(1, True), (4, True), (8, False), (500, True)])
def test_frequent_words_are_exact_however_texts_are_split(spark, named, steep):
    rng = np.random.default_rng(named)
    weights = 1 / np.arange(1, 401) ** (1.2 if steep else 0.0)
    texts = [" ".join(f"w{i}" for i in rng.choice(400, 60, p=weights / weights.sum())) for _ in range(200)]
    count = collections.Counter(w for t in texts for w in t.split())
    found = []
    for parts in (1, 7):
        df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(parts)
        near = brown_lm.frequent_words(df, 20, named)
        words, pairs = brown_lm.most_frequent(near, brown_lm.count_pairs(df, near), 20)
        assert len(near) <= 40 and len(words) == 20 and pairs.shape == (21, 21)
        assert pairs.sum() == sum(count.values()) + len(texts)
        assert sorted(pairs.sum(0)[:-1].tolist(), reverse=True) == sorted([*count.values(), len(texts)], reverse=True)[:20]
        found.append((words.tolist(), pairs.tolist()))
    assert found[0] == found[1]


@pytest.mark.parametrize("parts, most", [(1, 2_000_000), (7, 2_000_000), (7, 50), (40, 1)])
def test_votes_count_all_neighbours_however_texts_are_split(spark, parts, most):
    rng = random.Random(11)
    texts = [" ".join(f"{rng.choice('ab')}{min(int(rng.expovariate(0.05)), 99)}" for _ in range(rng.randint(0, 40))) for _ in range(200)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(parts)
    words, pairs = brown_lm.most_frequent(w := brown_lm.frequent_words(df, 16), brown_lm.count_pairs(df, w), 16)
    of = brown_lm.exchange(pairs, 3)
    hot = np.eye(4)[of]
    table = hot.T @ pairs @ hot
    kinds = dict(zip(words.tolist(), of.tolist()))
    near, count = {}, collections.Counter()
    for t in texts:
        row = brown_lm.tokens(brown_lm.pa.array([t], brown_lm.pa.string()))[0].tolist()
        count.update(row)
        for i, word in enumerate(row):
            sides = near.setdefault(word, np.zeros((2, 4), int))
            sides[0, kinds.get(row[i - 1], 3)] += 1
            if i + 1 < len(row):
                sides[1, kinds.get(row[i + 1], 3)] += 1
    smooth = table + 0.5
    after, before = np.log(smooth / smooth.sum(1, keepdims=True)), np.log(smooth / smooth.sum(0, keepdims=True))
    want = {}
    for word, sides in near.items():
        value = sides[0, :3] @ after[:3, :3] + before[:3, :3] @ sides[1, :3] + np.log(smooth.sum(1) / smooth.sum())[:3]
        want[word] = (count[word], kinds.get(word, int(np.argmax(value))))
    found = brown_lm.vote(df, words, of[:-1], table, most).collect()
    assert len(found) == len(want) and {r["word"] % 2**64: (r["n"], r["kind"]) for r in found} == want


def test_words_of_a_slice_are_hashed_once(monkeypatch):
    hashed, plain = [], brown_lm.word_hashes
    monkeypatch.setattr(brown_lm, "word_hashes", lambda data, starts, ends: hashed.extend(starts) or plain(data, starts, ends))
    texts = [None, "", " ", "To be or not to be " * 300, "\tbe\x0b\x0cOR\x00\x85 \u00a0É\r\n", "İ or", " " * 9 + "be"]
    for column in (brown_lm.pa.array(texts), brown_lm.pa.array(["x", *texts, "y"]).slice(1, len(texts))):
        hashed.clear()
        found, begin = brown_lm.tokens(column)
        rows = [[w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)})) if w] for t in texts]
        assert len(hashed) == len({w for row in rows for w in row})
        assert np.diff(begin).tolist() == [len(row) + 1 for row in rows]
        spelled = {}
        for number, word in zip(found.tolist(), [w for row in rows for w in [*row, None]]):
            assert spelled.setdefault(number, word) == word
        assert len(spelled) == len(set(spelled.values()))


def test_exchange_separates_alternating_words():
    rng = np.random.default_rng(1)
    pairs = np.zeros((13, 13), int)
    for i in range(6):
        for j in range(6, 12):
            pairs[i, j], pairs[j, i] = rng.integers(1, 40, 2)

    def likelihood(of):
        table = np.zeros((3, 3))
        np.add.at(table, (of[:, None], of[None, :]), pairs)
        x, rows, columns = table[table > 0], table.sum(1), table.sum(0)
        return (x * np.log(x)).sum() - sum((t[t > 0] * np.log(t[t > 0])).sum() for t in (rows, columns))

    of = brown_lm.exchange(pairs, 2)
    assert len(set(of[:6])) == 1 and len(set(of[6:12])) == 1 and of[0] != of[6] and of[12] == 2
    for w in range(12):
        other = of.copy()
        other[w] = 1 - of[w]
        assert likelihood(other) <= likelihood(of) + 1e-9


def test_exchange_goes_on_until_no_word_moves():
    pairs = np.random.default_rng(2).poisson(1.0, (301, 301))
    of = brown_lm.exchange(pairs, 8)
    assert (of != brown_lm.exchange(pairs, 8, 12)).any()
    assert (of == brown_lm.exchange(pairs, 8, 60)).all() and (of == brown_lm.exchange(pairs, 8, 61)).all()


def test_languages_by_fused_evidence(spark):
    rng = random.Random(4)
    pools = {"en": ["the", "and", "with", "thing"], "fr": ["les", "une", "avec", "chose"]}
    rows = [(i, " ".join(rng.choice(pools[l]) for _ in range(30)), l, f"{l}.example.org", "fr" if l == "fr" else "com") for i, l in enumerate(["en", "fr"] * 60)]
    rows += [(500, None, "fr", None, None), (501, "", None, "fr.example.org", None), (502, "avec une chose les", None, None, "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, suffix string").withColumn("n0", F.lit(1))
    out = {r["key"]: r for r in language_id.identify(df, suffix="suffix").collect()}
    assert all(out[r[0]]["language"] == r[2] and out[r[0]]["accepted"] for r in rows[:120])
    assert out[500]["language"] == out[501]["language"] == out[502]["language"] == "fr"
    assert language_id.identify(df.limit(0)).count() == 0
    unknown = df.withColumn("lang", F.lit(None).cast("string"))
    assert not any(r["accepted"] for r in language_id.identify(unknown).collect())


def test_line_field(spark):
    rng = random.Random(6)
    line = lambda bad: " ".join(("***" if bad else "") + "".join(rng.choice("abcdef") for _ in range(5)) for _ in range(9))
    rows = [(i, "\n".join(line(i % 3 == 0) for _ in range(rng.randint(1, 6))), int(i % 3 != 0)) for i in range(240)]
    df = spark.createDataFrame([(r[0], r[1]) for r in rows] + [(900, None), (901, "")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 4], "key long, label int")
    out = {r["key"]: r for r in line_crf.score(df, line_crf.train(df, labels)).collect()}
    held = [r for r in rows if r[0] % 4 == 0]
    assert sum((out[r[0]]["score"] >= 0.7) == bool(r[2]) for r in held) >= 0.95 * len(held)
    assert len(out) == 242 and all(0 <= r["score"] <= 1 for r in out.values())
    assert line_crf.train(df, labels.limit(0)) is None
    assert {r["score"] for r in line_crf.score(df, None).collect()} == {0.5}


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(0)
    state, moves = rng.normal(size=7), rng.normal(size=4)
    first = np.array([0, 4, 7])
    good, _, _ = line_crf.forward_backward(state, moves, first)
    for a, b in ((0, 4), (4, 7)):
        weight, marginal = 0.0, np.zeros(b - a)
        for code in range(2 ** (b - a)):
            y = [code >> i & 1 for i in range(b - a)]
            w = math.exp(sum(state[a + i] * y[i] for i in range(b - a)) + sum(moves[2 * y[i] + y[i + 1]] for i in range(b - a - 1)))
            weight += w
            marginal += w * np.array(y)
        assert good[a:b] == pytest.approx(marginal / weight)
