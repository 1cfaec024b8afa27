"""Pairs of similar values in a column.

The search is exact without scoring all values against all others. Suppose two texts
score at least ``min_score``. Then so few edits part them that, of enough separate
pieces of one text, some survive and stand somewhere in the other. So

* the distinct texts are numbered and stored; what follows holds their 64-bit ids, lengths
  and short keys, never the texts;
* an inverted index lists every short stretch of every text, with its position where the
  score looks at the plain order of characters;
* each text is cut into separate pieces of one size, and the rarest of them are kept, a few
  more than edits can spoil; of the sizes that give enough pieces, the one whose kept pieces
  stand in the fewest other texts is taken;
* an equi-join of kept pieces with the index gives pairs. An edit moves what follows by one
  character at most, so a piece counts only near its own position; a pair goes on if enough
  of the kept pieces count;
* the texts of the pairs that are left are joined back and scored.

A stretch found in very many texts is salted on both sides, so that no task sees more
than a small block of texts against another such block.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..sources.scratch import stored
from .quality import value_counts

PIECE_SIZES = (1, 2, 3, 4)
# Pieces kept beyond the one that must survive: each asks for one more match of a pair.
SPARE_PIECES = 2
# Texts on each side of a block of a salted key.
TEXTS_PER_SALT = 2_000
# Below these, two similar texts need not have a surviving piece (see _edits_allowed): a
# partner's edits could spoil every character.
LEAST_SCORE = {"wratio": 77.0, "indel": 67.0, "levenshtein": 51.0}


# \s in the JVM leaves out some characters.
_SPACES = r"(?U)[\s\x1c-\x1f]+"


def _words(text: Column) -> Column:
    """Distinct words."""
    return F.array_distinct(F.filter(F.split(text, _SPACES), lambda word: word != ""))


# Higher-order functions over the columns ``words`` and ``letters``, as SQL to keep them readable.
_CHARACTERS = "array_distinct(filter(split(text, ''), c -> c <> ''))"


def _word_pieces(size: int) -> str:
    """Separate pieces of ``size`` characters within words."""
    return f"""flatten(transform(filter(words, w -> length(w) >= {size}), w -> transform(
        sequence(0, cast(length(w) div {size} as int) - 1),
        i -> named_struct('size', {size}, 'key', substr(w, i * {size} + 1, {size}), 'place', -1))))"""


def _word_stretches(size: int) -> str:
    """Every stretch of ``size`` characters within words."""
    return f"""flatten(transform(filter(words, w -> length(w) >= {size}), w -> transform(
        sequence(1, length(w) - {size - 1}), i -> substr(w, i, {size}))))"""


def _letter_run(size: int) -> str:
    return "concat(" + ", ".join(f"letters[i + {k}]" for k in range(size)) + ")"


def _pieces(size: int) -> str:
    """Separate pieces of ``size`` characters of the text without its white space."""
    return f"""transform(sequence(0, cast(size(letters) div {size} as int) - 1), j -> j * {size})"""


def _placed_pieces(size: int) -> str:
    run = f"transform({_pieces(size)}, i -> named_struct('size', {size}, 'key', {_letter_run(size)}, 'place', i))"
    return f"if(size(letters) >= {size}, {run}, array())"


def _placed_stretches(size: int) -> str:
    """Every stretch of ``size`` characters of the text without its white space, with its place."""
    run = f"transform(sequence(0, size(letters) - {size}), i -> named_struct('key', {_letter_run(size)}, 'place', i))"
    return f"if(size(letters) >= {size}, {run}, array())"


def _edits_allowed(length: Column, min_score: float, metric: str) -> Column:
    """Most pieces of a text of ``length`` that a partner's edits can spoil.

    With a text of length m a partner of length n has
    indel: n <= m(200/s - 1), and at most (1 - s/100)(m + n) characters come or go;
    levenshtein: n <= 100m/s, and at most (1 - s/100)n are changed.
    The weighted ratio's word and partial scores allow fewer (their discounts ask
    for a better match), over lengths of 2.5m and 2m. A small margin guards rounding.
    """
    if metric == "levenshtein":
        share = (100 - min_score) / min_score
    else:
        share = 2 * (100 - min_score) / min_score
    return F.floor(length * share + 1e-6).cast("int")


def _edits_between(length: Column, other: Column, min_score: float, metric: str) -> Column:
    """Most edits between two similar texts of these lengths, by the plain score."""
    whole = F.greatest(length, other) if metric == "levenshtein" else length + other
    return F.floor(whole * ((100 - min_score) / 100) + 1e-6).cast("int")


def _may_match(a: Column, b: Column, min_score: float, metric: str) -> Column:
    """Whether the lengths ``a`` and ``b`` alone leave a score of ``min_score`` possible."""
    short, long = F.least(a, b), F.greatest(a, b)
    if metric == "levenshtein":
        return short * 100.0 >= long * min_score - 1e-6
    close = short * 200.0 >= (short + long) * min_score - 1e-6
    if metric == "indel" or min_score > 100 * scores.TOKEN_WEIGHT:
        return close
    if min_score > 100 * scores.PARTIAL_WEIGHT:
        return long < short * scores.PARTIAL_FROM
    return long <= short * scores.LONG_PARTIAL_ABOVE


def _texts(df: DataFrame, column: str) -> DataFrame:
    """``(id, text, chars)`` of the distinct texts, stored, so that an id stays with its text."""
    value = F.col(f"`{column}`").cast("string")
    texts = df.select(value.alias("text")).where("text IS NOT NULL AND text <> ''").distinct()
    return stored(texts.select(F.monotonically_increasing_id().alias("id"), "text", F.length("text").alias("chars")), "texts")


def _cut(texts: DataFrame, by_words: bool) -> DataFrame:
    """Texts as their distinct words, or as their characters without white space."""
    if by_words:
        return texts.withColumn("words", _words(F.col("text")))
    squeezed = F.regexp_replace("text", _SPACES, "")
    return texts.withColumn("letters", F.filter(F.split(squeezed, ""), lambda c: c != ""))


def _listed(texts: DataFrame, by_words: bool) -> DataFrame:
    """``(id, chars, key, place)`` for every stretch, of every piece size, that a text contains.

    By words, and for white space, a key comes once for each text and without a place (-1).
    """
    cut = _cut(texts, by_words)
    if by_words:
        stretches = ", ".join([_CHARACTERS, *[_word_stretches(size) for size in PIECE_SIZES if size > 1]])
        keys = F.explode(F.expr(f"array_distinct(concat({stretches}))"))
        return cut.select("id", "chars", keys.alias("key"), F.lit(-1).alias("place"))
    blanks = f"transform(filter({_CHARACTERS}, c -> c rlike '{_SPACES}'), c -> named_struct('key', c, 'place', -1))"
    stretches = ", ".join([blanks.replace("\\", "\\\\"), *map(_placed_stretches, PIECE_SIZES)])
    return cut.select("id", "chars", F.inline(F.expr(f"concat({stretches})")))


def _kept_pieces(texts: DataFrame, frequency: DataFrame, min_score: float, metric: str, by_words: bool) -> DataFrame:
    """``(id, chars, key, place, at, kept, spoiled)``: kept piece ``at`` of ``kept``, rarest
    first, of which ``spoiled`` at most can be missing from a similar text.

    A text without enough pieces, being mostly white space, keeps all its characters,
    and ``spoiled`` is null.
    """
    cut = _cut(texts, by_words).withColumn("spoiled", _edits_allowed(F.col("chars"), min_score, metric))
    count = "aggregate(words, 0, (n, w) -> n + cast(length(w) div {} as int))" if by_words else "cast(size(letters) div {} as int)"
    pieces = _word_pieces if by_words else _placed_pieces
    sized = ", ".join(f"if({count.format(size)} > spoiled, {pieces(size)}, array())" for size in PIECE_SIZES)
    few = f"transform({_CHARACTERS}, c -> named_struct('size', 0, 'key', c, 'place', -1))"
    found = (
        cut.withColumn("found", F.expr(f"concat({sized})"))
        .select("id", "chars", "spoiled", F.inline(F.expr(f"if(size(found) > 0, found, {few})")))
        .join(frequency.hint("merge"), "key")
        .groupBy("id", "chars", "spoiled", "size")
        .agg(F.array_sort(F.collect_list(F.struct("texts", "key", "place"))).alias("pieces"))
    )
    # Rarest first; of the sizes, the one whose kept pieces stand in fewest texts.
    most = F.when(F.col("size") > 0, F.col("spoiled") + 1 + SPARE_PIECES).otherwise(F.size("pieces"))
    cost = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, piece: n + piece["texts"])
    kept = (
        found.withColumn("pieces", F.slice("pieces", F.lit(1), most))
        .groupBy("id", "chars", "spoiled")
        .agg(F.min_by(F.struct("size", "pieces"), F.struct(cost, "size")).alias("best"))
        .select("id", "chars", F.when(F.col("best.size") > 0, F.col("spoiled")).alias("spoiled"), F.col("best.pieces").alias("pieces"))
    )
    each = kept.select("id", "chars", "spoiled", F.size("pieces").alias("kept"), F.posexplode("pieces").alias("at", "piece"))
    return each.select("id", "chars", "piece.key", "piece.place", "at", "kept", "spoiled")


def _join_on_keys(probes: DataFrame, listed: DataFrame) -> DataFrame:
    """Join ``(id, key, ...)`` with ``(id, chars, key, ...)``, whose other columns become ``other_...``.

    Both sides of a frequent key are dealt out in salts, and each salt of one side meets
    each of the other.

    A text has many keys, which Spark's guess of a table's size from that of its texts leaves
    out: joins by hint, or keys would go through the driver to be broadcast.
    """
    texts = listed.groupBy("key").agg(F.count(F.lit(1)).alias("texts"))
    sizes = probes.groupBy("key").agg(F.count(F.lit(1)).alias("probes")).join(texts.hint("merge"), "key").select(
        "key",
        F.ceil(F.col("probes") / TEXTS_PER_SALT).cast("int").alias("left_salts"),
        F.ceil(F.col("texts") / TEXTS_PER_SALT).cast("int").alias("right_salts"),
    )

    def salt(salts: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(salts)).cast("int")

    def every(salts: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(salts) - 1))

    left = probes.join(sizes.hint("merge"), "key").select(*probes.columns, salt("left_salts").alias("left"), every("right_salts").alias("right"))
    others = [F.col(c).alias(f"other_{c}") for c in listed.columns if c != "key"]
    right = listed.join(sizes.hint("merge"), "key").select(*others, "key", every("left_salts").alias("left"), salt("right_salts").alias("right"))
    return left.join(right.hint("merge"), ["key", "left", "right"])


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``(a, b)``: the texts of pairs of ids, the smaller first."""
    for id_, name in (("id", "x"), ("other_id", "y")):
        # The stored texts are packed, so their files' size says little about a broadcast.
        pairs = pairs.join(texts.select(F.col("id").alias(id_), F.col("text").alias(name)).hint("merge"), id_)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _candidates(texts: DataFrame, min_score: float, metric: str) -> DataFrame:
    by_words = metric == "wratio" and min_score <= 100 * scores.TOKEN_WEIGHT
    listed = _listed(texts, by_words)
    frequency = listed.groupBy("key").agg(F.count(F.lit(1)).alias("texts"))
    kept = _kept_pieces(texts, frequency, min_score, metric, by_words)

    spoiled = F.col("spoiled")
    if by_words:
        # A text may be similar by its words while only its own pieces show it, so both sides probe.
        one_way, near = F.col("id") != F.col("other_id"), F.lit(True)
    else:
        one_way = F.struct("chars", "id") < F.struct("other_chars", "other_id")
        spoiled = F.when(spoiled.isNotNull(), _edits_between(F.col("chars"), F.col("other_chars"), min_score, metric))
        near = (F.col("place") < 0) | (F.abs(F.col("place") - F.col("other_place")) <= spoiled)
    lengths = _may_match(F.col("chars"), F.col("other_chars"), min_score, metric)
    met = _join_on_keys(kept, listed).where(lengths & one_way & near)
    needed = F.coalesce(F.col("kept") - spoiled, F.lit(1)).alias("needed")
    pairs = met.groupBy("id", "other_id", needed).agg(F.count_distinct("at").alias("matched")).where("matched >= needed")
    pairs = pairs.select("id", "other_id")
    if not by_words:
        return _sift(_with_texts(pairs, texts), min_score, metric)
    if min_score <= 100 * scores.TOKEN_WEIGHT * scores.PARTIAL_WEIGHT:
        # Here a single shared word lifts texts of unlike length over the bar: such pairs are results.
        by_word = texts.select("id", "chars", F.explode(F.transform(_words(F.col("text")), lambda w: F.xxhash64(w))).alias("key"))
        long, short = F.greatest("chars", "other_chars"), F.least("chars", "other_chars")
        shared = _join_on_keys(by_word, by_word).where(lengths & (long >= scores.PARTIAL_FROM * short) & (F.col("id") < F.col("other_id")))
        pairs = pairs.unionAll(shared.select("id", "other_id"))
    pairs = pairs.select(F.least("id", "other_id").alias("id"), F.greatest("id", "other_id").alias("other_id")).distinct()
    return _sift_by_words(_with_texts(pairs, texts), min_score)


def _sift(pairs: DataFrame, min_score: float, metric: str) -> DataFrame:
    """Drop pairs that too many edits part for the plain score.

    Replacing a character counts once here and twice in the ratio, so this only sifts.
    Short texts are scored many at once, in less time than this takes.
    """
    if metric == "levenshtein":
        return pairs
    most = _edits_between(F.length("a"), F.length("b"), min_score, metric)
    short = F.greatest(F.length("a"), F.length("b")) <= scores.SHORT
    return pairs.where(short | (F.call_function("levenshtein", F.col("a"), F.col("b"), most) >= 0))


def _sift_by_words(pairs: DataFrame, min_score: float) -> DataFrame:
    """Drop pairs that neither the plain, the word nor the partial scores can lift to ``min_score``.

    Edit distances tell, being at most the number of characters that come or go.
    """
    a, b = F.col("a"), F.col("b")

    def within(x: Column, y: Column, score: float) -> Column:
        most = _edits_between(F.length(x), F.length(y), score, "indel")
        return F.call_function("levenshtein", x, y, most) >= 0

    def in_order(text: Column) -> Column:
        return F.array_join(F.array_sort(F.filter(F.split(text, _SPACES), lambda word: word != "")), " ")

    def distinct_in_order(words: Column) -> Column:
        return F.array_join(F.array_sort(words), " ")

    word_score = min(min_score / scores.TOKEN_WEIGHT, 100.0)
    words_a, words_b = _words(a), _words(b)
    by_words = (
        F.arrays_overlap(words_a, words_b)
        | within(in_order(a), in_order(b), word_score)
        | within(distinct_in_order(words_a), distinct_in_order(words_b), word_score)
    )
    # Of two single words, the word scores say no more than the plain one.
    several = a.rlike(_SPACES) | b.rlike(_SPACES)
    alike = F.when(within(a, b, min_score), True).when(several, by_words).otherwise(False)
    if min_score > 100 * scores.PARTIAL_WEIGHT:
        return pairs.where(alike)
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    unlike_lengths = long >= short * scores.PARTIAL_FROM
    if min_score == 100 * scores.PARTIAL_WEIGHT:
        return pairs.where(F.when(unlike_lengths, a.contains(b) | b.contains(a)).otherwise(alike))
    return pairs.where(unlike_lengths | alike)


def _score(candidates: DataFrame, min_score: float, metric: str) -> DataFrame:
    if metric == "levenshtein":
        longest = F.greatest(F.length("a"), F.length("b"))
        return candidates.withColumn("score", (1 - F.levenshtein("a", "b") / longest) * 100.0)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if metric == "indel":
                values = scores.ratios(batch["a"].tolist(), batch["b"].tolist())
            else:
                values = [scores.weighted_ratio(a, b, min_score) for a, b in zip(batch["a"], batch["b"])]
            yield batch.assign(score=values)

    return candidates.mapInPandas(scored, "a string, b string, score double")


def _scored(candidates: DataFrame, min_score: float, metric: str) -> DataFrame:
    """``(a, b, score)`` of the similar ones, stored, as sorting reads its input twice."""
    return stored(_score(candidates, min_score, metric).where((F.col("score") >= min_score) & (F.col("score") < 100)), "scored")


def similar_values(
    df: DataFrame,
    column: str,
    min_score: float = 90.0,
    metric: str = "wratio",
    method: str = "exact",
) -> DataFrame:
    """All pairs of distinct values of ``column`` with ``min_score <= score < 100``.

    ``metric`` is ``wratio`` (weighted ratio, also finds reordered and extra words),
    ``indel`` (plain ratio) or ``levenshtein``; all tell case apart. ``method="lsh"``
    looks up candidates by hashed bands instead, which is cheaper for very many values
    and may miss a few in a thousand pairs; it refuses scores under 60, where it would miss
    more, and sees no reordered words. Each pair comes once, smaller value first, best pairs on top.
    """
    if metric not in LEAST_SCORE:
        raise ValueError(f"unknown metric {metric!r}; use one of {', '.join(LEAST_SCORE)}")
    if not LEAST_SCORE[metric] <= min_score < 100:
        raise ValueError(f"min_score must be at least {LEAST_SCORE[metric]:g} for {metric} and below 100")
    texts = _texts(df, column)
    if method == "exact":
        kept = _scored(_candidates(texts, min_score, metric), min_score, metric)
    elif method != "lsh":
        raise ValueError(f"unknown method {method!r}; use 'exact' or 'lsh'")
    elif metric == "indel":
        kept = _banded_ratios(texts, min_score)
    else:
        kept = _scored(_banded(texts, min_score, metric), min_score, metric)
    return kept.select(
        F.col("a").alias(column), F.col("b").alias(f"matched_{column}"), F.col("score").alias("similarity_score")
    ).orderBy(F.desc("similarity_score"), column, f"matched_{column}")


MOST_BANDS = 64
# Share of the pairs at min_score that may be missed.
MISSED = 0.002
# Stretches of so many characters, and the share of them that unlike texts have in common.
GRAMS = {2: 0.15, 3: 0.04}


def _bands(min_score: float) -> tuple[int, int, int]:
    """(characters of a stretch, bands, values in each): as selective as 64 bands allow.

    A text of n characters has about n stretches of g, and each character that differs
    spoils g of them. So the stretches of two texts at ``min_score`` overlap at least by
    (1 - spoiled) / (1 + spoiled) of all theirs, which is the chance that a value agrees.
    """
    found = []
    for size, unlike in GRAMS.items():
        spoiled = size * (100 - min_score) / 100
        if spoiled > 0.8:
            continue
        alike = (1 - spoiled) / (1 + spoiled)
        for values in range(1, 9):
            bands = ceil(log(MISSED) / log1p(-(alike**values)))
            if bands <= MOST_BANDS:
                found.append((bands * unlike**values, size, bands, values))
    if not found:
        raise ValueError(f"no bands find texts as unlike as a score of {min_score:g}; use method='exact' or a score of 60 and more")
    return min(found)[1:]


_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(2**64 - 1)


def _scatter(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _least_by_bin(texts: list[str], size: int, bins: int) -> np.ndarray:
    """For each text the least hash in every bin: each stretch is hashed once.

    The hash names the bin. A bin without a stretch takes the value of another bin, tried in
    an order that is its own and the same for all texts, until one is not empty; so a value
    agrees as often as the stretches of two texts overlap, however few they are.
    """
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    row = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(chars)) - np.repeat(ends - lengths, lengths)
    # A shorter text is one stretch, ended by zeros.
    begins = np.flatnonzero(place <= np.maximum(lengths[row] - size, 0))
    hashed = np.zeros(len(begins), np.uint64)
    padded = np.concatenate([chars, np.zeros(size, np.uint64)])
    for k in range(size):
        inside = place[begins] + k < lengths[row[begins]]
        hashed = _scatter(hashed * _MULTIPLY + np.where(inside, padded[begins + k] + np.uint64(1), np.uint64(0)))
    least = np.full((len(texts), bins), _EMPTY)
    np.minimum.at(least, (row[begins], (hashed % np.uint64(bins)).astype(np.int64)), hashed)
    filled = least != _EMPTY
    rows, empty = np.nonzero(~filled)
    attempt = 0
    while len(rows):
        attempt += 1
        # After many tries, which only texts of a few characters need, bins are tried in turn.
        tried = _scatter((empty * 1_000_003 + attempt).astype(np.uint64)) % np.uint64(bins) if attempt < 4 * bins else (empty + attempt) % bins
        tried = tried.astype(np.int64)
        ok = filled[rows, tried]
        least[rows[ok], empty[ok]] = least[rows[ok], tried[ok]]
        rows, empty = rows[~ok], empty[~ok]
    return least


def _counted_bits(texts: list[str]) -> np.ndarray:
    """For each text 128 bits, of which an insertion or deletion of a character flips one.

    The characters, each with its number among its equals in the text, flip bits by their hash.
    So texts differ in no more bits than characters come or go.
    """
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    order = np.lexsort((chars, row))
    chars, row = chars[order], row[order]
    begins = np.flatnonzero(np.r_[True, (chars[1:] != chars[:-1]) | (row[1:] != row[:-1])][: len(chars)])
    number = np.arange(len(chars)) - np.repeat(begins, np.diff(np.r_[begins, len(chars)]))
    bit = _scatter(_scatter(chars + np.uint64(1)) * _MULTIPLY + number.astype(np.uint64)) % np.uint64(128)
    bits = np.zeros((len(texts), 2), np.uint64)
    np.bitwise_xor.at(bits, (row, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return bits


def _bits_agree(min_score: float, metric: str) -> Column:
    """Whether ``bits`` leave a plain score of ``min_score`` possible; replacing a character flips two."""
    edits = _edits_between(F.col("chars"), F.col("other_chars"), min_score, metric)
    flipped = [F.bit_count(F.col(name).bitwiseXOR(F.col(f"other_{name}"))) for name in ("low_bits", "high_bits")]
    return flipped[0] + flipped[1] <= edits * (2 if metric == "levenshtein" else 1)


# Characters whose stretches a task hashes at once.
HASHED_AT_ONCE = 1 << 20


# A key that so many texts have, and this share of them at least, is frequent.
FREQUENT_FROM, FREQUENT_SHARE = 100, 1 / 64
# Texts and characters on each side of a block, and tasks that blocks are dealt to at most.
TEXTS_PER_BLOCK, CHARS_PER_BLOCK = 4_000, 1 << 25
MOST_BLOCK_TASKS = 1_000
# Pairs of a block that are looked at together, and characters of those handed on together.
MET_AT_ONCE, CHARS_AT_ONCE = 1 << 20, 1 << 23


def _banded(texts: DataFrame, min_score: float, metric: str) -> DataFrame:
    """Candidates ``(a, b)`` that agree on all values of a band."""
    pairs, dense, keys = _banded_pairs(texts, min_score, metric)
    if metric == "wratio":
        return _sift_by_words(pairs, min_score)
    if keys:
        pairs = pairs.unionAll(_met_in_blocks(dense, keys, min_score, metric).select("a", "b"))
    return _sift(pairs, min_score, metric)


def _banded_ratios(texts: DataFrame, min_score: float) -> DataFrame:
    """``(a, b, score)`` of the candidates that are similar by the plain ratio, stored.

    Pairs that meet in blocks are scored there, if their texts are short enough.
    """
    pairs, dense, keys = _banded_pairs(texts, min_score, "indel")
    if not keys:
        return _scored(_sift(pairs, min_score, "indel"), min_score, "indel")
    met = stored(_met_in_blocks(dense, keys, min_score, "indel", scored=True), "met")
    pairs = pairs.unionAll(met.where("score IS NULL").select("a", "b"))
    return met.where("score IS NOT NULL").unionAll(_scored(_sift(pairs, min_score, "indel"), min_score, "indel"))


def _banded_pairs(texts: DataFrame, min_score: float, metric: str) -> tuple[DataFrame, DataFrame, int]:
    """``(a, b)`` of pairs that share a rare band key only; the texts with frequent keys, which
    are yet to meet, and how many frequent keys there are.

    Texts with a common frame have some keys that a great part of all texts have, and similar
    texts share several of them. Such keys would bring most pairs, each many times. So
    texts with frequent keys, at most 64 in a band, meet in blocks, each pair once; those
    that share a rare key but no frequent one meet by an equi-join.
    """
    size, bands, values = _bands(min_score)
    # Hashing takes long for the size of the texts, by which Spark cuts files.
    spread = texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray]]:
        for batch in batches:
            lengths = np.cumsum(np.asarray(batch.column(2)))
            begin = 0
            while begin < batch.num_rows:
                before = lengths[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(lengths, before + HASHED_AT_ONCE)))
                part = batch.slice(begin, end - begin)
                strings = part.column(1).to_pylist()
                least = _least_by_bin(strings, size, bands * values).reshape(-1, bands, values)
                key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), least.shape[:2])
                for i in range(values):
                    key = _scatter(key * _MULTIPLY + least[:, :, i])
                yield part, strings, key.view(np.int64)
                begin = end

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, key in keys_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1))], names=["key"])

    frequent_keys = np.array([], np.int64)
    if metric != "wratio":  # whose words may be reordered, which bits do not tell
        least = max(FREQUENT_FROM, texts.count() * FREQUENT_SHARE)
        counts = spread.mapInArrow(keys, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("texts"))
        frequent_keys = np.array(sorted(row.key for row in counts.where(F.col("texts") >= least).collect()), np.int64)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, strings, key in keys_of(batches):
            found = np.searchsorted(frequent_keys, key)
            frequent = np.isin(key, frequent_keys)
            bits = _counted_bits(strings).view(np.int64)

            def lists(held: np.ndarray, of: np.ndarray) -> pa.ListArray:
                ends = np.cumsum(held.sum(axis=1))
                return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(of[held]))

            columns = [*part.columns, pa.array(bits[:, 0]), pa.array(bits[:, 1])]
            columns += [lists(frequent, found.astype(np.int16)), lists(~frequent, key)]
            names = ["id", "text", "chars", "low_bits", "high_bits", "frequent", "rare"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "id long, text string, chars int, low_bits long, high_bits long, frequent array<smallint>, rare array<long>"
    banded = stored(spread.mapInArrow(marked, schema), "bands")
    keyed = banded.select("id", "chars", "low_bits", "high_bits", "frequent", F.explode("rare").alias("key"))
    met = _join_on_keys(keyed, keyed).where(
        (F.col("id") < F.col("other_id")) & _may_match(F.col("chars"), F.col("other_chars"), min_score, metric)
    )
    if metric == "wratio":
        return _with_texts(met.select("id", "other_id").distinct(), texts), banded, 0
    met = met.where(_bits_agree(min_score, metric)).where(~F.arrays_overlap("frequent", "other_frequent"))
    pairs = _with_texts(met.select("id", "other_id").distinct(), texts)
    return pairs, banded.where(F.size("frequent") > 0), len(frequent_keys)


def _met_in_blocks(banded: DataFrame, keys: int, min_score: float, metric: str, scored: bool = False) -> DataFrame:
    """``(a, b, score)``: the pairs that share one of the numbered ``keys`` and whose bits agree.

    ``scored``: short texts get their plain ratio here, from tables of the block's characters, and
    of these pairs only the similar ones go on. The others have no score.
    """
    held = banded.agg(F.count(F.lit(1)).alias("texts"), F.sum("chars").alias("chars")).first()
    groups = max(1, ceil(held.texts / TEXTS_PER_BLOCK), ceil((held.chars or 0) / CHARS_PER_BLOCK))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        own, names = np.asarray(table["own"]), ("left", "right")
        groups = [table[name][0].as_py() for name in names]
        text, chars, bits, shared = [], [], [], []
        for group in groups:
            side = table.filter(pa.array(own == group)).combine_chunks()
            text.append(side["text"].combine_chunks() if side.num_rows else pa.array([], pa.string()))
            chars.append(np.asarray(side["chars"]).astype(np.int64))
            bits.append([np.asarray(side[name]).view(np.uint64) for name in ("low_bits", "high_bits")])
            numbers = [np.asarray(numbers, np.int64) for numbers in side["frequent"].to_numpy()]
            row = np.repeat(np.arange(len(numbers)), [len(x) for x in numbers])
            number = np.concatenate([np.empty(0, np.int64), *numbers])
            words = np.zeros((len(numbers), (keys + 63) // 64), np.uint64)
            np.bitwise_or.at(words, (row, number >> 6), np.uint64(1) << (number & 63).astype(np.uint64))
            shared.append(words)
        if not len(text[0]) or not len(text[1]):
            return
        both = np.maximum.outer if metric == "levenshtein" else np.add.outer
        flips = 2 if metric == "levenshtein" else 1
        # For each length on the left, how many bits may differ from each text on the right.
        lengths, of_length = np.unique(chars[0], return_inverse=True)
        most = np.minimum(np.floor(both(lengths, chars[1]) * ((100 - min_score) / 100) + 1e-6) * flips, 128).astype(np.uint8)
        ratios = scores.Ratios(*(side.to_pylist() for side in text)) if scored else None
        step = max(1, MET_AT_ONCE // len(text[1]))
        for begin in range(0, len(text[0]), step):
            some = slice(begin, begin + step)
            differ = sum(np.bitwise_count(x[some, None] ^ y[None, :]) for x, y in zip(*bits))
            x, y = np.nonzero(differ <= most[of_length[some]])
            x += begin
            short, long = np.minimum(chars[0][x], chars[1][y]), np.maximum(chars[0][x], chars[1][y])
            if metric == "levenshtein":
                kept = short * 100.0 >= long * min_score - 1e-6
            else:
                kept = short * 200.0 >= (short + long) * min_score - 1e-6
            if groups[0] == groups[1]:
                kept &= x < y
            x, y = x[kept], y[kept]
            kept = (shared[0][x] & shared[1][y]).any(axis=1)
            x, y = x[kept], y[kept]
            score = np.full(len(x), np.nan)
            if ratios is not None:
                fits = ratios.fits_a[x] & ratios.fits_b[y]
                score[fits] = ratios.of(x[fits], y[fits])
                kept = ~fits | (score >= min_score) & (score < 100)
                x, y, score = x[kept], y[kept], score[kept]
            cuts = np.flatnonzero(np.diff(np.cumsum(chars[0][x] + chars[1][y]) // CHARS_AT_ONCE)) + 1
            for i, j, found in zip(np.split(x, cuts), np.split(y, cuts), np.split(score, cuts)):
                columns = [text[0].take(pa.array(i)), text[1].take(pa.array(j)), pa.array(found, from_pandas=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["x", "y", "score"])

    own = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")
    dealt = banded.select("text", "chars", "low_bits", "high_bits", "frequent", own.alias("own")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    )
    dealt = dealt.withColumn("left", F.least("own", "other")).withColumn("right", F.greatest("own", "other")).drop("other")
    # By number, so that small blocks, which bring many pairs, keep tasks of their own.
    dealt = dealt.repartition(min(groups * (groups + 1) // 2, MOST_BLOCK_TASKS), "left", "right")
    pairs = dealt.groupBy("left", "right").applyInArrow(meet, "x string, y string, score double")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score")


def suggest_replacements(
    df: DataFrame, column: str, min_score: float = 90.0, metric: str = "wratio", method: str = "exact"
) -> DataFrame:
    """Rows ``(original_value, new_value, original_count, new_count, similarity_score)``:
    of each similar pair, the rarer value with the more frequent one to take its place."""
    pairs = similar_values(df, column, min_score, metric, method).toDF("a", "b", "similarity_score")
    counts = value_counts(df.select(F.col(f"`{column}`").cast("string").alias("value")), "value")
    joined = pairs.join(counts.toDF("a", "a_count"), "a").join(counts.toDF("b", "b_count"), "b")
    swap = F.col("a_count") > F.col("b_count")

    def side(first: str, second: str) -> Column:
        return F.when(swap, F.col(first)).otherwise(F.col(second))

    return joined.select(
        side("b", "a").alias("original_value"),
        side("a", "b").alias("new_value"),
        side("b_count", "a_count").alias("original_count"),
        side("a_count", "b_count").alias("new_count"),
        "similarity_score",
    )
