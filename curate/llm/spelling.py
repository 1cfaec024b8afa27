"""Spelling variants: words one inserted, deleted or replaced letter apart, by bit-sliced indexes.

An index holds, for each position and letter, a bitset over its words: which of them have
that letter there. A word is matched against all words of the index at once by stepping
through its letters: one bitset says which index words agree so far without an error, two
more which agree with one error already made: a letter replaced, or one letter more, read
from positions shifted by one. (Words one letter shorter find the pair from their side.)
Each step is a few word-parallel operations on 64 index words at a time, and all sets move
together.

One error leaves one half of the shorter word whole, so two near words share its first half
at their beginning or its second half at their end. Words are dealt to indexes by these
halves: no word meets the whole vocabulary. Small groups of one length share an index, and a
group of more than ``INDEX`` words is cut into blocks, each block of queries against each
block of the index. A pair whose words share the first half counts in the group of that
half only, so every pair is found once.

Defined cases: a null text has no words, a null id is written as nothing; repeated rows count
each; very long texts are only split; a word without near words has none; ties go to the
word first in code-point order; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, shuffle_parts, stored

#: What is not part of a word.
GAPS = r"[^A-Za-z\x{C0}-\x{FF}]+"
TYPO_IN = 199
LEAST_LENGTH = 6
LEAST_COUNT = 5
FACTOR = 5
#: Words in one index, and queries that step through it together.
INDEX = 4096
QUERIES = 256


def vocabulary(
    df: DataFrame, text: str = "text", key: str = "doc_id",
    typo_in: int | None = TYPO_IN, length: int = LEAST_LENGTH, count: int = LEAST_COUNT,
) -> DataFrame:
    """(word, n): lower-cased words of ``length`` letters and ``count`` occurrences at least.

    With ``typo_in``, a word of a document loses a letter where the checksum of document and
    word divides by it.
    """
    split = F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), GAPS)
    rows = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.explode(split).alias("run"))
    long = rows.where(F.length("run") >= length)
    word = F.col("run")
    if typo_in:
        sum_ = F.crc32(F.concat_ws(":", "key", "run"))
        at = (sum_ % F.length("run")).cast("int")
        cut = F.concat(F.expr("left(run, at)"), F.expr("substring(run, at + 2)"))
        long = long.withColumn("sum", sum_).withColumn("at", at)
        word = F.when(F.col("sum") % typo_in == 0, cut).otherwise(F.col("run"))
    counted = long.select(word.alias("word")).where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= count)


def _letters(words: list[str], width: int) -> np.ndarray:
    """Code points of words in rows of ``width``, padded with zeros."""
    return np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width)


class BitIndex:
    """Bitsets over words by position and letter, made position by position as they are asked for."""

    def __init__(self, letters: np.ndarray):
        self.count, self.width = letters.shape
        self.words = -(-self.count // 64)
        self.alphabet, codes = np.unique(letters, return_inverse=True)
        self.by_position = np.ascontiguousarray(codes.reshape(letters.shape).T)

    def codes(self, letters: np.ndarray) -> np.ndarray:
        """Numbers of letters; those that no index word has share one with empty bitsets."""
        found = np.searchsorted(self.alphabet, letters)
        known = self.alphabet[np.minimum(found, len(self.alphabet) - 1)] == letters
        return np.where(known, found, len(self.alphabet))

    def at(self, position: int) -> np.ndarray:
        """One bitset a letter: the index words that have it at ``position``."""
        bits = np.zeros((len(self.alphabet) + 1, self.words * 64), np.uint8)
        if position < self.width:
            bits[self.by_position[position], np.arange(self.count)] = 1
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)

    def match(self, codes: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bitsets by query of the index words that agree with all its letters.

        Returns (replaced, longer, prefix): words of the same length with one letter
        replaced, words with one letter more, words that share the first ``half`` letters.
        Bits are right only for index words of those lengths.
        """
        queries, length = codes.shape
        exact = np.full((queries, self.words), ~np.uint64(0))
        replaced, longer, prefix = np.zeros_like(exact), np.zeros_like(exact), exact
        now = self.at(0)
        for i in range(length):
            onward = self.at(i + 1)
            step = max(1, QUERIES)
            for a in range(0, queries, step):
                rows = slice(a, a + step)
                letter = codes[rows, i]
                here = now[letter]
                longer[rows] = (longer[rows] | exact[rows]) & onward[letter]
                replaced[rows] = (replaced[rows] & here) | (exact[rows] & ~here)
                exact[rows] &= here
            if i + 1 == half:
                prefix = exact.copy()
            now = onward
        return replaced, longer | exact, prefix


def _rows(sets: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Query and index word of every set bit."""
    query, word = np.nonzero(sets)
    if not len(query):
        return query, word
    bits = np.unpackbits(sets[query, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, bit = np.nonzero(bits)
    query, word = query[at], word[at] * 64 + bit
    kept = word < count
    return query[kept], word[kept]


def _pairs(length: int, side: str, queries: list[str], words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, word) of near pairs that this side's groups must give."""
    index = BitIndex(_letters(words, length + 1))
    codes = index.codes(_letters(queries, length))
    replaced, longer, prefix = index.match(codes, length // 2)
    is_longer = np.fromiter((len(w) > length for w in words), bool, len(words))
    mask = np.packbits(np.pad(is_longer, (0, index.words * 64 - len(words))), bitorder="little").view(np.uint64)
    near = replaced & ~mask | longer & mask
    return _rows(near & prefix if side == "a" else near & ~prefix, len(words))


def near_words(vocabulary: DataFrame, index: int = INDEX) -> DataFrame:
    """(word, near, near_n): every two words of a stored vocabulary one letter apart, both ways."""
    length = F.length("word")
    one = F.lit(1)
    # The group's length is that of its shorter words, which are the queries.
    members = vocabulary.select(
        "word", "n", F.explode(F.array(F.struct(length.alias("length"), F.lit(True).alias("asks")), F.struct((length - one).alias("length"), F.lit(False).alias("asks")))).alias("as"),
    ).select("word", "n", "as.*")
    half = F.expr("length div 2")
    keys = F.array(
        F.struct(F.lit("a").alias("side"), F.substring("word", F.lit(1), half).alias("part")),
        F.struct(F.lit("b").alias("side"), F.right("word", F.col("length") - half).alias("part")),
    )
    members = members.select("word", "n", "length", "asks", F.explode(keys).alias("k")).select("word", "n", "length", "asks", "k.*")
    group = ["length", "side", "part"]
    sizes = members.groupBy(*group).agg(F.count("*").alias("size"), F.count_if("asks").alias("asking"))
    # A group without queries, or of one word, has no pairs.
    sizes = sizes.where("asking > 0 AND size > 1").select(*group, F.ceil(F.col("size") / index).cast("int").alias("blocks"))
    dealt = members.join(sizes, group).withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    # Index words go to their block once for each block of queries, queries once for each block of the index.
    every = F.expr("sequence(0, blocks - 1)")
    asked = dealt.select(*group, "word", "n", F.lit(False).alias("asks"), F.explode(every).alias("q"), F.col("own").alias("w"))
    asking = dealt.where("asks").select(*group, "word", "n", "asks", F.col("own").alias("q"), F.explode(every).alias("w"))
    place = [*group, "q", "w"]
    met = asked.unionByName(asking).repartition(shuffle_parts(vocabulary.sparkSession), *place)

    def run(batches) -> Iterator[pa.RecordBatch]:
        def found(kind, queries, words):
            if not queries or not words:
                return None
            ask, answer = _pairs(kind[0], kind[1], [w for w, _ in queries], [w for w, _ in words])
            asker = [queries[i] for i in ask.tolist()]
            other = [words[i] for i in answer.tolist()]
            # A pair of one length is found from both its words, one of two lengths from the shorter.
            turned = [(b, a) for a, b in zip(asker, other) if len(b[0]) > kind[0]]
            pairs = [*zip(asker, other), *turned]
            if not pairs:
                return None
            columns = [[a for (a, _), _ in pairs], [b for _, (b, _) in pairs], [n for _, (_, n) in pairs]]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["word", "near", "near_n"])

        kind = None
        queries: list[tuple[str, int]] = []
        words: list[tuple[str, int]] = []
        ask: list[tuple[str, int]] = []
        held: list[tuple[str, int]] = []
        last = before = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                place, word, n, asks = row[:5], *row[5:]
                if place != last:
                    if last is not None:
                        # Different groups of one length and side share an index while they are small.
                        if last[:2] != kind or last[:3] == before or len(words) + len(held) > index:
                            out = found(kind, queries, words)
                            if out:
                                yield out
                            kind, queries, words = last[:2], [], []
                        queries += ask
                        words += held
                        before = last[:3]
                    last, ask, held = place, [], []
                (ask if asks else held).append((word, n))
        for a, b in ((queries, words), (ask, held)):
            if a and b:
                out = found(last[:2] if a is ask else kind, a, b)
                if out:
                    yield out

    ordered = met.sortWithinPartitions(*place)
    return ordered.select(*place, "word", "n", "asks").mapInArrow(run, "word string, near string, near_n long")


def forms(vocabulary: DataFrame, pairs: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, n, n_near, form, form_n): form is the commonest near word, if ``factor`` times as common."""
    # The largest count first, then the smallest word.
    best = F.min_by(F.struct("near", "near_n"), F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w"))).alias("best")
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = vocabulary.join(near, "word", "left")
    kept = F.col("best.near_n") >= factor * F.col("n")
    return joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(kept, F.col("best.near")).alias("form"), F.when(kept, F.col("best.near_n")).alias("form_n"),
    )


def roots(found: DataFrame, factor: int = FACTOR) -> DataFrame:
    """Add ``root``: where the chain of forms from a word ends.

    Counts grow by ``factor`` at every step, so a chain has at most the logarithm of the
    largest count in steps; following the followed doubles what a round covers.
    """
    links = stored(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "links")
    largest = found.agg(F.max("form_n")).first()[0] or 1
    steps = math.log(max(largest, factor), factor)
    for _ in range(math.ceil(math.log2(steps + 1))):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = stored(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "links")
    return found.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(
    df: DataFrame, text: str = "text", key: str = "doc_id", typo_in: int | None = TYPO_IN,
    length: int = LEAST_LENGTH, count: int = LEAST_COUNT, factor: int = FACTOR, index: int = INDEX,
) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of the vocabulary."""
    if length < 2:
        raise ValueError("words of one letter have no halves")
    if factor < 2:
        raise ValueError("forms must be commoner than their variants, else they could go round in a ring")
    known = stored(vocabulary(df, text, key, typo_in, length, count), "vocabulary")
    found = stored(forms(known, near_words(known, index), factor), "forms")
    return roots(found, factor)
