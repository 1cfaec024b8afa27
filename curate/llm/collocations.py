"""Phrase collocations by rolling fingerprints.

A task turns its texts into words, each a 64-bit number, and sums them with rising powers of
an odd base (modulo 2**64). The difference of two such prefix sums, scaled back by the
inverse power, is the Rabin-Karp fingerprint of the words between, so every phrase of every
length costs a subtraction and a product. Fingerprints are counted per task and summed over
tasks by a shuffle; a phrase can only be frequent if its parts are, so pairs are sent only
where both words are frequent, and longer phrases only where all their pairs are. What is
frequent is handed on as a bitmap of bounded size, which may let more through, never less.

The last pass goes over the texts again with the bitmaps of all lengths. Each hit is a
pointer into the text at hand. Within a slice of text, words with equal numbers are compared
byte by byte and phrases with equal fingerprints word by word, so collisions fall apart;
only then is a phrase cut out of the text, once for each slice, with its count and the
key of its text. Spark sums these by the phrase itself. Counts are therefore those of texts,
whatever the fingerprints do.

Defined cases: a null text is empty and has no phrases; a null language is ``und``; repeated
rows count each; a very long text is a slice of its own; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, slices, stored, utf8

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
UNKNOWN = "und"

_BASE = 0x9E3779B97F4A7C15
_BASE_BACK = np.uint64(pow(_BASE, -1, 2**64))
_LENGTHS = 0xC2B2AE3D27D4EB4F
_BASE_STEP = np.uint64(_BASE)
#: What the first 0 to 8 bytes of eight cover.
_HEADS = np.array([2 ** (8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes of a word from which it is hashed by itself.
_LONG_WORD = 1 << 12

#: Words between which no phrase reaches.
_CUTS = bytes(byte in b".,;:!?\n\x0b\x0c\r" for byte in range(256))
_APART = bytes(byte in b".,;:!?\n\x0b\x0c\r \t" for byte in range(256))
_LOWER = bytes(byte + 32 if 65 <= byte < 91 else byte for byte in range(256))

#: Bits for each frequent fingerprint, and the most bits of a bitmap (8 MB).
BITS_EACH = 32
MOST_BITS = 1 << 26
#: Distinct fingerprints that a task holds before it sends them.
HELD = 1 << 21


class Sieve:
    """A bitmap in which each fingerprint has two bits, from its leading and its trailing digits."""

    def __init__(self, words: np.ndarray, log2: int):
        self.words, self.log2 = words, log2

    def has(self, fps: np.ndarray) -> np.ndarray:
        leading, trailing = fps >> np.uint64(64 - self.log2), fps & np.uint64((1 << self.log2) - 1)
        return self._lit(leading) & self._lit(trailing)

    def _lit(self, slot: np.ndarray) -> np.ndarray:
        return (self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def sieve(fingerprints: DataFrame, most: int = MOST_BITS) -> Sieve:
    """The bitmap of a stored column ``fp``; its size grows with the rows up to ``most`` bits."""
    rows = fingerprints.count()
    log2 = min(most.bit_length() - 1, max(10, (rows * BITS_EACH).bit_length()))
    slots = F.array(F.shiftrightunsigned("fp", 64 - log2), F.col("fp").bitwiseAND((1 << log2) - 1))
    found = fingerprints.select(F.explode(slots).alias("slot"))
    found = found.select(F.shiftright("slot", 6).alias("word"), F.col("slot").bitwiseAND(63).cast("int").alias("bit"))
    # At most one row for each 64 bits comes to the driver.
    lit = found.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("lit")).toArrow()
    words = np.zeros((1 << log2) // 64, np.uint64)
    words[np.asarray(lit["word"])] = np.asarray(lit["lit"]).view(np.uint64)
    return Sieve(words, log2)


def _spans(data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the first word of each row (rows + 1 entries)."""
    apart = np.ones(len(data) + 2, bool)
    apart[1:-1] = np.frombuffer(data.translate(_APART), bool)
    edges = np.flatnonzero(apart[1:] != apart[:-1])
    starts, ends = edges[::2], edges[1::2]
    # A word also ends where its row does.
    cuts = np.unique(bounds[1:-1])
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = cuts[~apart[cuts] & ~apart[cuts + 1]]
    starts = np.insert(starts, np.searchsorted(starts, cuts), cuts)
    ends = np.insert(ends, np.searchsorted(ends, cuts), cuts)
    return starts, ends, np.searchsorted(starts, bounds)


def _chunks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number; ``data`` has eight more at its end."""
    return np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))


def _hashes(data: np.ndarray, chunks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, from its bytes taken eight at a time."""
    lengths = ends - starts
    out = lengths.astype(np.uint64)
    rows = np.arange(len(starts))
    done = 0
    while len(rows):
        out[rows] = mix(out[rows] * _BASE_STEP + (chunks[starts[rows] + done] & _HEADS[np.minimum(lengths[rows] - done, 8)]))
        done += 8
        rows = rows[lengths[rows] > done]
        if done >= _LONG_WORD:
            break
    import xxhash

    for i in rows.tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


class Text:
    """The words of a slice of texts and the fingerprints of their phrases."""

    def __init__(self, batch: pa.RecordBatch, bits: int = 64):
        import xxhash

        data, self.bounds = utf8(batch.column(1))
        raw = data.tobytes().translate(_LOWER)
        self.data = np.frombuffer(raw + bytes(8), np.uint8)
        self.chunks = _chunks(self.data)
        self.starts, self.ends, first = _spans(raw, self.bounds)
        self.row = np.repeat(np.arange(batch.num_rows), np.diff(first))
        # Goes up at every cut and every new row, so equal numbers mean one piece.
        self.piece = np.cumsum(np.frombuffer(raw.translate(_CUTS), np.int8), dtype=np.int32)[self.starts] + self.row
        self.keep = np.uint64(2**bits - 1)
        self.values = _hashes(self.data, self.chunks, self.starts, self.ends) & self.keep
        powers = np.cumprod(np.full(len(self.values), _BASE, np.uint64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.values * powers, dtype=np.uint64)])
        self.back = np.cumprod(np.full(len(self.values), _BASE_BACK, np.uint64))
        langs = [lang if lang is not None else UNKNOWN for lang in batch.column(2).to_pylist()]
        self.names = list(dict.fromkeys(langs))
        codes = {lang: i for i, lang in enumerate(self.names)}
        self.lang = np.array([codes[lang] for lang in langs], np.int64)[self.row]
        self.salt = np.array([xxhash.xxh64_intdigest(lang) for lang in self.names], np.uint64)[self.lang]

    def phrases(self, size: int) -> np.ndarray:
        """First words of all phrases of ``size`` words."""
        if len(self.piece) < size:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.piece[: len(self.piece) - size + 1] == self.piece[size - 1 :])

    def fingerprints(self, at: np.ndarray, size: int) -> np.ndarray:
        rolled = (self.sums[at + size] - self.sums[at]) * self.back[at]
        return mix((rolled & self.keep) ^ self.salt[at] + np.uint64(size * _LENGTHS % 2**64))

    def sifted(self, sizes, sieves: dict[int, Sieve]) -> Iterator[tuple[int, np.ndarray]]:
        """First words of the phrases whose words, and from three words on whose pairs, are in the sieves."""
        fits: dict[int, np.ndarray] = {}
        for size in sizes:
            at = self.phrases(size)
            step = min(size - 1, 2)
            if step in sieves:
                if step not in fits:
                    whole = self.phrases(step)
                    fits[step] = np.zeros(len(self.starts), bool)
                    fits[step][whole] = sieves[step].has(self.fingerprints(whole, step))
                for i in range(size - step + 1):
                    at = at[fits[step][at + i]]
            yield size, at

    def word_ids(self) -> np.ndarray:
        """One number for each different word; equal numbers are equal bytes."""
        import pandas as pd

        ids, different = pd.factorize(self.values)
        first = np.zeros(len(different), np.int64)
        first[ids[::-1]] = np.arange(len(ids))[::-1]
        lengths = self.ends - self.starts
        twin = first[ids]
        same = bool((lengths == lengths[twin]).all())
        rows, done = np.flatnonzero(twin != np.arange(len(twin))), 0
        while same and len(rows):
            head = _HEADS[np.minimum(lengths[rows] - done, 8)]
            a, b = self.chunks[self.starts[rows] + done], self.chunks[self.starts[twin[rows]] + done]
            same = not ((a ^ b) & head).any()
            done += 8
            rows = rows[lengths[rows] > done]
        if not same:
            raw = self.data.tobytes()
            known: dict[bytes, int] = {}
            words = (raw[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist()))
            ids = np.array([known.setdefault(word, len(known)) for word in words], np.int64)
        return ids

    def cut_out(self, at: np.ndarray, size: int) -> pa.Array:
        """The phrases of ``size`` words from ``at`` on, their words joined by one space."""
        begin, end = self.starts[at], self.ends[at + size - 1]
        plain = np.ones(len(at), bool)
        for i in range(size - 1):
            gap = self.ends[at + i]
            plain &= (self.starts[at + i + 1] - gap == 1) & (self.data[gap] == 0x20)
        spans = [(begin, end)]
        if not plain.all():
            # Words apart by more than a space are brought together one by one.
            spans = [(self.starts[at + i], self.ends[at + i]) for i in range(size)]
        lengths = sum(b - a for a, b in spans) + len(spans) - 1
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        out = np.full(int(offsets[-1]), 0x20, np.uint8)
        to = offsets[:-1].astype(np.int64)
        for a, b in spans:
            n = b - a
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(to, n) + place] = self.data[np.repeat(a, n) + place]
            to = to + n + 1
        return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _tally(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    fps, counts = (np.concatenate(x) for x in zip(*found))
    fps, which = np.unique(fps, return_inverse=True)
    return fps, np.bincount(which, counts, len(fps)).astype(np.int64)


def _counted(texts: DataFrame, sizes: range, sieves, bits: int) -> DataFrame:
    """(size, fp, count) of the phrases whose parts may be frequent, summed by task."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        part = sieves.value if sieves else {}
        held: dict[int, list] = {size: [] for size in sizes}

        def flush(size):
            fps, counts = _tally(held[size])
            held[size] = []
            columns = [pa.array(np.full(len(fps), size, np.int32)), pa.array(fps.view(np.int64)), pa.array(counts)]
            return pa.RecordBatch.from_arrays(columns, names=["size", "fp", "count"])

        for batch in slices(batches, 1):
            text = Text(batch, bits)
            for size, at in text.sifted(sizes, part):
                if not len(at):
                    continue
                held[size].append(np.unique(text.fingerprints(at, size), return_counts=True))
                if len(held[size]) > 1 and sum(len(fps) for fps, _ in held[size]) > HELD:
                    held[size] = [_tally(held[size])]
                    if len(held[size][0][0]) > HELD // 2:
                        yield flush(size)
        for size in sizes:
            if held[size]:
                yield flush(size)

    rows = texts.mapInArrow(run, "size int, fp long, count long")
    return rows.groupBy("size", "fp").agg(F.sum("count").alias("count"))


def _cut_out(texts: DataFrame, sieves, longest: int, bits: int) -> DataFrame:
    """(lang, size, phrase, count, example) of all phrases the sieves let through; size 0 counts words."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        part = sieves.value
        for batch in slices(batches, 1):
            text = Text(batch, bits)
            keys = batch.column(0)
            names = pa.array(text.names, pa.string())

            def rows(at, size, counts):
                """A phrase from each of ``at``."""
                return pa.RecordBatch.from_arrays(
                    [
                        names.take(pa.array(text.lang[at])), pa.array(np.full(len(at), size, np.int32)), text.cut_out(at, size),
                        pa.array(counts.astype(np.int64)), keys.take(pa.array(text.row[at])),
                    ],
                    names=_CUT_OUT,
                )

            none = pa.nulls(len(names), pa.int64())
            words = np.bincount(text.lang, minlength=len(names))
            zeros = pa.array(np.zeros(len(names), np.int32))
            yield pa.RecordBatch.from_arrays([names, zeros, pa.array([""] * len(names)), pa.array(words), none], names=_CUT_OUT)
            ids = text.word_ids()
            for size, at in text.sifted(range(1, longest + 1), part):
                fps = text.fingerprints(at, size)
                hit = part[size].has(fps)
                at, fps = at[hit], fps[hit]
                if not len(at):
                    continue
                _, first, which, counts = np.unique(fps, return_index=True, return_inverse=True, return_counts=True)
                twin = at[first][which]
                same = text.lang[at] == text.lang[twin]
                for i in range(size):
                    same &= ids[at + i] == ids[twin + i]
                mixed = np.unique(which[~same])
                clear = np.setdiff1d(np.arange(len(first)), mixed, assume_unique=True)
                yield rows(at[first[clear]], size, counts[clear])
                # Fingerprints that stand for several phrases here: these are told apart by their words.
                apart: dict[tuple, list] = {}
                for p in at[np.isin(which, mixed)].tolist() if len(mixed) else []:
                    apart.setdefault((int(text.lang[p]), *ids[p : p + size].tolist()), []).append(p)
                if apart:
                    yield rows(np.array([p[0] for p in apart.values()]), size, np.array([len(p) for p in apart.values()]))

    cut = texts.mapInArrow(run, "lang string, size int, phrase string, count long, key long")
    return cut.groupBy("lang", "size", "phrase").agg(F.sum("count").alias("count"), F.min("key").alias("example"))


_CUT_OUT = ["lang", "size", "phrase", "count", "key"]


def phrase_counts(
    df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
    longest: int = LONGEST, min_count: int = MIN_COUNT, bits: int = 64, most: int = MOST_BITS,
) -> DataFrame:
    """(lang, size, phrase, count, example) of all phrases of up to ``longest`` words, exact.

    Size 0 holds the number of words of each language. ``example`` is the key of a text
    with the phrase. ``bits`` are those kept of words and fingerprints.
    """
    if longest < 2:
        raise ValueError("phrases have two words at least")
    spark = df.sparkSession
    texts = df.select(F.col(key).cast("long"), F.col(text), F.col(lang).cast("string"))
    found: dict[int, Sieve] = {}
    sieves = None
    for sizes in (range(1, 2), range(2, 3), range(3, longest + 1)):
        if not sizes:
            continue
        frequent = stored(_counted(texts, sizes, sieves, bits).where(F.col("count") >= min_count).select("size", "fp"), "frequent")
        for size in sizes:
            found[size] = sieve(frequent.where(F.col("size") == size), most)
        sieves = spark.sparkContext.broadcast(dict(found))
    counted = _cut_out(texts, sieves, longest, bits)
    return stored(counted.where((F.col("size") == 0) | (F.col("count") >= min_count)), "phrases")


def score_cuts(counts: DataFrame) -> DataFrame:
    """Every phrase of two words and more with its lowest-scoring cut: a, l, r, n, score, k.

    score is floor(1000 * a * n / (l * r)) in decimals of 38 digits, which hold both
    products exactly while counts stay under 10**17.
    """
    wide = "decimal(19,0)"
    parts = counts.where("size > 0").select("lang", F.col("phrase").alias("part"), F.col("count").alias("times"))
    # Stored by itself, so that Spark knows how small it is.
    totals = stored(counts.where("size = 0").select(F.col("lang").alias("of"), F.col("count").alias("n")), "totals")
    words = F.split("phrase", " ")
    cuts = (
        counts.where("size > 1")
        .select("lang", "size", "phrase", "example", F.col("count").alias("a"), words.alias("words"), F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
        .withColumn("left", F.array_join(F.slice("words", F.lit(1), F.col("k")), " "))
        .withColumn("right", F.array_join(F.slice("words", F.col("k") + 1, F.col("size")), " "))
        .drop("words")
    )
    for side, name in (("left", "l"), ("right", "r")):
        of = parts.select(F.col("lang").alias("of"), F.col("part").alias(side), F.col("times").alias(name))
        cuts = cuts.join(of, (F.col("lang") == F.col("of")) & (cuts[side] == of[side])).drop("of", side)
    cuts = cuts.join(totals, F.col("lang") == F.col("of")).drop("of")
    score = F.expr(
        f"(CAST(a AS {wide}) * CAST(n AS {wide}) * CAST(1000 AS decimal(4,0))) div (CAST(l AS {wide}) * CAST(r AS {wide}))"
    )
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    lowest = cuts.groupBy("lang", "size", "phrase", "a", "n").agg(best, F.first("example").alias("example"))
    return lowest.select("lang", "size", "phrase", "a", "cut.l", "cut.r", "n", "cut.score", "cut.k", "example")


def absorbed(counts: DataFrame, percent: int = 100) -> DataFrame:
    """(lang, phrase) of the phrases inside a longer one with at least ``percent`` of their count.

    A phrase between the two lengths occurs as often as the longer at least, so it is enough
    to look at phrases with one word more.
    """
    words = F.split("phrase", " ")
    shorter = F.array(
        F.array_join(F.slice(words, F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("size") - 1), " ")
    )
    longer = counts.where("size > 2").select("lang", F.explode(shorter).alias("phrase"), F.col("count").alias("times"))
    inside = longer.groupBy("lang", "phrase").agg(F.max("times").alias("times"))
    found = counts.where("size > 1").join(inside, ["lang", "phrase"])
    return found.where(100 * F.col("times") >= percent * F.col("count")).select("lang", "phrase")


def collocations(
    df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
    longest: int = LONGEST, min_count: int = MIN_COUNT, top: int | None = TOP, percent: int = 100, bits: int = 64,
) -> DataFrame:
    """The ``top`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score, example.

    ``top=None`` returns all, without a rank.
    """
    counts = phrase_counts(df, text, lang, key, longest, min_count, bits)
    scored = score_cuts(counts).join(absorbed(counts, percent), ["lang", "phrase"], "left_anti").drop("size", "k")
    if top is None:
        return scored
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "example")
