"""Passages of a benchmark in documents (native: expressions, joins, aggregates).

A document leaks an item if some window as long as the item resembles it: word shingles
(five words, lower case) as weighted sets, weights being counts, sum of minima over sum of
maxima at least 0.8.

1. Shingles of all documents meet the benchmark's different shingles; documents without
   any hold no such window. Only keys go on.
2. Every item-sized window with a shingle of an item of that size gets a SimHash: weighted
   counts for all 64 bits, two to a number.
3. Fingerprints are cut into ``radius + 1`` blocks. Two at most ``radius`` bits apart agree
   in a block, so joins by block meet all of them; a pair counts at its first such block.
   At similarity 0.8 ten bits differ on average; the radius of 23 is five deviations more.
4. Pairs in the radius are verified by the exact similarity.

The benchmark's shingles are sent to all tasks only while there are at most
``MOST_SENT`` of them; beyond, the join is left to Spark.

Defined cases: null and empty texts and items leak nothing; an item under five words is one
shingle; a document shorter than an item is one window; rows equal in key and text give one
result; a null key is a key; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored, words

SHINGLE = 5
LEAST = 0.8
RADIUS = 23
MOST_SENT = 1_000_000


def _shingles(found: Column, width: Column | int) -> Column:
    width = width if isinstance(width, Column) else F.lit(width)
    each = let(found, lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.xxhash64(F.slice(w, i, width))))
    return F.when(F.size(found) >= width, each).otherwise(F.array().cast("array<bigint>"))


def simhash(grams: Column) -> Column:
    """Bits set in over half the shingles; bits b and b + 32 are counted in one sum."""

    def pair_of_bits(v: Column, b: int) -> Column:
        ones = F.lit((1 << 32) + 1)
        counted = F.aggregate(v, F.lit(0).cast("long"), lambda total, h: total + F.shiftrightunsigned(h, b).bitwiseAND(ones))
        low, high = F.lit(1 << b).cast("long"), F.lit(-(1 << 63) if b == 31 else 1 << (b + 32)).cast("long")
        none = F.lit(0).cast("long")

        def decided(n: Column) -> Column:
            first = F.when(n.bitwiseAND(F.lit(2**32 - 1)) * 2 > F.size(v), low).otherwise(none)
            return first.bitwiseOR(F.when(F.shiftrightunsigned(n, 32) * 2 > F.size(v), high).otherwise(none))

        return let(counted, decided)

    def of(v: Column) -> Column:
        return reduce(lambda a, b: a.bitwiseOR(b), [pair_of_bits(v, b) for b in range(32)])

    return let(grams, of)


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of radius + 1 blocks over 64 bits."""
    n = radius + 1
    sizes = [64 // n + (i < 64 % n) for i in range(n)]
    return [(sum(sizes[:i]), size) for i, size in enumerate(sizes)]


def _block(fp: Column, first: int, size: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << size) - 1))


def _block_keys(fp: Column, radius: int) -> Column:
    return F.array(*(F.struct(F.lit(i).alias("block"), _block(fp, first, size).alias("bits")) for i, (first, size) in enumerate(_blocks(radius))))


def weighted_similarity(a: Column, b: Column) -> Column:
    def times(of: Column, gram: Column) -> Column:
        return F.size(F.filter(of, lambda x: x == gram))

    shared = F.aggregate(
        F.array_intersect(a, b), F.lit(0), lambda total, g: total + F.least(times(a, g), times(b, g))
    )
    return let(shared, lambda s: s / (F.size(a) + F.size(b) - s))


def leaks(
    df: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id",
    item_text: str = "text", shingle: int = SHINGLE, least: float = LEAST, radius: int = RADIUS,
) -> DataFrame:
    """(key, item, similarity, start) of every document and item it leaks; start is a word's place."""
    items = benchmark.select(F.col(item_key).alias("item"), words(F.lower(F.col(item_text))).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("width", F.least(F.size("words"), F.lit(shingle)))
    items = items.withColumn("grams", _shingles(F.col("words"), F.col("width"))).drop("words")
    items = stored(items.withColumn("size", F.size("grams")).withColumn("item_fp", simhash(F.col("grams"))), "items")
    grams = stored(items.select("width", F.explode("grams").alias("gram"), "size").distinct(), "grams")
    sent = F.broadcast if grams.count() <= MOST_SENT else (lambda table: table)
    # As many widths as words in a shingle, at most.
    widths = sorted(r[0] for r in grams.select("width").distinct().collect())

    content = F.lower(F.coalesce(F.col(text), F.lit("")))
    texts = df.select(F.col(key).alias("key"), F.xxhash64(content).alias("sign"), words(content).alias("words"))
    keys = None
    for width in widths:
        own = grams.where(F.col("width") == width).select("gram").distinct()
        met = texts.select("key", "sign", F.explode(_shingles(F.col("words"), width)).alias("gram")).join(sent(own), "gram", "left_semi")
        keys = met.select("key", "sign") if keys is None else keys.union(met.select("key", "sign"))
    if keys is None:
        return texts.where("false").select("key", F.lit(None).cast("long").alias("item"), F.lit(0.0).alias("similarity"), F.lit(0).alias("start"))
    keys = stored(keys.distinct().select(F.col("key").alias("k"), F.col("sign").alias("s")), "met")
    both = F.col("key").eqNullSafe(F.col("k")) & (F.col("sign") == F.col("s"))
    held = texts.join(keys, both, "left_semi").dropDuplicates(["key", "sign"])
    held = held.select("key", "sign", F.explode(F.array(*map(F.lit, widths))).alias("width"), "words")
    held = stored(held.select("key", "sign", "width", _shingles(F.col("words"), F.col("width")).alias("all")), "held")

    # Starts of windows with a shingle that some item of that size has.
    places = held.select("key", "sign", "width", F.size("all").alias("n"), F.posexplode("all").alias("at", "gram"))
    met = places.join(sent(grams), ["width", "gram"])
    low = F.greatest(F.lit(0), F.least(F.col("at") - F.col("size") + 1, F.col("n") - F.col("size")))
    high = F.greatest(F.lit(0), F.least(F.col("at"), F.col("n") - F.col("size")))
    starts = met.groupBy("key", "sign", "width", "size").agg(F.collect_set(F.sequence(low, high)).alias("runs"))
    starts = starts.select(
        F.col("key").alias("k"), F.col("sign").alias("s"), F.col("width").alias("w"), "size",
        F.explode(F.array_distinct(F.flatten("runs"))).alias("start"),
    )
    both = both & (F.col("width") == F.col("w"))
    windows = starts.join(held, both).select(
        "key", "sign", "width", "size", "start", F.slice("all", F.col("start") + 1, F.col("size")).alias("window")
    )
    windows = stored(windows.withColumn("fp", simhash(F.col("window"))), "windows")

    left = windows.withColumn("b", F.explode(_block_keys(F.col("fp"), radius)))
    right = items.withColumn("b", F.explode(_block_keys(F.col("item_fp"), radius)))
    pairs = left.join(right, ["width", "size", "b"])
    differ = F.col("fp").bitwiseXOR(F.col("item_fp"))
    equal = [F.when(_block(differ, first, size) == 0, F.lit(i)) for i, (first, size) in enumerate(_blocks(radius))]
    pairs = pairs.where((F.bit_count(differ) <= radius) & (F.col("b.block") == F.coalesce(*equal)))
    scored = pairs.withColumn("similarity", weighted_similarity(F.col("window"), F.col("grams"))).where(F.col("similarity") >= least)
    best = scored.groupBy("key", "sign", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
    return best.select("key", "item", "best.similarity", (-F.col("best.back")).alias("start"))
