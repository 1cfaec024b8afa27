"""Describing columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import parse_number, parse_timestamp
from ..sources.scratch import stored
from .joins import left_lookup
from .own_columns import known
from .ranks import ROWS_PER_BLOCK, value_ranks

NUMERIC_TYPES = ("byte", "short", "integer", "long", "float", "double", "decimal")
EXACT_TYPES = ("byte", "short", "integer", "long", "decimal")
QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.dataType.typeName() in NUMERIC_TYPES]


def _number(name: str) -> Column:
    """As double, with NaN as null."""
    value = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(value), value)


def _long(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Rows ``(group, value)`` of the named columns, nulls left out."""
    cells = [F.struct(F.lit(name).alias("group"), col.alias("value")) for name, col in columns.items()]
    return df.select(F.inline(F.array(*cells))).where("value IS NOT NULL")


def _per_column(df: DataFrame, aggregates: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """One row per column from a single aggregation of the whole table."""
    rows = [
        F.struct(F.lit(name).alias("column"), *[agg.alias(label) for label, agg in aggs.items()])
        for name, aggs in aggregates.items()
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def _summary(value: Column) -> dict[str, Column]:
    return {
        "count": F.count(value),
        "mean": F.avg(value),
        "std": F.stddev_samp(value),
        "min": F.min(value),
        "max": F.max(value),
    }


DESCRIBED = ("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")

# Rank error of an approximate percentile, as a share of the rows.
ACCURACY = 10_000
# Buckets for each factor of e in a value's size: their bounds are a thousandth apart.
BUCKETS_PER_E = 1024
# A bucket of more rows is cut once more, into so many parts.
MOST_IN_BUCKET = 2_000_000
PARTS_OF_BUCKET = 65_536


def describe(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Count, mean, sample deviation, least, quartiles and largest of numeric columns.

    Quartiles are exact and interpolated; see :func:`quartiles`, whose first reading
    gives all the rest. ``approximate`` takes everything from a single pass.
    """
    columns = list(columns) if columns else numeric_columns(df)
    if approximate:
        per_column = {
            name: {
                **_summary(_number(name)),
                **{label: F.percentile_approx(_number(name), q, ACCURACY) for label, q in QUARTILES.items()},
            }
            for name in columns
        }
        return _per_column(df, per_column).select(*DESCRIBED)
    buckets = _buckets(df, columns)
    # Means and deviations of buckets add up without losing digits.
    mean = F.sum(F.col("mean") * F.col("n")) / F.sum("n")
    means = buckets.groupBy("group").agg(mean.alias("all_mean"))
    apart = F.col("mean") - F.col("all_mean")
    squares = F.sum(F.col("n") * (F.col("variance") + apart * apart))
    summary = buckets.join(means, "group").groupBy(F.col("group").alias("column")).agg(
        F.sum("n").alias("count"), F.max("all_mean").alias("mean"), F.min("low").alias("min"), F.max("high").alias("max"),
        F.sqrt(F.try_divide(squares, F.nullif(F.sum("n") - 1, F.lit(0)))).alias("std"),
    )
    names = df.sparkSession.createDataFrame([(name,) for name in columns], "column string")
    rows = names.join(summary, "column", "left").join(_quartiles(df, columns, buckets), "column", "left")
    return rows.withColumn("count", F.coalesce("count", F.lit(0))).select(*DESCRIBED)


def quartiles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact interpolated quartiles as rows ``(column, q25, q50, q75)``.

    Values are neither shuffled nor sorted as a whole. One reading counts the rows of all
    columns in buckets by the leading digits of the value's logarithm, so that buckets rise
    with the values; running counts tell which buckets hold the quartiles. Another counts
    the values of these buckets alone. Only where such a bucket is very large, it is first
    cut into equal parts by one reading more. Runs when this is called.
    """
    return _quartiles(df, columns, _buckets(df, columns))


def _buckets(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(group, bucket, n, low, high, mean, variance)`` of all columns from one reading, stored.

    There are as many buckets as a double has sizes at this grain, whatever the rows.
    """
    value = F.col("value")
    # Logarithms rise with their numbers, and the shift keeps the buckets of each sign apart.
    size = F.floor(F.ln(F.abs(value)) * BUCKETS_PER_E) + (1 << 21)
    infinite = F.lit(1 << 40)
    size = F.when(F.abs(value) == F.lit(float("inf")), infinite).otherwise(size)
    bucket = F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0))
    cells = _long(df, {name: _number(name) for name in columns}).withColumn("bucket", bucket.cast("long"))
    facts = [F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance")]
    return stored(cells.groupBy("group", "bucket").agg(*facts), "buckets")


@dataclass(frozen=True)
class _Range:
    """Values of a column from ``low`` to ``high``, both included, with the rows below and in it."""

    column: str
    low: float
    high: float
    below: int
    n: int


def _places(total: Column, below: Column, n: Column) -> Column:
    """Whether a quartile, or the value after it, is among the ``n`` rows after ``below``."""
    hit = F.lit(False)
    for q in QUARTILES.values():
        for place in (F.floor(F.lit(q) * (total - 1)), F.ceil(F.lit(q) * (total - 1))):
            hit = hit | ((place >= below) & (place < below + n))
    return hit


def _holding(counted: DataFrame, order: str) -> list[Row]:
    """Rows (column, total, low, high, below, n) of the buckets that hold quartiles: six a column at most."""
    running = Window.partitionBy("group").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = F.col("start") + F.sum("n").over(running) - F.col("n")
    placed = counted.withColumn("below", below).where(_places(F.col("total"), F.col("below"), F.col("n")))
    return placed.select("column", "total", "low", "high", "below", "n").collect()


def _quartiles(df: DataFrame, columns: Sequence[str], buckets: DataFrame) -> DataFrame:
    spark = df.sparkSession
    totals = buckets.groupBy("group").agg(F.sum("n").alias("total"))
    held = buckets.join(totals, "group").withColumns({"column": F.col("group"), "start": F.lit(0)})
    rows = _holding(held, "bucket")
    total = {row["column"]: row["total"] for row in rows}
    ranges = [_Range(*(row[c] for c in ("column", "low", "high", "below", "n"))) for row in rows]
    large = [r for r in ranges if r.n > MOST_IN_BUCKET and r.low < r.high]
    if large:
        ranges = [r for r in ranges if r not in large] + _narrowed(df, large, total)
    # A range of one value is known; the values of others are counted.
    counts = spark.createDataFrame([(str(i), r.low, r.n) for i, r in enumerate(ranges) if r.low == r.high], "group string, value double, n long")
    inside = {str(i): _within(r) for i, r in enumerate(ranges) if r.low < r.high}
    if inside:
        counts = counts.unionAll(_long(df, inside).groupBy("group", "value").agg(F.count(F.lit(1)).alias("n")))
    starts = [(str(i), r.column, r.below, total[r.column]) for i, r in enumerate(ranges)]
    running = Window.partitionBy("group").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = counts.withColumn("upto", F.sum("n").over(running))
    ordered = ordered.join(spark.createDataFrame(starts, "group string, column string, below long, total long"), "group")
    upto = F.col("below") + F.col("upto")

    def at(place: Column) -> Column:
        return F.max(F.when((upto - F.col("n") <= place) & (place < upto), F.col("value")))

    def between(q: float) -> Column:
        place = F.lit(q) * (F.col("total") - 1)
        low, high, part = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        return F.when(part == 0, low).otherwise(low + (high - low) * part)

    return ordered.groupBy("column").agg(*[between(q).alias(label) for label, q in QUARTILES.items()])


def _within(r: _Range) -> Column:
    value = _number(r.column)
    return F.when((value >= r.low) & (value <= r.high), value)


def _narrowed(df: DataFrame, ranges: Sequence[_Range], total: Mapping[str, int]) -> list[_Range]:
    """The parts of large ranges that hold quartiles, by one more reading for all of them."""
    ends = df.sparkSession.createDataFrame(
        [(str(i), r.column, r.low, r.high, r.below, total[r.column]) for i, r in enumerate(ranges)],
        "group string, column string, from double, to double, start long, total long",
    )
    cells = _long(df, {str(i): _within(r) for i, r in enumerate(ranges)}).join(F.broadcast(ends), "group")
    part = F.floor((F.col("value") - F.col("from")) / (F.col("to") - F.col("from")) * PARTS_OF_BUCKET)
    counted = cells.groupBy("group", "column", "start", "total", part.alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    return [_Range(*(row[c] for c in ("column", "low", "high", "below", "n"))) for row in _holding(counted, "part")]


PROFILE = (
    "column", "kind", "n", "missing", "missing_pct", "distinct", "is_unique", "is_constant",
    "mean", "std", "min", "max", "zeros", "earliest", "latest", "top", "top_count", "min_length", "max_length",
)


def _kind(df: DataFrame, name: str, given: Mapping[str, str]) -> str:
    if name in given:
        kind = given[name]
        if kind not in ("categorical", "numeric", "datetime"):
            raise ValueError(f"unknown kind {kind!r} for {name}")
        return kind
    now = df.schema[name].dataType.typeName()
    if now in NUMERIC_TYPES:
        return "numeric"
    return "datetime" if now in ("date", "timestamp", "timestamp_ntz") else "categorical"


def _as_kind(df: DataFrame, name: str, kind: str) -> Column:
    col = F.col(f"`{name}`")
    is_text = df.schema[name].dataType.typeName() == "string"
    if kind == "numeric":
        return parse_number(col) if is_text else _number(name)
    if kind == "datetime":
        return parse_timestamp(col) if is_text else col.cast("timestamp_ntz")
    return known(df, name).cast("string")


def profile(df: DataFrame, kinds: Mapping[str, str] | None = None, approximate: bool = False) -> DataFrame:
    """One row per column: kind, missing, distinct, constants, and what suits the kind.

    ``kinds`` gives ``categorical``, ``numeric`` or ``datetime`` by column; the rest
    follow from their types. Everything but distinct and top values comes from one
    pass. Those need the values to be shuffled; ``approximate`` takes them from sketches
    in the same pass instead, see :func:`sketch`.
    """
    if approximate:
        return profile_of(sketch(df, kinds)).select(*PROFILE)
    kinds = {name: _kind(df, name, kinds or {}) for name in df.columns}
    typed = df.select(*[_as_kind(df, name, kind).alias(name) for name, kind in kinds.items()])
    base = _per_column(typed, {name: _facts(F.col(f"`{name}`"), kind) for name, kind in kinds.items()})
    return _derived(base.join(_distinct_and_top(df, kinds), "column", "left")).select(*PROFILE)


def _facts(value: Column, kind: str) -> dict[str, Column]:
    """What one aggregation tells of a column."""
    no_number, no_count = F.lit(None).cast("double"), F.lit(None).cast("long")
    no_time = F.lit(None).cast("timestamp_ntz")
    is_number, is_text, is_time = kind == "numeric", kind == "categorical", kind == "datetime"
    return {
        "kind": F.lit(kind),
        "n": F.count(F.lit(1)),
        "filled": F.count(value),
        "mean": F.avg(value) if is_number else no_number,
        "std": F.stddev_samp(value) if is_number else no_number,
        "min": F.min(value) if is_number else no_number,
        "max": F.max(value) if is_number else no_number,
        "zeros": F.count_if(value == 0) if is_number else no_count,
        "earliest": F.min(value) if is_time else no_time,
        "latest": F.max(value) if is_time else no_time,
        "min_length": F.min(F.length(value)).cast("long") if is_text else no_count,
        "max_length": F.max(F.length(value)).cast("long") if is_text else no_count,
    }


def _derived(rows: DataFrame) -> DataFrame:
    distinct = F.coalesce("distinct", F.lit(0))
    return rows.withColumns(
        {
            "missing": F.col("n") - F.col("filled"),
            "missing_pct": F.try_divide((F.col("n") - F.col("filled")) * 100.0, F.col("n")),
            "distinct": distinct,
            "is_unique": (F.col("filled") > 0) & (distinct == F.col("filled")),
            "is_constant": distinct == 1,
        }
    )


# Items a sketch of frequent values tracks, and by how large a share of the filled rows a
# count of it may be off: 3.5 over the sketch's table, the power of two that holds the items
# three quarters full.
ITEMS_TRACKED = 10_000
TOP_ERROR = 3.5 / 2 ** (ITEMS_TRACKED * 4 // 3).bit_length()


def sketch(df: DataFrame, kinds: Mapping[str, str] | None = None) -> DataFrame:
    """One row per column that :func:`profile_of` turns into a profile, from one pass.

    Distinct counts and frequent values are kept as sketches of a fixed size, so rows of
    several tables, say of days, can be stored and added up by :func:`merge_sketches`.
    """
    kinds = {name: _kind(df, name, kinds or {}) for name in df.columns}
    typed = df.select(*[_as_kind(df, name, kind).alias(name) for name, kind in kinds.items()])

    def facts(name: str) -> dict[str, Column]:
        value, kind = F.col(f"`{name}`"), kinds[name]
        # Negative zero is zero.
        text = (value + F.lit(0.0) if kind == "numeric" else value).cast("string")
        tracked = F.when(F.lit(kind == "categorical"), text)
        top = F.call_function("approx_top_k_accumulate", F.coalesce(tracked, F.lit(_NO_ITEM)), F.lit(ITEMS_TRACKED))
        more = {"distinct": F.hll_sketch_agg(text, F.lit(HLL_BITS)), "top": top}
        # Squares about the mean add up; a deviation does not.
        return _facts(value, kind) | {"std": F.var_pop(value) if kind == "numeric" else F.lit(None).cast("double")} | more

    return _per_column(typed, {name: facts(name) for name in df.columns}).withColumnRenamed("std", "variance")


# What a sketch of frequent values holds for rows without one; no text has this character.
_NO_ITEM = "\ufdd0"
HLL_BITS = 14


def merge_sketches(*sketches: DataFrame) -> DataFrame:
    """Sketches of several tables as those of all their rows."""
    rows = reduce(DataFrame.unionByName, sketches)
    filled = F.sum("filled")
    # Numbers are there only where the column has any.
    means = rows.groupBy("column").agg(F.try_divide(F.sum(F.col("mean") * F.col("filled")), filled).alias("all_mean"))
    apart = F.col("mean") - F.col("all_mean")
    squares = F.sum(F.col("filled") * (F.col("variance") + apart * apart))
    low, high = {"min", "earliest", "min_length"}, {"max", "latest", "max_length"}
    return (
        rows.join(means, "column")
        .groupBy("column", "kind")
        .agg(
            F.sum("n").alias("n"), filled.alias("filled"), F.max("all_mean").alias("mean"),
            F.try_divide(squares, filled).alias("variance"), F.sum("zeros").alias("zeros"),
            *[F.min(c).alias(c) for c in sorted(low)], *[F.max(c).alias(c) for c in sorted(high)],
            F.hll_union_agg("distinct").alias("distinct"),
            F.call_function("approx_top_k_combine", F.col("top"), F.lit(ITEMS_TRACKED)).alias("top"),
        )
    )


def profile_of(sketches: DataFrame) -> DataFrame:
    """The profile that sketches tell, with ``top_error``: how far ``top_count`` may be off.

    Distinct counts are estimates, within a few hundredths in nearly all cases; ``is_unique``
    and ``is_constant`` follow from them.
    """
    # The two most frequent items, as one may stand for the missing ones.
    items = F.filter(F.call_function("approx_top_k_estimate", F.col("top"), F.lit(2)), lambda item: item["item"] != _NO_ITEM)
    first = F.get(items, F.lit(0))
    is_text = F.col("kind") == "categorical"
    rows = sketches.withColumns(
        {
            "std": F.sqrt(F.try_divide(F.col("variance") * F.col("filled"), F.nullif(F.col("filled") - 1, F.lit(0)))),
            "distinct": F.least(F.hll_sketch_estimate("distinct"), F.col("filled")),
            "top_count": F.when(is_text, first["count"]),
            "top_error": F.when(is_text, F.floor(F.col("n") * TOP_ERROR)),
            "top": F.when(is_text, first["item"]),
        }
    )
    return _derived(rows).select(*PROFILE, "top_error")


def _distinct_and_top(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Exact distinct counts of all columns, and the most frequent values of the categorical ones.

    Values are counted as what they are: whole numbers and decimals by their digits, other
    numbers as numbers, dates as timestamps. Ties go to the smallest text.
    """

    def cell(name: str, kind: str) -> Column:
        value = _as_kind(df, name, kind)
        exact = kind == "numeric" and df.schema[name].dataType.typeName() in EXACT_TYPES
        text = F.col(f"`{name}`").cast("string") if exact else value if kind == "categorical" else F.lit(None)
        return F.struct(
            F.lit(name).alias("column"),
            text.cast("string").alias("text"),
            (value if kind == "numeric" and not exact else F.lit(None)).cast("double").alias("number"),
            (value if kind == "datetime" else F.lit(None)).cast("timestamp_ntz").alias("time"),
        )

    cells = df.select(F.inline(F.array(*[cell(name, kind) for name, kind in kinds.items()])))
    filled = cells.where("text IS NOT NULL OR number IS NOT NULL OR time IS NOT NULL")
    counts = filled.groupBy("column", "text", "number", "time").agg(F.count(F.lit(1)).alias("times"))
    categorical = [name for name, kind in kinds.items() if kind == "categorical"]
    ordered = F.when(F.col("column").isin(categorical), F.struct((-F.col("times")).alias("less"), "text"))
    found = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"), F.min(ordered).alias("most"))
    return found.select("column", "distinct", F.col("most.text").alias("top"), (-F.col("most.less")).alias("top_count"))


def profile_subset(df: DataFrame, where: Column, kinds: Mapping[str, str] | None = None) -> DataFrame:
    """Profile only the rows that satisfy ``where``, e.g. those without a key."""
    return profile(df.where(where), kinds)


def correlations(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    method: str = "pearson",
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Rows ``(a, b, method, corr)`` for each pair of columns, over rows that have both."""
    columns = list(columns) if columns else numeric_columns(df)
    pairs = list(combinations(columns, 2))
    if not pairs:
        raise ValueError("correlation needs at least two columns")
    if method == "pearson":
        return _corr_rows(df, [(a, b, _number(a), _number(b)) for a, b in pairs], method)
    if method == "spearman":
        return _spearman(df, pairs, rows_per_block)
    raise ValueError(f"unknown method {method!r}; use 'pearson' or 'spearman'")


def _corr(x: Column, y: Column) -> Column:
    """Pearson correlation over rows that have both; null where one of them is constant.

    ``F.corr`` fails on a constant column while ANSI mode is on.
    """
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _corr_rows(df: DataFrame, pairs: Sequence[tuple[str, str, Column, Column]], method: str) -> DataFrame:
    rows = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(method).alias("method"), _corr(x, y).alias("corr"))
        for a, b, x, y in pairs
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def _spearman(df: DataFrame, pairs: Sequence[tuple[str, str]], rows_per_block: int) -> DataFrame:
    """Correlate average ranks, over the rows that have both values of a pair.

    Columns with their gaps in the same rows form a kind. The rank of a value among the rows
    that have both columns is its rank among its own rows, less the rows before it that lack
    the other; so each column's values are counted once, with the number of their rows that
    each kind knows, and running counts give the rank for every partner. All rankings come
    from one reading of the table, and all pairs from one more, whatever their gaps.
    """
    columns = sorted({name for pair in pairs for name in pair})
    unlike = [F.count_if(_number(a).isNull() != _number(b).isNull()) for a, b in pairs]
    kind = {name: i for i, name in enumerate(columns)}
    for (a, b), n in zip(pairs, df.agg(*unlike).first()):
        if not n:
            merged = {kind[a], kind[b]}
            kind = {name: min(merged) if k in merged else k for name, k in kind.items()}
    kinds = sorted(set(kind.values()))
    known_to = {f"of{k}": _number(columns[k]).isNotNull().cast("long") for k in kinds} if len(kinds) > 1 else {}
    cells = [F.struct(F.lit(f"{i}").alias("group"), _number(name).alias("value")) for i, name in enumerate(columns)]
    long = df.select(*[flag.alias(c) for c, flag in known_to.items()], F.inline(F.array(*cells))).where("value IS NOT NULL")
    ranks = value_ranks(long, rows_per_block, tuple(known_to))

    values = df.select(*[_number(name).alias(f"c{i}") for i, name in enumerate(columns)])
    for i, name in enumerate(columns):
        # Ranks are unique by value, so Spark can split a frequent value's rows over tasks.
        asked = {kind[b if a == name else a] for a, b in pairs if name in (a, b)}
        rank = {k: F.col(f"below_of{k}") + (F.col(f"n_of{k}") + 1) / 2 for k in asked if known_to}
        rank = rank or {k: F.col("below") + (F.col("n") + 1) / 2 for k in asked}
        table = ranks.where(F.col("group") == f"{i}").select(F.col("value").alias("at"), *[r.alias(f"rank_{i}_{k}") for k, r in rank.items()])
        values = left_lookup(values, table, F.col(f"c{i}"), "at")
    at = {name: i for i, name in enumerate(columns)}
    sides = [(a, b, F.col(f"rank_{at[a]}_{kind[b]}"), F.col(f"rank_{at[b]}_{kind[a]}")) for a, b in pairs]
    return _corr_rows(values, sides, "spearman")
