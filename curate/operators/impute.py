"""Filling missing values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .blocks import with_bounds_passed
from .joins import NULL_SPREAD, left_lookup
from .own_columns import known, unused

DEFAULT_FILL = "Missing"

# A group above this many rows is cut into blocks of about this size.
ROWS_PER_BLOCK = 2_000_000
SAMPLES_PER_BLOCK = 50


def impute_constant(df: DataFrame, columns: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Null to a constant text: ``{column: fill}``, or a list of columns to fill with ``Missing``."""
    fills = dict(columns) if isinstance(columns, Mapping) else dict.fromkeys(columns, DEFAULT_FILL)
    for name in fills:
        if df.schema[name].dataType.typeName() != "string":
            raise ValueError(f"{name} is not text, so it cannot be filled with {fills[name]!r}")
    return df.select(
        *[
            F.coalesce(F.col(f"`{name}`"), F.lit(fills[name])).alias(name) if name in fills else F.col(f"`{name}`")
            for name in df.columns
        ]
    )


def impute_lookup(df: DataFrame, target: str, key: str, lookup: DataFrame) -> DataFrame:
    """Where ``target`` is null, take the value that ``lookup(key, value)`` holds for ``key``."""
    at, value = unused("_lookup_key", df), unused("_value", df)
    table = lookup.select(F.col("key").alias(at), F.col("value").alias(value))
    # Rows that need nothing ask for nothing.
    needed = F.when(known(df, target).isNull(), F.col(f"`{key}`"))
    filled = F.coalesce(known(df, target), F.col(value)).alias(target)
    rest = [filled if name == target else F.col(f"`{name}`") for name in df.columns]
    return left_lookup(df, table, needed, at).select(*rest)


def impute_group(
    df: DataFrame,
    targets: str | Sequence[str],
    reference: str,
    order_by: Sequence[str],
    null_reference: str = "keep",
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Fill nulls from rows of the same ``reference``: the last value before by
    ``order_by`` (ascending, nulls first), else the first after.

    Rows without a reference keep their value, or lose it with ``null_reference="wipe"``.

    After a forward fill only leading nulls are left, and these take the group's
    first value; both come from one sorted window, in time linear in the group.
    A group of more than ``rows_per_block`` rows is cut by order into blocks which
    are filled side by side; what a block lacks comes from a small table with the
    last value of each block. The group sizes are counted when this is called.
    """
    targets = [targets] if isinstance(targets, str) else list(targets)
    if not order_by:
        raise ValueError("group fill needs columns that order the rows")
    if null_reference not in ("keep", "wipe"):
        raise ValueError("null_reference must be 'keep' or 'wipe'")
    if reference in targets:
        raise ValueError(f"{reference} cannot be filled from itself")

    # Columns go by number meanwhile, so no name of theirs can meet one of those below.
    names = df.columns
    number = {name: f"column_{i}" for i, name in enumerate(names)}
    df = df.select(*[(known(df, c) if c in targets else F.col(f"`{c}`")).alias(number[c]) for c in names])
    targets, reference, order_by = [number[t] for t in targets], number[reference], [number[c] for c in order_by]
    bounds = _block_bounds(df, reference, order_by, rows_per_block)
    ref = F.col(f"`{reference}`")
    spread = F.when(ref.isNull(), F.pmod(F.xxhash64(*order_by), F.lit(NULL_SPREAD)).cast("int"))
    if bounds is None:
        placed = df.withColumn("_block", F.coalesce(spread, F.lit(0)))
    else:
        table, most = bounds
        bounded = df.join(table, ref == F.col("_ref"), "left")
        placed = (
            with_bounds_passed(bounded, F.col("_bounds"), F.struct(*order_by), most, "_passed")
            .withColumns({"_block": F.coalesce(spread, F.col("_passed")), "_cut": F.col("_bounds").isNotNull()})
            .drop("_ref", "_bounds", "_passed")
        )

    group = Window.partitionBy(ref, "_block").orderBy(*order_by)
    before = group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def value(name: str) -> Column:
        return F.col(f"`{name}`")

    runs = {f"_run_{i}": F.last(value(t), ignorenulls=True).over(before) for i, t in enumerate(targets)}
    firsts = {f"_first_{i}": F.first(value(t), ignorenulls=True).over(whole) for i, t in enumerate(targets)}
    filled = placed.withColumns({**runs, **firsts})
    if bounds is not None:
        carried = _carried(placed, ref, targets, order_by)
        filled = filled.join(
            carried, (ref == F.col("_ref")) & (F.col("_block") == F.col("_at")) & F.col("_cut"), "left"
        )

    def out(name: str) -> Column:
        if name not in targets:
            return value(name)
        i = targets.index(name)
        steps = [F.col(f"_run_{i}")]
        if bounds is not None:
            steps += [F.col(f"_carry_{i}"), F.col(f"_start_{i}")]
        inside = F.coalesce(*steps, F.col(f"_first_{i}"))
        outside = value(name) if null_reference == "keep" else F.lit(None)
        return F.when(ref.isNotNull(), inside).otherwise(outside).alias(name)

    return filled.select(*[out(name) for name in df.columns]).toDF(*names)


def _block_bounds(
    df: DataFrame, reference: str, order_by: Sequence[str], rows_per_block: int
) -> tuple[DataFrame, int] | None:
    """``(_ref, _bounds)`` for groups that must be cut and the most bounds of one, or None.

    Every group over ``rows_per_block`` is cut. What grows with the data stays in tables in
    the scratch folder; only whether there are any, and the longest list, come here.
    """
    ref = F.col(f"`{reference}`")
    sizes = df.where(ref.isNotNull()).groupBy(ref.alias("_ref")).agg(F.count(F.lit(1)).alias("_rows"))
    if (sizes.agg(F.max("_rows")).first()[0] or 0) <= rows_per_block:
        return None
    blocks = F.ceil(F.col("_rows") / F.lit(rows_per_block)).cast("int")
    cut = stored(sizes.where(F.col("_rows") > rows_per_block).select("_ref", blocks.alias("_blocks")), "cut")
    fraction = min(1.0, SAMPLES_PER_BLOCK / rows_per_block)
    sample = df.sample(fraction, seed=17).select(ref.alias("_ref"), F.struct(*order_by).alias("_at"))
    sorted_sample = (
        sample.join(cut, "_ref")
        .groupBy("_ref", "_blocks")
        .agg(F.array_sort(F.collect_list("_at")).alias("_sample"))
    )
    picked = F.transform(
        F.sequence(F.lit(1), F.col("_blocks") - 1),
        lambda i: F.get("_sample", F.floor(i * F.size("_sample") / F.col("_blocks")).cast("int")),
    )
    bounds = sorted_sample.select("_ref", F.array_distinct(picked).alias("_bounds"))
    # Stored, so that every use of the bounds sees the same ones.
    bounds = stored(bounds, "bounds")
    most = bounds.agg(F.max(F.size("_bounds"))).first()[0]
    return (bounds, most) if most else None


def _carried(placed: DataFrame, ref: Column, targets: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Per block of a cut group: the last value of earlier blocks and the group's first."""
    at = F.struct(*order_by)

    def place(name: str) -> Column:
        return F.when(F.col(f"`{name}`").isNotNull(), at)

    ends = []
    for i, name in enumerate(targets):
        ends.append(F.max_by(f"`{name}`", place(name)).alias(f"_last_{i}"))
        ends.append(F.min_by(f"`{name}`", place(name)).alias(f"_head_{i}"))
    blocks = placed.where("_cut").groupBy(ref.alias("_ref"), F.col("_block").alias("_at")).agg(*ends)
    earlier = Window.partitionBy("_ref").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    all_blocks = Window.partitionBy("_ref").orderBy("_at").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    carries = [F.last(f"_last_{i}", ignorenulls=True).over(earlier).alias(f"_carry_{i}") for i in range(len(targets))]
    starts = [F.first(f"_head_{i}", ignorenulls=True).over(all_blocks).alias(f"_start_{i}") for i in range(len(targets))]
    return blocks.select("_ref", "_at", *carries, *starts)
