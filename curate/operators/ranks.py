"""Positions of values in sorted order, without sorting a column in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

ROWS_PER_BLOCK = 250_000


def value_ranks(long: DataFrame, rows_per_block: int = ROWS_PER_BLOCK, flags: Sequence[str] = ()) -> DataFrame:
    """From rows ``(group, value double)``, none null, to distinct values with their place:
    ``(group, value, n, below, total)``, where ``below`` counts the group's smaller rows.

    Equal values are counted before anything is sorted, so a frequent one is a single
    row. The counts are then dealt by range into as many blocks as their number asks for,
    and stored in the scratch folder when this is called, so the given rows are read once
    however often the ranks are used. Blocks are sorted on their own, and each starts where
    the blocks below it end. For each column of ``flags``, 0 or 1 in each row, ``n_<flag>`` and
    ``below_<flag>`` count the rows that have 1.
    """
    sums = {"n": "below"} | {f"n_{flag}": f"below_{flag}" for flag in flags}
    counted = [F.count(F.lit(1)).alias("n"), *[F.sum(flag).alias(f"n_{flag}") for flag in flags]]
    counts = stored(long.groupBy("group", "value").agg(*counted), "counts")
    blocks = max(1, -(-counts.count() // rows_per_block))
    dealt = counts if blocks == 1 else counts.repartitionByRange(blocks, "group", "value")
    block = F.lit(0) if blocks == 1 else F.spark_partition_id()
    # Stored, so that a task that runs again cannot deal otherwise.
    blocked = stored(dealt.withColumn("block", block), "blocks") if blocks > 1 else dealt.withColumn("block", block)

    by_block = Window.partitionBy("group").orderBy("block")
    sizes = blocked.groupBy("group", "block").agg(*[F.sum(n).alias(f"rows_{n}") for n in sums])
    starts = sizes.select(
        "group",
        "block",
        *[(F.sum(f"rows_{n}").over(by_block) - F.col(f"rows_{n}")).alias(f"start_{n}") for n in sums],
        F.sum("rows_n").over(Window.partitionBy("group")).alias("total"),
    )
    inside = Window.partitionBy("group", "block").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = blocked.withColumns({f"inside_{n}": F.sum(n).over(inside) - F.col(n) for n in sums}).join(starts, ["group", "block"])
    below = [(F.col(f"start_{n}") + F.col(f"inside_{n}")).alias(name) for n, name in sums.items()]
    return placed.select("group", "value", *sums, *below, "total")
