"""Counts and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .own_columns import known, unused
from .rows import where_in


def least_per_group(df: DataFrame, key: str, value: str) -> DataFrame:
    """The least ``value`` of each ``key``, keys with the largest total first."""
    total = unused("_total", df)
    least = df.groupBy(key).agg(F.min(value).alias(value), F.sum(value).alias(total))
    return least.orderBy(F.desc_nulls_last(total), F.asc_nulls_last(key)).drop(total)


def null_counts(df: DataFrame) -> DataFrame:
    """Rows ``(column, n_null)`` from one pass; NaN counts as null."""
    counts = [F.count_if(known(df, c).isNull()).alias(c) for c in df.columns]
    return df.agg(*counts).unpivot([], [f"`{c}`" for c in df.columns], "column", "n_null")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first; nulls and NaN are not counted."""
    return (
        df.where(known(df, column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), column)
    )


def duplicate_ids(df: DataFrame, id_column: str) -> DataFrame:
    """Values that occur more than once, with their count; no rows means the column is unique."""
    counted = df.where(known(df, id_column).isNotNull()).groupBy(id_column).agg(F.count(F.lit(1)).alias("count"))
    return counted.where("count > 1")


def functional_dependency(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: whether each value of ``a`` has one value of ``b`` at most, and the other way.

    Both directions read the same distinct pairs, which are spread by both columns,
    so a frequent value does not fill one task.
    """
    pairs = df.select(known(df, a).alias("a"), known(df, b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct()

    def per_value(side: str) -> DataFrame:
        counts = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n"))
        return counts.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("values"), F.max("n").alias("most"))

    def of(side: str, what: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("side") == side, F.col(what))), F.lit(0))

    return (
        per_value("a")
        .unionAll(per_value("b"))
        .agg(
            F.lit(a).alias("a"),
            F.lit(b).alias("b"),
            of("a", "values").alias("n_a"),
            of("b", "values").alias("n_b"),
            (of("a", "most") <= 1).alias("a_determines_b"),
            (of("b", "most") <= 1).alias("b_determines_a"),
        )
    )


def cardinality(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row that names the relationship: 1:1, 1:N, N:1 or N:M."""
    one_b, one_a = F.col("a_determines_b"), F.col("b_determines_a")
    label = F.when(one_b & one_a, "1:1").when(one_a, "1:N").when(one_b, "N:1").otherwise("N:M")
    return functional_dependency(df, a, b).select("a", "b", label.alias("cardinality"))


def count_exceeds(df: DataFrame, column: str, values: Sequence, limit: int = 1) -> DataFrame:
    """One row for the rows whose ``column`` is in ``values``: how many there are, how many
    filled cells they have over all columns, and whether the cells exceed ``limit``."""
    cells = F.lit(0)
    for name in df.columns:
        cells = cells + F.count(known(df, name))
    return where_in(df, column, values).agg(
        F.count(F.lit(1)).alias("n_rows"), cells.alias("n_cells"), (cells > limit).alias("exceeds")
    )


def fk_orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Distinct child keys without a parent row; nulls and NaN are no keys.

    Child keys are reduced to distinct ones before the join.
    """
    at = unused("_parent", child)
    keys = child.select(child_key).where(known(child, child_key).isNotNull()).distinct()
    parents = parent.select(F.col(parent_key).alias(at))
    return keys.join(parents, F.col(child_key) == F.col(at), "left_anti")
