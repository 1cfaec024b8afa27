"""Filters, top rows and duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .own_columns import known, unused


def where_null(df: DataFrame, column: str) -> DataFrame:
    """Rows without a value in ``column``; NaN is none."""
    return df.where(known(df, column).isNull())


def where_in(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose ``column`` is one of ``values``, however many; nulls are in no list.

    The list is a table of known size, which Spark broadcasts if small, and values meet the
    column's type by Spark's rules for comparison.
    """
    values = [v for v in values if v is not None]
    if not values:
        return df.where(F.lit(False))
    if any(isinstance(v, float) for v in values):
        values = [float(v) if isinstance(v, int) else v for v in values]
    name = unused("_listed", df)
    listed = df.sparkSession.createDataFrame([(v,) for v in values], [name])
    return df.join(listed, F.col(f"`{column}`") == F.col(name), "left_semi")


def top_n(df: DataFrame, by: str, n: int, tie_break: Sequence[str]) -> DataFrame:
    """The ``n`` rows largest in ``by``; equal ones in the order of ``tie_break``."""
    return df.orderBy(F.desc_nulls_last(by), *[F.asc_nulls_last(c) for c in tie_break]).limit(n)


def deduplicate(df: DataFrame, order_by: Sequence[str] = ()) -> DataFrame:
    """Drop repeated rows; null equals null.

    ``order_by`` names columns that only say where a row stood. They take no part in
    the comparison, and the first of each set of equal rows is kept.
    """
    if not order_by:
        return df.distinct()
    data = [f"`{name}`" for name in df.columns if name not in order_by]
    name = unused("_first", df)
    first = df.groupBy(*data).agg(F.min(F.struct(*order_by)).alias(name))
    return first.select(*data, f"{name}.*").select(*[f"`{name}`" for name in df.columns])


def dedup_report(df: DataFrame) -> DataFrame:
    """One row ``(total, kept, dropped)``."""
    copies = df.groupBy(*[f"`{name}`" for name in df.columns]).count()
    total, kept = F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))
    return copies.agg(
        total.alias("total"), kept.alias("kept"), (total - kept).alias("dropped")
    )


def keep_one(df: DataFrame, key: Sequence[str], order_by: Sequence[str | Column]) -> DataFrame:
    """One row per ``key``: the first by ``order_by``, nulls last unless given as a sort expression.

    Spark drops all but one row per key within each task before the shuffle, so a key
    that holds a large part of the table does not end up in one task.
    """
    if not order_by:
        raise ValueError("name the columns that decide which row is kept")
    order = [F.asc_nulls_last(c) if isinstance(c, str) else c for c in order_by]
    ranked = Window.partitionBy(*key).orderBy(*order)
    rank = unused("_rank", df)
    return df.withColumn(rank, F.row_number().over(ranked)).where(F.col(rank) == 1).drop(rank)
