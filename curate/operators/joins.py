"""Left joins that look rows up by a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .own_columns import unused

NULL_SPREAD = 1_000


def left_lookup(df: DataFrame, table: DataFrame, key: Column, table_key: str) -> DataFrame:
    """All rows of ``df``, with the columns of ``table`` where ``key`` equals ``table_key``,
    which is dropped and must be unique.

    Spark broadcasts the table if it is small by its own measure, and else splits a
    frequent key's rows over tasks. Rows without a key match nothing, but would all be
    shuffled to one task; they are spread by a second key that is 0 on every other row.
    """
    spread = F.when(key.isNull(), F.pmod(F.xxhash64(*[f"`{c}`" for c in df.columns]), F.lit(NULL_SPREAD)) + 1)
    own_key, own_spread, at, zero_name = (unused(n, df, table) for n in ("_key", "_spread", "_at", "_zero"))
    left = df.withColumns({own_key: key, own_spread: F.coalesce(spread, F.lit(0))})
    # Always 0, but not a constant to the optimizer, which would take it out of the join's keys.
    zero = F.pmod(F.xxhash64(f"`{table_key}`"), F.lit(1))
    right = table.withColumns({at: F.col(f"`{table_key}`"), zero_name: zero}).drop(table_key)
    on = (F.col(own_key) == F.col(at)) & (F.col(own_spread) == F.col(zero_name))
    return left.join(right, on, "left").drop(own_key, own_spread, at, zero_name)
