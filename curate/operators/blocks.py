"""Placing rows among sorted bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_bounds_passed(df: DataFrame, bounds: Column, value: Column, most: int, name: str) -> DataFrame:
    """Add how many of the ascending array ``bounds`` (at most ``most`` long) are ``<= value``;
    0 where there are no bounds.

    A binary search, one column expression per step: Spark compiles the steps into one
    loop, which is many times faster than a higher-order function over the array.
    """
    df = df.withColumn(name, F.lit(0))
    for power in reversed(range(max(most, 1).bit_length())):
        ahead = F.col(name) + (1 << power)
        passed = (ahead <= F.size(bounds)) & (F.get(bounds, ahead - 1) <= value)
        df = df.withColumn(name, F.when(passed, ahead).otherwise(F.col(name)))
    return df
