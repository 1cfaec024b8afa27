"""Names for columns that an operator needs while it works, and what counts as missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, lengthened until no column of ``frames`` has it in any case."""
    taken = {column.lower() for frame in frames for column in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def known(df: DataFrame, name: str) -> Column:
    """The column's value, with NaN as null: every operator takes both as missing."""
    value = F.col(f"`{name}`")
    if df.schema[name].dataType.typeName() in ("float", "double"):
        return F.when(~F.isnan(value), value)
    return value
