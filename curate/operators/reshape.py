"""Long to wide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .headers import pivot_headers


def pivot_wide(
    df: DataFrame,
    index: Sequence[str],
    columns: str,
    values: str,
    attributes: Sequence[str] | None = None,
    on_duplicate: str = "error",
) -> DataFrame:
    """One row per ``index``, one column per attribute; absent cells are null.

    Give the ``attributes`` to save a job that looks for them. A cell with two rows is
    an error, or the row with the smallest value wins with ``on_duplicate="first"``.
    """
    cell = F.min(values)
    if on_duplicate == "error":
        clash = F.raise_error(F.lit(f"more than one row of {', '.join(index)} for an attribute in {columns}"))
        cell = F.when(F.count(F.lit(1)) > 1, clash.cast(df.schema[values].dataType)).otherwise(cell)
    elif on_duplicate != "first":
        raise ValueError("on_duplicate must be 'error' or 'first'")
    names = list(attributes) if attributes is not None else None
    wide = pivot_headers(df.groupBy(*index).pivot(columns, names).agg(cell))
    if len({name.lower() for name in wide.columns}) < len(wide.columns):
        raise ValueError(f"attributes in {columns} share a column name once standardised: {', '.join(wide.columns)}")
    return wide
