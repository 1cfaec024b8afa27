"""Marts per area."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import correlations


def mart_by_area(
    premises: DataFrame,
    area: str,
    key: str,
    children: Mapping[str, DataFrame],
    dims: Sequence[DataFrame] = (),
) -> DataFrame:
    """Per ``area``: ``n_premises``, and ``n_<child>`` for each child table with column ``key``.

    Children are counted per premises before they meet the premises, and premises per
    area before they meet the area's dimensions: no join multiplies rows, and a key
    with very many children is a single row by then.
    """
    totals = [F.count(F.lit(1)).alias("n_premises")]
    placed = premises.select(area, key)
    for name, child in children.items():
        counts = child.groupBy(key).agg(F.count(F.lit(1)).alias(f"n_{name}"))
        placed = placed.join(counts, key, "left")
        totals.append(F.coalesce(F.sum(f"n_{name}"), F.lit(0)).alias(f"n_{name}"))
    mart = placed.groupBy(area).agg(*totals)
    for dim in dims:
        mart = mart.join(dim, area, "left")
    return mart


def mart_correlation(
    mart: DataFrame, counts: Sequence[str], metrics: Sequence[str], method: str = "pearson"
) -> DataFrame:
    """Correlation of each count with each metric, as rows ``(a, b, method, corr)``."""
    found = correlations(mart, [*counts, *metrics], method)
    return found.where(F.col("a").isin(*counts) & F.col("b").isin(*metrics))
