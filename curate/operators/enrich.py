"""Stored responses of an address search, and what is still to be asked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .own_columns import unused

# The response layout and the text for what a response leaves out.
RESPONSE = "places array<struct<id: string, formattedAddress: string, businessStatus: string>>"
ABSENT = "Missing"


def flatten_responses(df: DataFrame, json_column: str, as_of: Column, counts: Observation | None = None) -> DataFrame:
    """The first place of each JSON response, stamped with ``as_of``. Responses without
    a place, or not readable, drop out. ``counts`` observes how many of each there were in
    the run that reads the result first; :func:`response_counts` counts without one."""
    if counts is not None:
        df = df.observe(counts, *_counts(json_column))
    place = F.get(F.from_json(json_column, RESPONSE)["places"], F.lit(0))
    rest = [name for name in df.columns if name != json_column]
    at = unused("_place", df)
    found = df.select(*[f"`{name}`" for name in rest], place.alias(at)).where(F.col(at).isNotNull())
    return found.select(
        *[f"`{name}`" for name in rest],
        F.coalesce(f"{at}.id", F.lit(ABSENT)).alias("g_place_id"),
        F.coalesce(f"{at}.formattedAddress", F.lit(ABSENT)).alias("g_formatted_address_1"),
        F.coalesce(f"{at}.businessStatus", F.lit(ABSENT)).alias("g_business_status_1"),
        as_of.alias("api_call_date"),
    )


def _counts(json_column: str) -> list[Column]:
    places = F.from_json(json_column, RESPONSE)["places"]
    readable = F.try_parse_json(json_column).isNotNull()
    found = readable & F.coalesce(F.size(places) > 0, F.lit(False))
    kinds = {"found": found, "empty": readable & ~found, "unreadable": ~readable}
    return [F.count_if(kind).alias(name) for name, kind in kinds.items()]


def response_counts(df: DataFrame, json_column: str) -> DataFrame:
    """One row: responses with a place, without one, and not readable."""
    return df.agg(*_counts(json_column))


def pending_enrichment(requests: DataFrame, results: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct requests whose ``key`` has no result yet."""
    return requests.distinct().join(results.select(*key), list(key), "left_anti")
