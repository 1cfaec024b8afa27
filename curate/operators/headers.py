"""Header and schema operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distinct_headers, parse_date, parse_number, parse_timestamp


def standardize_headers(df: DataFrame) -> DataFrame:
    """Give every column a warehouse-safe, unique name."""
    return df.toDF(*distinct_headers(df.columns))


def simple_headers(df: DataFrame) -> DataFrame:
    """Spaces to underscores and lower case; punctuation stays."""
    return df.toDF(*[name.replace(" ", "_").lower() for name in df.columns])


def pivot_headers(df: DataFrame) -> DataFrame:
    """Comma, slash, space and hyphen each to one underscore, and lower case."""
    return df.toDF(*[name.translate(str.maketrans(",/ -", "____")).lower() for name in df.columns])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename columns; names that are not there are passed over."""
    return df.withColumnsRenamed(dict(mapping))


def project(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Keep ``{column: new name}`` in that order. A missing column is an error at once."""
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in columns.items()])


# Formats tried for dates that carry no declared format.
DATE_FORMATS = ("yyyy-M-d H:m:s", "yyyy-M-d", "yyyy-M-d'T'H:m:s", "d/M/yyyy H:m:s", "d/M/yyyy")


def apply_schema(
    df: DataFrame,
    types: Mapping[str, str],
    dates: Sequence[str] = (),
    date_formats: Sequence[str] = DATE_FORMATS,
) -> DataFrame:
    """Cast ``{column: "string" | "float"}`` and parse ``dates`` to timestamps.

    Values that do not fit become null. A missing cast column is an error, a missing
    date column is passed over.
    """
    missing = [name for name in types if name not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")

    def typed(name: str):
        col = F.col(f"`{name}`")
        if name in dates:
            return parse_timestamp(col.cast("string"), date_formats).alias(name)
        kind = types.get(name)
        if kind is None:
            return col
        if kind == "string":
            return col.cast("string").alias(name)
        if kind == "float":
            return _numeric(df, name).alias(name)
        raise ValueError(f"unknown type {kind!r} for {name}; use 'string' or 'float'")

    return df.select(*[typed(name) for name in df.columns])


def _numeric(df: DataFrame, name: str):
    is_text = df.schema[name].dataType.typeName() in ("string", "varchar", "char")
    col = F.col(f"`{name}`")
    return parse_number(col) if is_text else col.cast("double")


def coerce_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Convert columns by logical type: categorical, numeric, datetime or date.

    Values that do not fit become null; columns that already have the type are left
    alone, and integers count as numeric.
    """
    numeric = ("byte", "short", "integer", "long", "float", "double", "decimal")

    def typed(name: str):
        kind = types.get(name)
        col = F.col(f"`{name}`")
        now = df.schema[name].dataType.typeName()
        if kind is None:
            return col
        if kind == "categorical":
            return (col if now == "string" else col.cast("string")).alias(name)
        if kind == "numeric":
            return (col if now in numeric else parse_number(col.cast("string"))).alias(name)
        if kind == "datetime":
            is_set = now in ("timestamp", "timestamp_ntz")
            return (col if is_set else parse_timestamp(col.cast("string"))).alias(name)
        if kind == "date":
            is_set = now in ("date", "timestamp", "timestamp_ntz")
            return (col if is_set else parse_date(col.cast("string"))).alias(name)
        raise ValueError(f"unknown type {kind!r} for {name}")

    return df.select(*[typed(name) for name in df.columns])
