"""Dimensions: distinct rows under natural or hashed keys, and their history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import md5_key, sha1_key
from .headers import project
from .own_columns import unused


def dim_distinct(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Distinct rows of ``{column: new name}``."""
    return project(df, columns).distinct()


def dim_sha1(
    df: DataFrame,
    key: str,
    key_columns: Sequence[str],
    attributes: Sequence[str] = (),
    sep: str = "",
    distinct: bool = True,
) -> DataFrame:
    """Distinct rows under a sha1 key made of ``key_columns``. Keys repeat where
    attributes differ; :func:`dim_one_per_key` settles that, and for it ``distinct=False``
    saves a shuffle."""
    columns = [*key_columns, *attributes]
    rows = df.select(*[F.col(f"`{c}`") for c in columns])
    rows = rows.distinct() if distinct else rows
    return rows.select(sha1_key(*[F.col(f"`{c}`") for c in key_columns], sep=sep).alias(key), *columns)


def dim_one_per_key(dim: DataFrame, key: str) -> DataFrame:
    """One row per key, the least by all its other columns, nulls last.

    One aggregate, which keeps one row per key in each task before its only shuffle.
    """
    rest = [c for c in dim.columns if c != key]
    if not rest:
        return dim.distinct()
    # Every column after the flag that it is null, so that nulls come last.
    order = [part for i, c in enumerate(rest) for part in (F.col(f"`{c}`").isNull().alias(f"f{i}"), F.col(f"`{c}`").alias(f"c{i}"))]
    least = unused("_least", dim)
    kept = dim.groupBy(F.col(f"`{key}`")).agg(F.min(F.struct(*order)).alias(least))
    back = {c: F.col(f"{least}.c{i}").alias(c) for i, c in enumerate(rest)} | {key: F.col(f"`{key}`")}
    return kept.select(*[back[c] for c in dim.columns])


def dim_md5(df: DataFrame, key: str, key_column: str, attributes: Sequence[str]) -> DataFrame:
    """All rows under an md5 key; check the key with ``duplicate_ids``."""
    return df.select(md5_key(F.col(key_column)).alias(key), *attributes)


def bridge(df: DataFrame, key: str, columns: Sequence[str], sep: str = "\x1f") -> DataFrame:
    """One row per combination of ``columns``, under a key of its own."""
    return dim_sha1(df, key, columns, sep=sep)


HISTORY = ("valid_from", "valid_to", "is_current")


def scd2_open(snapshot: DataFrame, as_of: Column) -> DataFrame:
    """A first history: every row current from the timestamp ``as_of``."""
    return snapshot.withColumns(
        {
            "valid_from": as_of,
            "valid_to": F.when(F.lit(False), as_of),
            "is_current": F.lit(True),
        }
    )


def scd2_merge(
    history: DataFrame,
    snapshot: DataFrame,
    key: Sequence[str],
    tracked: Sequence[str],
    as_of: Column,
    close_missing: bool = False,
) -> DataFrame:
    """Carry a type-2 history on to ``snapshot``, which has one row per ``key``;
    a repeated key is an error, and nulls in a key equal each other.

    A current row whose tracked values changed is closed at ``as_of`` and the new row
    opened; new keys are opened; the rest stays. Keys that the snapshot lacks stay
    open unless ``close_missing``. Past versions take no part in the join.
    """
    data = [name for name in history.columns if name not in HISTORY]
    current = history.where("is_current")
    past = history.where("NOT is_current").select(*data, *HISTORY)

    old, new = F.struct(*data, "valid_from").alias("old"), F.struct(*data)
    at = [F.col(f"`{k}`").alias(f"_at_{i}") for i, k in enumerate(key)]
    # A key that comes twice would multiply the history, so it is an error; null is a key.
    twice = F.raise_error(F.lit(f"more than one row of {', '.join(key)} in the snapshot"))
    once = F.when(F.count(F.lit(1)) > 1, twice.cast(snapshot.select(new.alias("n")).schema[0].dataType)).otherwise(F.first(new))
    fresh_rows = snapshot.groupBy(*at).agg(once.alias("new"))
    held = current.select(*[F.col(f"`{k}`").alias(f"_key_{i}") for i, k in enumerate(key)], old)
    same = reduce(lambda a, b: a & b, [F.col(f"_key_{i}").eqNullSafe(F.col(f"_at_{i}")) for i in range(len(key))])
    both = held.join(fresh_rows, same, "full")

    changed = F.lit(False)
    for name in tracked:
        changed = changed | ~F.col(f"old.{name}").eqNullSafe(F.col(f"new.{name}"))
    has_old, has_new = F.col("old").isNotNull(), F.col("new").isNotNull()
    replaced = has_old & has_new & changed
    closed = replaced | (has_old & ~has_new) if close_missing else replaced
    opened = has_new & (~has_old | replaced)

    def version(side: str, since: Column, until: Column, is_current: Column) -> Column:
        return F.struct(
            *[F.col(f"{side}.{name}").alias(name) for name in data],
            since.alias("valid_from"), until.alias("valid_to"), is_current.alias("is_current"),
        )

    never = F.lit(None).cast(history.schema["valid_to"].dataType)
    kept = version("old", F.col("old.valid_from"), F.when(closed, as_of).otherwise(never), ~closed)
    fresh = version("new", as_of, never, F.lit(True))
    versions = F.array_compact(F.array(F.when(has_old, kept), F.when(opened, fresh)))
    return both.select(F.inline(versions)).unionByName(past)
