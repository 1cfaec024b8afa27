"""Surrogate keys by hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_key(col: Column) -> Column:
    """Lower-case hex md5 of one text; null stays null."""
    return F.md5(col.cast("string"))


def sha1_key(*cols: Column, sep: str = "") -> Column:
    """Lower-case hex sha1 of the texts joined by ``sep``; nulls are left out.

    Without a separator ('ab', 'c') and ('a', 'bc') share a key; ``sep="\\x1f"`` tells them apart.
    """
    return F.sha1(F.concat_ws(sep, *[c.cast("string") for c in cols]))
