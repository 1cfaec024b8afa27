"""Warehouse-safe column names, for headers and for names held as data."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Name prefixes the warehouse keeps for itself, the text that takes
# their place, the longest name and the lead given to names without a letter first.
RESERVED_PREFIXES = ("_table_", "_file_", "_partition", "_row_timestamp", "__root__", "_colidentifier")
RESERVED_BECOMES = "default"
MAX_NAME_LENGTH = 300
LEAD = "column_"

_INVALID = "[^a-z0-9_]+"
_RESERVED = "^(?:" + "|".join(RESERVED_PREFIXES) + ")"
_NO_LEAD = "^(?=[0-9]|$)"


def standardize_name(col: Column) -> Column:
    """Normalise names that are values in a column, e.g. attributes about to be pivoted."""
    name = F.replace(F.lower(strip(col)), F.lit(" "), F.lit("_"))
    name = F.substr(F.regexp_replace(name, _INVALID, ""), F.lit(1), F.lit(MAX_NAME_LENGTH))
    return F.regexp_replace(F.regexp_replace(name, _RESERVED, RESERVED_BECOMES), _NO_LEAD, LEAD)


def standardize_header(name: str) -> str:
    """The same normalisation for one header on the driver."""
    kept = re.sub(_INVALID, "", str(name).strip().lower().replace(" ", "_"))[:MAX_NAME_LENGTH]
    return re.sub(_NO_LEAD, LEAD, re.sub(_RESERVED, RESERVED_BECOMES, kept))


def distinct_headers(names: Iterable[str]) -> list[str]:
    """Normalise header names; a name that is taken gets the first free ``_1``, ``_2``, …"""
    taken: dict[str, None] = {}
    for raw in names:
        base = name = standardize_header(raw)
        suffix = 0
        while name in taken:
            suffix += 1
            name = f"{base}_{suffix}"
        taken[name] = None
    return list(taken)
