"""Parsers that give null, never an error, for text they cannot read."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# One- and two-digit fields are both accepted.
TIMESTAMP_FORMAT = "yyyy-M-d H:m:s"
DATE_FORMAT = "yyyy-M-d"

# Plain decimal notation only: the JVM would also take '1d', '2f' and hexadecimal floats.
_NUMBER = r"^\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"


def parse_number(text: Column) -> Column:
    """Text to double; unreadable text and ``nan`` become null."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def _naive(text: Column, fmt: str) -> Column:
    """Text to a timestamp without zone, as written, whatever the session's zone skips or repeats."""
    if set("VzOXxZ") & set(re.sub("'[^']*'", "", fmt)):
        return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")
    # Read as if in UTC, then counted on from the epoch: neither step asks the session's zone.
    read = F.try_to_timestamp(F.concat(text, F.lit(" Z")), F.lit(f"{fmt} X"))
    seconds = (F.unix_micros(read).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def parse_timestamp(text: Column, formats: Sequence[str] = (TIMESTAMP_FORMAT,)) -> Column:
    """Text to timestamp without time zone, by the first of ``formats`` that fits."""
    return F.coalesce(*[_naive(text, f) for f in formats])


def parse_date(text: Column, formats: Sequence[str] = (DATE_FORMAT,)) -> Column:
    """Text to date by the first of ``formats`` that fits."""
    return F.coalesce(*[F.try_to_date(text, f) for f in formats])
