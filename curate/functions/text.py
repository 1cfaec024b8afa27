"""Text normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space when a text is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column) -> Column:
    """Remove white space of any kind from both ends (``trim`` only knows spaces)."""
    return F.btrim(col, F.lit(WHITESPACE))


def normalise_text(col: Column, case: str | None = None) -> Column:
    """Strip, then leave as is, lower-case (``"lower"``) or capitalise (``"capitalise"``).

    Capitalising touches the whole text, not each word: first letter upper, rest lower.
    """
    text = strip(col)
    if case is None:
        return text
    if case == "lower":
        return F.lower(text)
    if case == "capitalise":
        return F.concat(F.upper(F.substr(text, F.lit(1), F.lit(1))), F.lower(F.substr(text, F.lit(2))))
    raise ValueError(f"unknown case {case!r}; use None, 'lower' or 'capitalise'")


def conditional_concat(first: Column, second: Column, sep: str = "_") -> Column:
    """``first`` when both are equal, else ``first`` and ``second`` joined by ``sep``."""
    return F.when(first == second, first).otherwise(F.concat_ws(sep, first, second))
