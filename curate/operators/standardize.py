"""Replacing values by rule, with an audit."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalise_text, standardize_header
from .own_columns import unused

log = logging.getLogger(__name__)

AUDIT = (
    "table string, column string, action string, original_value string, "
    "new_value string, occurrences long, status string"
)
ACTION = "string_replacement"

# Up to this many rules of a column are looked up in place, more by join.
MOST_INLINE_RULES = 200

Replacements = Mapping[str, Mapping[str, str]]
Rule = tuple[str, str]


def _rules_by_column(df: DataFrame, replacements: Replacements) -> dict[str, list[Rule]]:
    """Normalised rules of the columns that are there, in their given order."""
    found: dict[str, list[Rule]] = {}
    for raw, rules in replacements.items():
        name = standardize_header(raw)
        if name not in df.columns:
            log.warning("column %s is not in the table; its replacements are skipped", name)
            continue
        pairs = [(old.strip().lower(), new.strip().lower()) for old, new in rules.items()]
        found.setdefault(name, []).extend(pairs)
    return found


def _normalised(name: str) -> Column:
    return normalise_text(F.col(f"`{name}`").cast("string"), "lower")


def _trace(rules: list[Rule]) -> tuple[dict[str, str], list[list[str]]]:
    """Follow whole-value rules through their chain.

    Gives the final text of each text the rules change, and for each rule the
    original texts it meets. Only texts named by a rule can ever meet one.
    """
    origins = {old: [old] for old, _ in rules}
    met: list[list[str]] = []
    for old, new in rules:
        moving = origins.pop(old, [])
        met.append(moving)
        origins[new] = origins.get(new, []) + moving
    final = {origin: text for text, sources in origins.items() for origin in sources if origin != text}
    return final, met


def _replace_exact(df: DataFrame, rules: dict[str, list[Rule]]) -> DataFrame:
    spark = df.sparkSession
    names = df.columns
    chosen: dict[str, Column] = {}
    for i, (name, pairs) in enumerate(rules.items()):
        final, _ = _trace(pairs)
        text = _normalised(name)
        if not final:
            chosen[name] = text
        elif len(final) <= MOST_INLINE_RULES:
            entries = [F.lit(part) for entry in final.items() for part in entry]
            chosen[name] = F.coalesce(F.create_map(*entries)[text], text)
        else:
            # No hint: Spark knows the size of this table and broadcasts it if small.
            old, new = unused(f"_old_{i}", df), unused(f"_new_{i}", df)
            table = spark.createDataFrame(list(final.items()), f"`{old}` string, `{new}` string")
            df = df.join(table, text == F.col(old), "left")
            chosen[name] = F.coalesce(F.col(new), text)
    return df.select(*[chosen[n].alias(n) if n in chosen else F.col(f"`{n}`") for n in names])


def _audit_exact(df: DataFrame, rules: dict[str, list[Rule]], table: str) -> DataFrame:
    """Counts of all rules of all columns from one scan and one small shuffle.

    Which original texts a rule meets follows from the rules alone, so rows only
    need to be looked up in the list of those texts.
    """
    spark = df.sparkSession
    listed, meetings = [], []
    for name, pairs in rules.items():
        _, met = _trace(pairs)
        for (old, new), origins in zip(pairs, met):
            number = len(listed)
            listed.append((number, table, name, ACTION, old, new))
            meetings.extend((name, origin, number) for origin in origins)
    if not listed:
        return spark.createDataFrame([], AUDIT)
    rule_table = spark.createDataFrame(
        listed, "rule int, table string, column string, action string, original_value string, new_value string"
    )
    meeting_table = spark.createDataFrame(meetings, "column string, text string, rule int")
    cells = F.array(*[F.struct(F.lit(n).alias("column"), _normalised(n).alias("text")) for n in rules])
    hits = (
        df.select(F.inline(cells))
        .join(meeting_table, ["column", "text"])
        .groupBy("rule")
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )
    occurrences = F.coalesce("occurrences", F.lit(0))
    return rule_table.join(hits, "rule", "left").select(
        "table",
        "column",
        "action",
        "original_value",
        "new_value",
        occurrences.alias("occurrences"),
        F.when(occurrences > 0, "Replaced").otherwise("Not Replaced").alias("status"),
    )


def _substitute(text: Column, rule: Rule) -> Column:
    old, new = rule
    return F.regexp_replace(text, F.lit(old), F.lit(new.replace("\\", "\\\\").replace("$", "\\$")))


def _count_regex_hits(values: DataFrame, rules: list[Rule]) -> list[int]:
    """For each rule, the rows equal to its old text once all earlier rules are done.

    A rule only acts when that count is above zero, so counts depend on earlier
    counts. All are computed at once under a guess of which rules act; counts up to
    the first wrong guess are right, so the guess is mended there and tried again.
    """
    acts = [False] * len(rules)
    guess_from_raw = True
    while True:
        staged, text, sums = values, "text", []
        for i, rule in enumerate(rules):
            sums.append(F.coalesce(F.sum(F.when(F.col(text) == rule[0], F.col("n"))), F.lit(0)).alias(f"r{i}"))
            if acts[i]:
                staged = staged.withColumn(f"text{i}", _substitute(F.col(text), rule))
                text = f"text{i}"
        counts = list(staged.agg(*sums).first())
        actual = [count > 0 for count in counts]
        if actual == acts:
            return counts
        if guess_from_raw:
            acts, guess_from_raw = actual, False
            continue
        wrong = next(i for i, (a, b) in enumerate(zip(actual, acts)) if a != b)
        acts = acts[:wrong] + actual[wrong:]


def _replace_regex(df: DataFrame, rules: dict[str, list[Rule]], table: str) -> tuple[DataFrame, DataFrame]:
    """Rules as regular expressions on parts of the text. Counts distinct texts when called."""
    audit, chosen = [], {}
    for name, pairs in rules.items():
        values = df.groupBy(_normalised(name).alias("text")).agg(F.count(F.lit(1)).alias("n")).persist()
        try:
            counts = _count_regex_hits(values, pairs) if pairs else []
        finally:
            values.unpersist()
        text = _normalised(name)
        for (old, new), count in zip(pairs, counts):
            status = "Replaced" if count else "Not Replaced"
            audit.append((table, name, ACTION, old, new, count, status))
            text = _substitute(text, (old, new)) if count else text
        chosen[name] = text
    out = df.select(*[chosen[n].alias(n) if n in chosen else F.col(f"`{n}`") for n in df.columns])
    return out, df.sparkSession.createDataFrame(audit, AUDIT)


def replace_with_audit(
    df: DataFrame, replacements: Replacements, table: str, mode: str = "exact"
) -> tuple[DataFrame, DataFrame]:
    """Apply ``{column: {old: new}}`` in order and report what each rule found.

    Ruled columns are stripped and lower-cased first, and so are the rules. With
    ``mode="exact"`` a rule replaces whole values; with ``"regex"`` it replaces every
    part that its old text matches as a regular expression, in all rows, provided
    that at least one row equals the old text. Null stays null.
    """
    rules = _rules_by_column(df, replacements)
    if mode == "exact":
        return _replace_exact(df, rules), _audit_exact(df, rules, table)
    if mode == "regex":
        return _replace_regex(df, rules, table)
    raise ValueError(f"unknown mode {mode!r}; use 'exact' or 'regex'")


def replace_values(df: DataFrame, replacements: Replacements, mode: str = "exact") -> DataFrame:
    """The replaced table of :func:`replace_with_audit`."""
    return replace_with_audit(df, replacements, "", mode)[0]


def replacement_audit(df: DataFrame, replacements: Replacements, table: str, mode: str = "exact") -> DataFrame:
    """The audit of :func:`replace_with_audit`, one row per rule."""
    return replace_with_audit(df, replacements, table, mode)[1]


def combine_audits(audits: Iterable[DataFrame]) -> DataFrame:
    """All audits in one table; columns that one lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), audits)
