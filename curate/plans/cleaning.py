"""Cleaning tables by rule."""

from __future__ import annotations

import json
import logging
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import (
    coerce_types,
    combine_audits,
    deduplicate,
    distinct_headers,
    impute_constant,
    impute_group,
    replace_with_audit,
    standardize_headers,
)
from ..operators.standardize import AUDIT
from ..sources import read_table, write_table
from ..sources.scratch import stored
from ..sources.tables import FILE_ORDER
from .rules import FILL_CONSTANT, ColumnRule, TableRules, check_rules, parse_rules

log = logging.getLogger(__name__)


def _batches(rules: Iterable[ColumnRule]) -> list[list[ColumnRule]]:
    """Neighbouring rules that fill from the same reference, taken together.

    A rule sees columns as earlier rules left them, so a batch never holds its own
    reference. One batch needs one shuffle, however many columns it fills.
    """
    batches: list[list[ColumnRule]] = []
    for rule in rules:
        last = batches[-1] if batches else []
        joins = (
            bool(last)
            and rule.fills_from_group
            and last[0].fills_from_group
            and last[0].reference == rule.reference
            and rule.column != rule.reference
            and rule.column not in [r.column for r in last]
        )
        if joins:
            last.append(rule)
        else:
            batches.append([rule])
    return batches


def apply_imputation(
    df: DataFrame, rules: Iterable[ColumnRule], order_by: Sequence[str] = (), null_reference: str = "keep"
) -> DataFrame:
    """Type and fill columns, rule by rule in order; later rules see filled columns.

    A group fill counts its groups when it is called, so what earlier group fills made is
    stored first, in the scratch folder: no fill is done twice.
    """
    unstored = False
    for batch in _batches(rule for rule in rules if rule.column in df.columns):
        df = coerce_types(df, {rule.column: rule.type for rule in batch if rule.type})
        first = batch[0]
        if first.fills_from_group:
            if not order_by:
                raise ValueError(f"{first.column} is filled from its group, which needs order_by")
            if unstored:
                df = stored(df, "filled")
            df = impute_group(df, [r.column for r in batch], first.reference, order_by, null_reference)
            unstored = True
        elif first.method == FILL_CONSTANT:
            df = impute_constant(df, {first.column: first.fill_value})
    return df


def clean_table(
    df: DataFrame,
    rules: TableRules | dict[str, Any],
    order_by: Sequence[str] = (),
    name: str = "",
    mode: str = "exact",
    hidden: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Headers, then duplicates, then types and gaps, then replacements, each as far as
    the rules ask for it. Returns the clean table and the audit of the replacements.

    ``order_by`` orders the rows for group fills. Columns in ``hidden`` serve only that:
    they do not count when rows are compared, and are left out of the result.
    """
    rules = rules if isinstance(rules, TableRules) else parse_rules(rules)
    clean = _filled(df, rules, order_by, name, hidden)
    if not rules.replacements:
        return clean, df.sparkSession.createDataFrame([], AUDIT)
    return replace_with_audit(clean, rules.replacements, name, mode)


def _filled(
    df: DataFrame, rules: TableRules, order_by: Sequence[str], name: str, hidden: Sequence[str], kept: Observation | None = None
) -> DataFrame:
    """The table as it is before replacements; ``kept`` observes its rows after duplicates are dropped."""
    data = [c for c in df.columns if c not in hidden]
    clean = standardize_headers(df.select(*[f"`{c}`" for c in data])) if not hidden else _headers_around(df, hidden)
    for warning in check_rules(rules, [c for c in clean.columns if c not in hidden]):
        log.warning("%s: %s", name, warning)
    if rules.deduplicate:
        clean = deduplicate(clean, order_by=hidden)
    if kept is not None:
        clean = clean.observe(kept, F.count(F.lit(1)).alias("n"))
    clean = apply_imputation(clean, rules.columns, order_by)
    return clean.drop(*hidden)


def _headers_around(df: DataFrame, hidden: Sequence[str]) -> DataFrame:
    """Standardised headers on all columns but the last ones, which are ``hidden``."""
    shown = df.columns[: len(df.columns) - len(hidden)]
    if df.columns[len(shown) :] != list(hidden):
        raise ValueError("hidden columns must come last")
    return df.toDF(*distinct_headers(shown), *hidden)


@dataclass(frozen=True)
class TableSpec:
    """A table to clean: where it lies and the rules for it.

    Without ``order_by`` rows count in the order they have in the files.
    """

    name: str
    path: str
    rules: TableRules | dict[str, Any]
    order_by: tuple[str, ...] = ()
    mode: str = "exact"


STATUS = "name string, status string, error string, n_read long, n_dropped long, n_written long"


def read_rules(spark: SparkSession, path: str) -> TableRules:
    """Rules from a JSON file."""
    return parse_rules(json.loads(spark.read.text(path, wholetext=True).first()[0]))


def run_pipeline(
    spark: SparkSession, specs: Iterable[TableSpec], base: str, fmt: str = "parquet"
) -> tuple[DataFrame, DataFrame]:
    """Clean each table into ``base/CLEAN`` and write one audit of all to ``base/AUDITS``.

    A table that fails is reported and the rest go on. Returns the audit as written and
    one status row per table: rows read, dropped as duplicates and written, observed by the
    runs that clean the table, without another reading. (Should an executor be lost, rows
    whose tasks run again may be observed twice.)
    """
    audits, status = [], []
    for spec in specs:
        try:
            hidden = () if spec.order_by else FILE_ORDER
            read, kept, written = (Observation(f"{what} {spec.name}") for what in ("read", "kept", "written"))
            table = read_table(spark, spec.path, file_order=bool(hidden)).observe(read, F.count(F.lit(1)).alias("n"))
            rules = spec.rules if isinstance(spec.rules, TableRules) else parse_rules(spec.rules)
            clean = _filled(table, rules, spec.order_by or hidden, spec.name, hidden, kept)
            if rules.replacements:
                # The clean table and its audit both read this, so the work before it is done once.
                clean, audit = replace_with_audit(stored(clean, "filled"), rules.replacements, spec.name, spec.mode)
            else:
                audit = spark.createDataFrame([], AUDIT)
            write_table(clean.observe(written, F.count(F.lit(1)).alias("n")), base, "CLEAN", spec.name, fmt)
            # Written with its table, so that a failure cannot leave half a record.
            audits.append(spark.read.schema(AUDIT).parquet(write_table(audit, base, "AUDITS/parts", spec.name)))
            n_read, n_kept, n_written = (observed.get["n"] for observed in (read, kept, written))
            status.append((spec.name, "cleaned", None, n_read, n_read - n_kept, n_written))
        except Exception as error:
            log.error("%s was not cleaned: %s", spec.name, error)
            status.append((spec.name, "failed", str(error).splitlines()[0], None, None, None))
    combined = combine_audits([spark.createDataFrame([], AUDIT), *audits])
    path = write_table(combined, base, "AUDITS", "combined_audit", fmt)
    reader = spark.read.schema(AUDIT)
    written = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    return written, spark.createDataFrame(status, STATUS)
