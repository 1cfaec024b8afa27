"""Cleaning rules of a table, as held in its JSON metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from ..functions import standardize_header
from ..operators.impute import DEFAULT_FILL

SECTIONS = ("deduplication_rules", "imputation_rules", "replacement_rules")
TYPES = ("categorical", "numeric", "datetime", "date")
FILL_CONSTANT = "NMAR"
FILL_FROM_GROUP = "MAR"


@dataclass(frozen=True)
class ColumnRule:
    column: str
    type: str | None = None
    method: str | None = None
    reference: str | None = None
    fill_value: str = DEFAULT_FILL

    @property
    def fills_from_group(self) -> bool:
        return self.method == FILL_FROM_GROUP and self.reference is not None


@dataclass(frozen=True)
class TableRules:
    deduplicate: bool = False
    columns: tuple[ColumnRule, ...] = ()
    replacements: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    warnings: tuple[str, ...] = ()


def _column_rule(raw_name: str, rule: Mapping[str, Any]) -> ColumnRule:
    reference = rule.get("reference_column")
    return ColumnRule(
        column=standardize_header(raw_name),
        type=rule.get("type"),
        method=rule.get("method"),
        reference=standardize_header(reference) if reference else None,
        fill_value=DEFAULT_FILL if rule.get("fill_value") is None else rule["fill_value"],
    )


def parse_rules(metadata: Any) -> TableRules:
    """Rules from parsed JSON. A missing section is a warning, anything but an object an error."""
    if not isinstance(metadata, Mapping):
        raise ValueError(f"rules must be an object, not {type(metadata).__name__}")
    warnings = tuple(f"rules have no section {name}" for name in SECTIONS if name not in metadata)
    dedup, impute, replace = (metadata.get(name) or {} for name in SECTIONS)
    return TableRules(
        deduplicate=bool(dedup.get("deduplicate", False)),
        columns=tuple(_column_rule(name, rule) for name, rule in impute.items()),
        replacements=replace,
        warnings=warnings,
    )


def check_rules(rules: TableRules, columns: Sequence[str]) -> list[str]:
    """Warnings about rules that do not apply to ``columns``; rules that cannot work raise."""
    warnings = list(rules.warnings)
    for rule in rules.columns:
        if rule.column not in columns:
            warnings.append(f"column {rule.column} is not in the table; its rule is skipped")
            continue
        if rule.type is not None and rule.type not in TYPES:
            raise ValueError(f"unknown type {rule.type!r} for {rule.column}")
        if rule.method == FILL_CONSTANT and rule.type not in (None, "categorical"):
            raise ValueError(f"{rule.column} is {rule.type} and cannot be filled with {rule.fill_value!r}")
        if rule.method == FILL_FROM_GROUP and rule.reference is None:
            warnings.append(f"{rule.column} has no reference column; it is not filled")
        elif rule.fills_from_group and rule.reference not in columns:
            raise ValueError(f"reference column {rule.reference} of {rule.column} is not in the table")
    warnings += [
        f"column {standardize_header(name)} is not in the table; its replacements are skipped"
        for name in rules.replacements
        if standardize_header(name) not in columns
    ]
    return warnings
