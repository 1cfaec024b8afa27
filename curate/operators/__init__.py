"""Operators: DataFrame in, DataFrame out, for use with ``df.transform``."""

from ..functions import distinct_headers
from .dims import bridge, dim_distinct, dim_md5, dim_one_per_key, dim_sha1, scd2_merge, scd2_open
from .enrich import flatten_responses, pending_enrichment, response_counts
from .headers import (
    apply_schema,
    coerce_types,
    pivot_headers,
    project,
    rename,
    simple_headers,
    standardize_headers,
)
from .impute import impute_constant, impute_group, impute_lookup
from .joins import left_lookup
from .profiling import correlations, describe, merge_sketches, profile, profile_of, profile_subset, quartiles, sketch
from .quality import (
    cardinality,
    count_exceeds,
    duplicate_ids,
    fk_orphans,
    functional_dependency,
    least_per_group,
    null_counts,
    value_counts,
)
from .ranks import value_ranks
from .reshape import pivot_wide
from .rows import dedup_report, deduplicate, keep_one, top_n, where_in, where_null
from .similarity import similar_values, suggest_replacements
from .standardize import combine_audits, replace_values, replace_with_audit, replacement_audit

__all__ = [
    "apply_schema",
    "bridge",
    "cardinality",
    "coerce_types",
    "combine_audits",
    "correlations",
    "count_exceeds",
    "dedup_report",
    "deduplicate",
    "describe",
    "dim_distinct",
    "dim_md5",
    "dim_one_per_key",
    "dim_sha1",
    "distinct_headers",
    "duplicate_ids",
    "fk_orphans",
    "flatten_responses",
    "functional_dependency",
    "impute_constant",
    "impute_group",
    "impute_lookup",
    "keep_one",
    "least_per_group",
    "left_lookup",
    "merge_sketches",
    "null_counts",
    "pending_enrichment",
    "pivot_headers",
    "pivot_wide",
    "profile",
    "profile_of",
    "profile_subset",
    "project",
    "quartiles",
    "rename",
    "replace_values",
    "replace_with_audit",
    "replacement_audit",
    "response_counts",
    "scd2_merge",
    "scd2_open",
    "similar_values",
    "simple_headers",
    "sketch",
    "standardize_headers",
    "suggest_replacements",
    "top_n",
    "value_counts",
    "value_ranks",
    "where_in",
    "where_null",
]
