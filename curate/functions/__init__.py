"""Column expressions: Column in, Column out, evaluated in the JVM."""

from .keys import md5_key, sha1_key
from .names import distinct_headers, standardize_header, standardize_name
from .parsing import parse_date, parse_number, parse_timestamp
from .text import conditional_concat, normalise_text, strip

__all__ = [
    "conditional_concat",
    "distinct_headers",
    "md5_key",
    "normalise_text",
    "parse_date",
    "parse_number",
    "parse_timestamp",
    "sha1_key",
    "standardize_header",
    "standardize_name",
    "strip",
]
