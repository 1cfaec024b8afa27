"""Reading, writing and landing tables."""

from .landing import land_datasets
from .scratch import scratch_dir
from .tables import read_lookup, read_table, select_distinct, with_file_order, write_table

__all__ = [
    "land_datasets",
    "read_lookup",
    "read_table",
    "scratch_dir",
    "select_distinct",
    "with_file_order",
    "write_table",
]
