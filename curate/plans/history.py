"""A type-2 history kept as files, of which a merge touches only what it changes.

The table lies in partitions: the current versions, and the closed ones by the time they
were closed at. A merge reads the current partition alone, writes what it closes as a
partition of its own and swaps the new current partition in. Closed versions are never read
or written again, so a run costs what is current, however long the history has grown.

The closed partition is written first, under the merge's own time. A run that fails after
that leaves the current partition as it was; the same merge again writes the same partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dims import scd2_merge, scd2_open
from ..sources.scratch import stored
from ..sources.tables import exists, replace_folder

#: Where current versions lie: they have not been closed at any time.
CURRENT = "is_current=true/closed_at=__HIVE_DEFAULT_PARTITION__"
CLOSED = "is_current=false/closed_at={}"
_PARTITIONS = ("is_current", "closed_at")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The whole history; ``where("is_current")`` reads the current partition only."""
    found = spark.read.option("basePath", path).parquet(path)
    current = F.col("is_current").cast("boolean").alias("is_current")
    return found.select(*[f"`{c}`" for c in found.columns if c not in _PARTITIONS], current)


def merge_history(
    snapshot: DataFrame, path: str, key: Sequence[str], tracked: Sequence[str], as_of: Column, close_missing: bool = False
) -> DataFrame:
    """Carry the history at ``path`` on to ``snapshot``, as :func:`scd2_merge` does, or open it.

    Returns the history as it then is.
    """
    spark = snapshot.sparkSession
    place = path.rstrip("/")
    if not exists(spark, f"{place}/is_current=true"):
        replace_folder(scd2_open(snapshot, as_of).drop("is_current"), f"{place}/{CURRENT}")
        return read_history(spark, place)
    current = spark.read.parquet(f"{place}/{CURRENT}").withColumn("is_current", F.lit(True))
    merged = stored(scd2_merge(current, snapshot, key, tracked, as_of, close_missing), "merged")
    closed = merged.where("NOT is_current").drop("is_current")
    if not closed.isEmpty():
        at = spark.range(1).select(F.date_format(as_of, "yyyyMMdd'T'HHmmssSSSSSS")).first()[0]
        replace_folder(closed, f"{place}/{CLOSED.format(at)}")
    replace_folder(merged.where("is_current").drop("is_current"), f"{place}/{CURRENT}")
    return read_history(spark, place)
