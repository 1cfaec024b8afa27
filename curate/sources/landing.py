"""Landing a folder of files in the RAW zone."""

from __future__ import annotations

import logging
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from itertools import count

from pyspark.sql import DataFrame, SparkSession

from ..functions import distinct_headers
from .tables import read_table, write_table

log = logging.getLogger(__name__)

STATUS = "name string, n_rows long, status string, error string, raw_headers array<string>"


def _datasets(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(name, path) of what lies directly in ``folder``: a file, or a folder of part files."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for status in files.listStatus(jvm_path):
        name = status.getPath().getName()
        if not name.startswith((".", "_")):
            found.append((name, status.getPath().toString()))
    # Datasets that differ only in their suffix keep it, so that each has a target.
    stems = Counter(name.rsplit(".", 1)[0] for name, _ in found)
    wanted = [(name.rsplit(".", 1)[0] if stems[name.rsplit(".", 1)[0]] == 1 else name.replace(".", "_"), path) for name, path in sorted(found)]
    # Names that are still wanted twice are numbered, past all that others want.
    times, taken, named = Counter(name for name, _ in wanted), {name for name, _ in wanted}, []
    for name, path in wanted:
        if times[name] > 1:
            name = next(n for n in (f"{name}_{i}" for i in count(1)) if n not in taken)
            taken.add(name)
        named.append((name, path))
    return sorted(named)


def land_datasets(spark: SparkSession, source: str, base: str, zone: str = "RAW", workers: int = 8) -> DataFrame:
    """Copy every dataset in ``source`` to ``base/zone`` as Parquet.

    Up to ``workers`` datasets run at a time. One that fails is reported with its
    error and does not stop the rest. Returns one row per dataset. Blank or repeated headers
    cannot be stored, so such a dataset lands under standardised ones, and its row holds
    the headers as they were.
    """

    def land(dataset: tuple[str, str]) -> tuple[str, int | None, str, str | None, list[str] | None]:
        name, path = dataset
        try:
            table, raw = read_table(spark, path), None
            if len({header.lower() for header in table.columns if header}) < len(table.columns):
                raw = table.columns
                table = table.toDF(*distinct_headers(raw))
            landed = write_table(table, base, zone, name)
            return name, spark.read.parquet(landed).count(), "landed", None, raw
        except Exception as error:
            log.error("%s was not landed: %s", name, error)
            return name, None, "failed", str(error).splitlines()[0], None

    with ThreadPoolExecutor(workers) as pool:
        return spark.createDataFrame(list(pool.map(land, _datasets(spark, source))), STATUS)
