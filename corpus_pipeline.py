"""The corpus pipeline: language, near-duplicates, repeated substrings, benchmark, packing.

Each stage takes documents and returns documents, but for the last, which returns the
pieces of packed sequences. Rows that share a doc_id, or have none, are judged one by one;
in the cut of repeated substrings, rows equal in id and text are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curate.llm import decontamination, language_id, packing, simhash, suffix_array
from curate.llm.common import stored
from curate.operators.own_columns import unused
from curate.sources.ship import ship_package


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents and the column that tells them apart.

    That is doc_id, or where ids repeat or are null a number of each row, stored.
    """
    ids = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL")
    if not ids.limit(1).count():
        return docs, "doc_id"
    name = unused("row", docs)
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def _without(docs: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """Documents whose ``name`` is not among ``keys``, a stored table.

    The table's size is known, so a small one is sent out and no text is shuffled.
    """
    gone = unused("gone", docs)
    out = stored(keys.select(F.col("key").alias(gone)).distinct(), "gone")
    kept = docs.join(out, F.col(name) == F.col(gone), "left_anti")
    return kept if name == "doc_id" else kept.drop(name)


def language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep documents whose language is accepted."""
    ship_package(spark)
    docs, name = _numbered(docs)
    return _without(docs, language_id.identify(docs, key=name).where("NOT accepted"), name)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep the document with the least id (else row number) of each group of linked fingerprints.

    Shingle length and bit distance are those of the SimHash operator's contract.
    """
    ship_package(spark)
    docs, name = _numbered(docs)
    found = simhash.near_duplicates(docs, key=name, shingle=simhash.SHINGLE, radius=simhash.RADIUS)
    return _without(docs, found.where("key != component"), name)


def repeated_substrings(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Cut byte strings of 100 and more that stand earlier, to whole characters."""
    ship_package(spark)
    other = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out = suffix_array.remove_repeats(docs, as_text=True, carry=tuple(other))
    back = {"doc_id": F.col("key"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    back |= {name: F.col(f"carried_{i}") for i, name in enumerate(other)}
    return out.select(*(back[c].alias(c) for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents that hold a benchmark passage."""
    docs, name = _numbered(docs)
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    return _without(docs, decontamination.leaks(docs, benchmark, key=name), name)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pack what is left into sequences."""
    ship_package(spark)
    return packing.pack(packing.pieces(docs)).withColumnRenamed("key", "doc_id")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_substrings", repeated_substrings),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: The last stage's ids come from a tokenizer, which SQL has not; a test holds the whole
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages, each stored and read again, over the folder's documents."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
