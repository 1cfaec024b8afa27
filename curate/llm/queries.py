"""The thirteen operators over whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.ship import ship_package
from . import (
    brown_lm,
    chat,
    collocations,
    decontamination,
    language_id,
    line_crf,
    packing,
    quality_rules,
    simhash,
    spelling,
    suffix_array,
    suffix_tree,
    tree_bpe,
)
from .common import documents
from .sql import ORACLES

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(run: Query) -> Query:
    _QUERIES[run.__name__] = run
    return run


def crc_remainder(key: str, modulus: int) -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(modulus))


@_query
def op1_suffix_array_dedup(spark, folder):
    ship_package(spark)
    out = suffix_array.remove_repeats(documents(spark, folder))
    return out.select(
        F.col("key").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@_query
def op2_brown_class_lm(spark, folder):
    ship_package(spark)
    out = brown_lm.score_texts(documents(spark, folder), crc_remainder("doc_id", 10) == 0)
    return out.withColumnRenamed("key", "doc_id")


@_query
def op3_language_id(spark, folder):
    ship_package(spark)
    out = language_id.identify(documents(spark, folder))
    return out.withColumnsRenamed({"key": "doc_id", "accepted": "kept"})


@_query
def op4_best_fit_packing(spark, folder):
    ship_package(spark)
    out = packing.pack(packing.pieces(documents(spark, folder)))
    return out.withColumnRenamed("key", "doc_id")


@_query
def op5_decontamination(spark, folder):
    out = decontamination.leaks(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
    return out.withColumnsRenamed({"key": "doc_id", "item": "item_id"})


@_query
def op6_quality_rules(spark, folder):
    out = quality_rules.apply_rules(documents(spark, folder))
    return out.select(
        F.col("key").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@_query
def op7_chat_formatting(spark, folder):
    ship_package(spark)
    table = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    out = chat.read_back(chat.assemble(table.unionByName(extra)))
    return out.drop("n_ids", "loss_ids")


@_query
def op8_simhash_near_dedup(spark, folder):
    ship_package(spark)
    out = simhash.near_duplicates(documents(spark, folder))
    return out.select(F.col("key").alias("doc_id"), simhash.hex_of("fp").alias("fingerprint"), F.col("component").alias("component_id"))


@_query
def op9_substring_dedup(spark, folder):
    ship_package(spark)
    out = suffix_tree.remove_repeats(documents(spark, folder))
    return out.select(F.col("key").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@_query
def op10_line_crf_quality(spark, folder):
    ship_package(spark)
    docs = documents(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(crc_remainder("doc_id", 4) != 2)
    field = line_crf.train(docs, labels.select(F.col("doc_id").alias("key"), F.col("quality").alias("label")))
    out = line_crf.score(docs, field)
    return out.select(
        F.col("key").alias("doc_id"), (crc_remainder("key", 4) == 2).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"), "lines", "bad_lines",
    )


@_query
def op11_phrase_collocations(spark, folder):
    ship_package(spark)
    return collocations.collocations(documents(spark, folder)).drop("example")


@_query
def op12_bpe_encoding(spark, folder):
    ship_package(spark)
    out = tree_bpe.decode(tree_bpe.encode(documents(spark, folder)))
    return out.select(
        F.col("key").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@_query
def op13_spelling_variants(spark, folder):
    ship_package(spark)
    return spelling.spelling_variants(documents(spark, folder))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


__all__ = ["oracle_sql", "queries"]
