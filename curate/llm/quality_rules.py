"""Rules on documents, judged with their hosts (native: expressions, one aggregate, one join).

Each document is measured on its own. Failures of each rule are then added up by host, the
rates are shrunk towards the rate over all hosts by a beta prior fitted to the hosts, and
hosts whose shrunk rate is too high take their documents with them.

Defined cases: a null or empty text has no words and fails the base rule; rows with a null
host form one host; repeated rows are judged one by one; an empty table gives no rows;
other columns of the input, whatever their names, are not read and not returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, stored, words

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5


@dataclass(frozen=True)
class HostLimits:
    """Shrunk failure rates above which a host's documents all go."""

    base: float = 0.8
    symbols: float = 0.9
    lines: float = 0.9
    #: Symbols a word, and duplicate lines a line, at which a document fails.
    most_symbols: float = 0.5
    most_dup_lines: float = 0.5


def _repeat_words(found: Column) -> Column:
    """Words inside windows of five words that occur twice or more in the text."""

    def covered(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(v: Column) -> Column:
            def same(i: Column, j: Column) -> Column:
                return F.coalesce(F.get(v, j)["h"] == F.get(v, i)["h"], F.lit(False))

            return F.filter(v, lambda x, i: same(i, i - 1) | same(i, i + 1))

        places = let(by_hash, lambda v: F.sort_array(F.transform(twice(v), lambda x: x["i"])))
        # Each window adds the words up to the next one's start, five at most.
        return let(
            places,
            lambda p: F.aggregate(
                F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
                F.lit(0),
                lambda total, x: total + x,
            ),
        )

    def windows(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        return let(each, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))

    return F.when(F.size(found) > WINDOW, let(found, windows)).otherwise(0)


def measure(df: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source") -> DataFrame:
    """One row a document: key, host, counts of words, symbols, repeats; and the base rule."""
    content = F.coalesce(F.col(text), F.lit(""))
    split = df.select(F.col(key).alias("key"), F.col(host).alias("host"), content.alias("text"), words(F.col(text)).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD))
    counts = split.select(
        "key", "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(lines, F.size).cast("long").alias("n_lines"),
        _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )
    return counts.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def judge(measured: DataFrame, limits: HostLimits = HostLimits()) -> DataFrame:
    """Host rates, shrunk; one row a host. One row of prior values comes to the driver."""
    rules = {
        "base": F.col("base_failed"),
        "symbols": F.col("n_symbols") > limits.most_symbols * F.col("n_words"),
        "lines": F.col("n_dup_lines") > limits.most_dup_lines * F.col("n_lines"),
    }
    hosts = measured.groupBy("host").agg(
        F.count("*").alias("n"), *(F.sum(rule.cast("long")).alias(name) for name, rule in rules.items())
    )
    # Moments of the rates over hosts, weighted by documents, give each rule's prior.
    moments = hosts.select(
        F.sum("n").alias("n"), F.count("*").alias("hosts"),
        *(F.sum(name).alias(name) for name in rules),
        *(F.sum(F.col(name) * F.col(name) / F.col("n")).alias(f"{name}_square") for name in rules),
    ).first()
    out = hosts
    verdict = F.lit(True)
    for name in rules:
        alpha, beta = beta_prior(moments["n"], moments["hosts"], moments[name], moments[f"{name}_square"])
        rate = (F.col(name) + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta))
        out = out.withColumn(f"{name}_rate", rate)
        verdict = verdict & (rate <= getattr(limits, name))
    return out.withColumn("host_kept", verdict)


def beta_prior(n: int | None, hosts: int, failed: int | None, square: float | None) -> tuple[float, float]:
    """Alpha and beta of a beta distribution with the hosts' mean rate and spread.

    The spread beyond what chance gives decides the strength, between 1 and 1,000 documents.
    """
    if not n:
        return 0.5, 0.5
    mean = min(max(failed / n, 0.5 / (n + 1)), 1 - 0.5 / (n + 1))
    chance = mean * (1 - mean) * hosts / n
    spread = square / n - mean * mean - chance
    strength = mean * (1 - mean) / spread - 1 if spread > 0 else 1_000.0
    strength = min(max(strength, 1.0), 1_000.0)
    return mean * strength, (1 - mean) * strength


def apply_rules(
    df: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source", limits: HostLimits = HostLimits()
) -> DataFrame:
    """Every document's counts, its own verdict, its host's, and ``kept``.

    The counts are stored once, narrow, so that texts are read a single time. The join with
    hosts is left to Spark: a small table of hosts is sent out by its checked size, and a
    frequent host's rows are split by adaptive execution.
    """
    measured = stored(measure(df, text, key, host), "rules")
    hosts = judge(measured, limits).select("host", "host_kept")
    joined = measured.join(hosts.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")), "left").drop("of")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))
