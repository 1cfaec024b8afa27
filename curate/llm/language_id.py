"""Language identification by Bayes' rule over several kinds of evidence.

* Text: byte trigrams, hashed to a fixed table, under one smoothed distribution a language.
* Declared markup language, and address suffix: how often each value goes with each
  language, by grouped counts; a null value is no evidence.
* Host: prior counts of languages by host, shrunk towards those of the host's domain, and
  those towards the whole (two levels of Dirichlet smoothing).

The text distributions are learned from all rows with a declared language. Counts of
declared and suffix values and of hosts use the language the text alone points to. Texts
are read twice, once to learn and once to weigh; what the second reading gives is narrow
and stored, and the rest is aggregates and joins on it.

Defined cases: a null or empty text is no text evidence; null hosts share one group; repeated
rows are judged each; with no declared language at all every row is undecided (null) and
rejected; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import BYTE_VALUES, slices, stored, utf8

CELLS = 1 << 15
#: Trigrams in a row speak together: evidence grows with their number to this power.
POWER = 0.6
STRENGTH_HOST, STRENGTH_DOMAIN, STRENGTH_VALUE = 20.0, 100.0, 5.0
LEAST_POSTERIOR = 0.6
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _cells(data: np.ndarray) -> np.ndarray:
    """A cell of the table for each trigram; the last two of a row reach into the next."""
    value = BYTE_VALUES[_LOWER[data]]
    h = value[:-2] * np.uint64(3) + value[1:-1] * np.uint64(0x9E3779B97F4A7C15) + value[2:] * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(49)).astype(np.int64)


def _rows_of(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def learn(df: DataFrame, text: str, declared: str) -> tuple[list[str], np.ndarray]:
    """Declared languages and the log-probability of each cell in each of them."""
    names = sorted(r[0] for r in df.select(F.col(declared)).where(F.col(declared).isNotNull()).distinct().collect())
    place = {name: i for i, name in enumerate(names)}

    def count(batches):
        total = np.zeros(len(names) * CELLS, np.int64)
        for batch in slices(batches):
            data, bounds = utf8(batch.column(0))
            if len(data) < 3:
                continue
            language = np.array([place.get(x, -1) for x in batch.column(1).to_pylist()], np.int64)
            row = _rows_of(bounds)
            inside = (row[2:] == row[:-2]) & (language[row[2:]] >= 0)
            total += np.bincount((language[row[2:]] * CELLS + _cells(data))[inside], minlength=len(total))
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["cell", "n"])

    counted = df.select(F.col(text), F.col(declared)).mapInArrow(count, "cell long, n long")
    table = np.zeros(len(names) * CELLS)
    # As many rows as the table has cells, whatever the corpus.
    for cell, n in counted.groupBy("cell").agg(F.sum("n")).collect():
        table[cell] = n
    table = table.reshape(len(names), CELLS) + 0.5
    return names, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def weigh(df: DataFrame, names: list[str], table: np.ndarray, text: str, power: float = POWER) -> DataFrame:
    """The rows' other columns with ``evidence``: a log-likelihood for each language."""
    keep = [c for c in df.columns if c != text]
    schema = df.select(*keep).schema.add("evidence", ArrayType(DoubleType()))

    def run(batches):
        for batch in slices(batches):
            data, bounds = utf8(batch.column(0))
            size = np.maximum(np.diff(bounds) - 2, 0)
            out = np.zeros((len(names), batch.num_rows))
            if len(data) >= 3:
                cells, row = _cells(data), _rows_of(bounds)
                inside = row[2:] == row[:-2]
                for i in range(len(names)):
                    out[i] = np.bincount(row[2:][inside], weights=table[i][cells[inside]], minlength=batch.num_rows)
            out *= np.where(size > 0, np.maximum(size, 1) ** (power - 1.0), 0.0)
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(list(out.T), pa.list_(pa.float64()))], names=[*keep, "evidence"])

    return df.select(text, *keep).mapInArrow(run, schema)


def _best(values: Column) -> Column:
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def _counts(n: int) -> list[Column]:
    return [F.sum((F.col("guess") == i).cast("long")).cast("double").alias(f"n{i}") for i in range(n)]


def _smoothed(n: int, prior: Column, strength: float) -> Column:
    """Counts n0.. shrunk towards an array of prior shares."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"n{i}"), F.lit(0.0)) for i in range(n)])
    return F.array(*((F.coalesce(F.col(f"n{i}"), F.lit(0.0)) + strength * F.get(prior, i)) / (total + strength) for i in range(n)))


def domain_of(host: Column) -> Column:
    """The last two labels of a host name; a name without dots is its own domain."""
    return F.substring_index(host, ".", -2)


def identify(
    df: DataFrame, key: str = "doc_id", text: str = "text", declared: str | None = "lang", host: str | None = "source",
    suffix: str | None = None, learn_from: str | None = None, least: float = LEAST_POSTERIOR,
) -> DataFrame:
    """(key, language, posterior, text_language, accepted) of every row.

    ``learn_from`` names the column whose values label texts to learn from (else
    ``declared``). A row is accepted if the posterior of its language reaches ``least``.
    """
    none = F.lit(None).cast("string")
    rows = df.select(
        F.col(key).alias("key"), F.col(text).alias("text"),
        (F.col(declared) if declared else none).cast("string").alias("declared"),
        (F.col(host) if host else none).cast("string").alias("host"),
        (F.col(suffix) if suffix else none).cast("string").alias("suffix"),
        F.col(learn_from or declared).cast("string").alias("teacher"),
    )
    names, table = learn(rows, "text", "teacher")
    if not names:
        return rows.select(
            "key", none.alias("language"), F.lit(0.0).alias("posterior"), none.alias("text_language"), F.lit(False).alias("accepted")
        )
    n = len(names)
    weighed = weigh(rows.drop("teacher"), names, table, "text").withColumn("guess", _best(F.col("evidence")))
    weighed = stored(weighed.withColumn("domain", domain_of(F.col("host"))), "evidence")
    whole = weighed.agg(F.count("*").cast("double").alias("rows"), *_counts(n)).first()
    overall = F.array(*(F.lit(((whole[f"n{i}"] or 0.0) + 1.0) / ((whole["rows"] or 0.0) + n)) for i in range(n)))

    # One count by host feeds the domains too.
    hosts = weighed.groupBy("host", "domain").agg(*_counts(n))
    domains = hosts.groupBy("domain").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(n)))
    domains = domains.select(F.col("domain").alias("of"), _smoothed(n, overall, STRENGTH_DOMAIN).alias("above"))
    prior = hosts.join(domains, F.col("domain").eqNullSafe(F.col("of")), "left")
    prior = prior.select(F.col("host").alias("of_host"), _smoothed(n, F.col("above"), STRENGTH_HOST).alias("prior"))

    out = weighed.join(prior, F.col("host").eqNullSafe(F.col("of_host")), "left")
    terms = [F.col("evidence"), F.transform("prior", lambda p: F.log(p))]
    for column, given in (("declared", declared), ("suffix", suffix)):
        if not given:
            continue
        # P(value | language), over the values seen: shrunk towards the value's overall share.
        seen = weighed.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("rows"), *_counts(n))
        total = seen.agg(F.sum("rows").alias("rows"), *(F.sum(f"n{i}").alias(f"n{i}") for i in range(n))).first()
        if not total["rows"]:
            continue
        share = F.col("rows") / F.lit(float(total["rows"]))
        each = [
            F.log((F.col(f"n{i}") + STRENGTH_VALUE * share) / F.lit((total[f"n{i}"] or 0.0) + STRENGTH_VALUE)) for i in range(n)
        ]
        seen = seen.select(F.col(column).alias(f"of_{column}"), F.array(*each).alias(f"{column}_evidence"))
        out = out.join(seen, F.col(column) == F.col(f"of_{column}"), "left")
        terms.append(F.coalesce(F.col(f"{column}_evidence"), F.array_repeat(F.lit(0.0), n)))
    fused = F.array(*(reduce(lambda a, b: a + b, [F.get(t, F.lit(i)) for t in terms]) for i in range(n)))
    out = out.select("key", "guess", fused.alias("fused")).withColumn("top", F.array_max("fused"))
    spread = F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    language = F.array(*map(F.lit, names))
    out = out.select(
        "key", F.get(language, _best(F.col("fused"))).alias("language"), (1 / spread).alias("posterior"),
        F.get(language, F.col("guess")).alias("text_language"),
    )
    return out.withColumn("accepted", F.col("posterior") >= least)
