"""Queries over the test tables, each with the SQL that must give the same rows.

The tables hold no nulls, so queries about missing values take some ordinary value as
missing, the same way on both sides.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.abspath(__file__))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from curate import functions as fn  # noqa: E402
from curate import operators as op  # noqa: E402
from curate import sources as src  # noqa: E402
from curate.plans import cleaning, history, mart, star  # noqa: E402
from curate.plans.rules import parse_rules  # noqa: E402
from curate.sources.ship import ship_package  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if there is one."""

    def register(run: Query) -> Query:
        _QUERIES[run.__name__] = run
        if sql is not None:
            _ORACLES[run.__name__] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def null_where(condition: Column, value: Column) -> Column:
    return F.when(~condition, value)


# --- sources and sinks -------------------------------------------------------------


@query("""
    SELECT c_custkey, c_name || ', "' || c_mktsegment || '"' AS c_label,
           nullif(c_mktsegment, 'BUILDING') AS c_mktsegment, c_acctbal
    FROM customer
""")
def read_csv_roundtrip(spark, folder):
    written = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("C Custkey"),
        F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("C Label"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("C Mktsegment"),
        F.col("c_acctbal").alias("C Acctbal"),
    )
    path = src.write_table(written, src.scratch_dir(spark, "roundtrip"), "CLEAN", "customer", "csv")
    read = op.standardize_headers(src.read_table(spark, path))
    typed = op.coerce_types(read, {"c_custkey": "numeric", "c_acctbal": "numeric"})
    return typed.withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS value FROM customer")
def lookup_table(spark, folder):
    path = src.scratch_dir(spark, "lookup") + "/names.json"
    objects = table(spark, folder, "customer").select(
        F.to_json(F.create_map(F.col("c_custkey").cast("string"), "c_name")).alias("value")
    )
    objects.write.mode("overwrite").text(path)
    return src.read_lookup(spark, path, layout="lines")


@query("SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 250000")
def select_distinct(spark, folder):
    return src.select_distinct(
        table(spark, folder, "orders"), ["o_custkey", "o_orderstatus"], "o_totalprice > 250000"
    )


@query("""
    SELECT 'customer' AS name, count(*) AS n_rows, 'landed' AS status FROM customer
    UNION ALL SELECT 'orders', count(*), 'landed' FROM orders
    UNION ALL SELECT 'part', count(*), 'landed' FROM part
""")
def land_datasets(spark, folder):
    base = src.scratch_dir(spark, "landing")
    for name, fmt in (("customer", "csv"), ("orders", "parquet"), ("part", "json")):
        src.write_table(table(spark, folder, name), base, "source", name, fmt)
    return src.land_datasets(spark, f"{base}/source", base).select("name", "n_rows", "status")


# --- headers and schema ------------------------------------------------------------

_RAW_NAME = """CASE WHEN p_size < 10 THEN '_TABLE_' || p_brand
                    WHEN p_size < 20 THEN '  ' || CAST(p_size AS {text}) || ' ' || p_name || ' '
                    WHEN p_size < 30 THEN p_name || '? / ' || p_type
                    WHEN p_size < 40 THEN '__ROOT__' || p_name || '_FILE_'
                    ELSE '#?' END"""


@query(f"""
    WITH raw AS (SELECT p_partkey, {_RAW_NAME.format(text="VARCHAR")} AS raw FROM part),
    kept AS (SELECT p_partkey, raw, substr(regexp_replace(replace(lower(
                 regexp_replace(raw, '^\\s+|\\s+$', '', 'g')), ' ', '_'), '[^a-z0-9_]', '', 'g'), 1, 300) AS name
             FROM raw),
    free AS (SELECT p_partkey, raw, regexp_replace(name,
                 '^(_table_|_file_|_partition|_row_timestamp|__root__|_colidentifier)', 'default') AS name FROM kept)
    SELECT p_partkey, raw,
           CASE WHEN name = '' OR name[1] BETWEEN '0' AND '9' THEN 'column_' || name ELSE name END AS name
    FROM free
""")
def standardize_name(spark, folder):
    raw = table(spark, folder, "part").select("p_partkey", F.expr(_RAW_NAME.format(text="STRING")).alias("raw"))
    return raw.withColumn("name", fn.standardize_name(F.col("raw")))


@query("""
    SELECT l_orderkey AS default55_order, l_partkey AS part_key, l_suppkey AS part_key_1,
           l_linenumber AS part_key_1_1, l_quantity AS column_1st, l_tax AS column_, l_discount AS inuse
    FROM lineitem
""")
def standardize_headers(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_tax", "l_discount"
    )
    return op.standardize_headers(
        lines.toDF("_TABLE_55 order", "Part Key", " part key ", "part_key_1", "1st", "?!", "In/Use?")
    )


@query('SELECT l_orderkey AS "order_key", l_tax AS "in_use?", l_discount AS "rural/urban" FROM lineitem')
def simple_headers(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_tax", "l_discount")
    return op.simple_headers(lines.toDF("Order Key", "In Use?", "Rural/Urban"))


@query("SELECT c_custkey AS accountid, c_name AS account_name, c_acctbal FROM customer")
def rename_columns(spark, folder):
    customer = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    return op.rename(customer, {"c_custkey": "accountid", "c_name": "account_name", "absent": "nothing"})


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """Events with numbers and times as text, some of them spoilt."""
    number = F.regexp_extract("props", "[0-9]+", 0)
    time = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return table(spark, folder, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", F.concat(number, F.lit("d")))
        .when(F.col("event_type") == "view", F.concat(F.lit(" "), number, F.lit(" ")))
        .otherwise(number)
        .alias("number"),
        F.when(F.col("event_type") == "click", F.replace(time, F.lit("2024-"), F.lit("2024-19")))
        .otherwise(time)
        .alias("time"),
        F.substr(time, F.lit(1), F.lit(10)).alias("day"),
        "user_id",
    )


_TEXTS_SQL = """
    WITH texts AS (
        SELECT event_id, user_id,
               CASE event_type WHEN 'error' THEN regexp_extract(props, '[0-9]+') || 'd'
                               WHEN 'view' THEN ' ' || regexp_extract(props, '[0-9]+') || ' '
                               ELSE regexp_extract(props, '[0-9]+') END AS number,
               CASE event_type WHEN 'click' THEN replace(strftime(ts, '%Y-%m-%d %H:%M:%S'), '2024-', '2024-19')
                               ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS time,
               strftime(ts, '%Y-%m-%d') AS day
        FROM events)
"""


@query(_TEXTS_SQL + """
    SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, TRY_CAST(trim(number) AS DOUBLE) AS number,
           try_strptime(time, '%Y-%m-%d %H:%M:%S') AS time, try_strptime(day, '%Y-%m-%d') AS day
    FROM texts
""")
def apply_schema(spark, folder):
    types = {"user_id": "string", "number": "float"}
    return op.apply_schema(_texts(spark, folder), types, ["time", "day", "not_there"])


@query(_TEXTS_SQL + """
    SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, TRY_CAST(trim(number) AS DOUBLE) AS number,
           try_strptime(time, '%Y-%m-%d %H:%M:%S') AS time, CAST(day AS DATE) AS day
    FROM texts
""")
def coerce_types(spark, folder):
    kinds = {"user_id": "categorical", "number": "numeric", "time": "datetime", "day": "date"}
    return op.coerce_types(_texts(spark, folder), kinds)


# --- filters, duplicates -----------------------------------------------------------


def _customer_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Customers, with the segment missing for some and the nation for others."""
    return table(spark, folder, "customer").select(
        "c_custkey",
        "c_name",
        null_where(F.col("c_acctbal") > 9000, F.col("c_nationkey").cast("string")).alias("nation"),
        null_where(F.col("c_acctbal") < 1000, F.col("c_mktsegment")).alias("segment"),
        "c_acctbal",
    )


_CUSTOMER_GAPS_SQL = """
    WITH gaps AS (
        SELECT c_custkey, c_name, CASE WHEN NOT c_acctbal > 9000 THEN CAST(c_nationkey AS VARCHAR) END AS nation,
               CASE WHEN NOT c_acctbal < 1000 THEN c_mktsegment END AS segment, c_acctbal
        FROM customer)
"""


@query(_CUSTOMER_GAPS_SQL + "SELECT * FROM gaps WHERE segment IS NULL")
def filter_null(spark, folder):
    return op.where_null(_customer_gaps(spark, folder), "segment")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', 'none')")
def filter_isin(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return op.where_in(orders, "o_orderpriority", ["1-URGENT", "2-HIGH", "none"])


@query("""
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100
""")
def top_n(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return op.top_n(orders, "o_totalprice", 100, ["o_orderkey"])


@query("SELECT DISTINCT text, lang FROM documents")
def dedup_rows(spark, folder):
    return op.deduplicate(table(spark, folder, "documents").select("text", "lang"))


@query("""
    SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS kept, CAST(sum(n) - count(*) AS BIGINT) AS dropped
    FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang)
""")
def dedup_report(spark, folder):
    return op.dedup_report(table(spark, folder, "documents").select("text", "lang"))


@query("""
    SELECT textid, doc_id, source FROM (
        SELECT md5(text) AS textid, doc_id, source,
               row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rank FROM documents)
    WHERE rank = 1
""")
def dedup_by_key(spark, folder):
    documents = table(spark, folder, "documents").select(
        fn.md5_key(F.col("text")).alias("textid"), "doc_id", "source"
    )
    return op.keep_one(documents, ["textid"], ["doc_id"])


# --- imputation --------------------------------------------------------------------


@query(_CUSTOMER_GAPS_SQL + """
    SELECT c_custkey, c_name, coalesce(nation, 'Unknown') AS nation, coalesce(segment, 'Missing') AS segment, c_acctbal
    FROM gaps
""")
def impute_constant(spark, folder):
    return op.impute_constant(_customer_gaps(spark, folder), {"nation": "Unknown", "segment": "Missing"})


def _fill_sql(target: str, reference: str, order: str) -> str:
    """Forward then backward fill; rows without a reference keep their value."""
    return f"""CASE WHEN {reference} IS NULL THEN {target} ELSE coalesce(
        last_value({target} IGNORE NULLS) OVER (PARTITION BY {reference} ORDER BY {order}
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value({target} IGNORE NULLS) OVER (PARTITION BY {reference} ORDER BY {order}
            ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) END AS {target}"""


@query(f"""
    WITH gaps AS (
        SELECT event_id, CASE WHEN event_type <> 'signup' THEN user_id END AS user_id,
               CASE WHEN event_type NOT IN ('error', 'view') THEN value END AS value FROM events)
    SELECT event_id, user_id, {_fill_sql("value", "user_id", "event_id")} FROM gaps
""")
def impute_group(spark, folder):
    kind = F.col("event_type")
    gaps = table(spark, folder, "events").select(
        "event_id",
        null_where(kind == "signup", F.col("user_id")).alias("user_id"),
        null_where(kind.isin("error", "view"), F.col("value")).alias("value"),
    )
    return op.impute_group(gaps, "value", "user_id", ["event_id"])


@query(_CUSTOMER_GAPS_SQL + f"""
    , named AS (SELECT c_custkey, c_name, segment, c_acctbal, {_fill_sql("nation", "segment", "c_custkey")} FROM gaps),
    placed AS (SELECT c_custkey, c_name, nation, c_acctbal, {_fill_sql("segment", "nation", "c_custkey")} FROM named)
    SELECT c_custkey, c_name, CAST(nation AS DOUBLE) AS nation, coalesce(segment, 'Missing') AS segment, c_acctbal
    FROM placed
""")
def impute_by_rules(spark, folder):
    rules = parse_rules(
        {
            "deduplication_rules": {},
            "imputation_rules": {
                "nation": {"type": "numeric", "method": "MAR", "reference_column": "segment"},
                "Segment": {"type": "categorical", "method": "MAR", "reference_column": "nation"},
                "c_name": {"type": "categorical", "method": "MAR"},
                "absent": {"type": "categorical", "method": "NMAR"},
            },
            "replacement_rules": {},
        }
    )
    filled = cleaning.apply_imputation(_customer_gaps(spark, folder), rules.columns, ["c_custkey"])
    return op.impute_constant(filled, ["segment"])


@query("""
    SELECT c_custkey, c_mktsegment,
           coalesce(CASE WHEN c_acctbal >= 5000 THEN 'known' END, s_name) AS supplier
    FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey
""")
def impute_lookup(spark, folder):
    suppliers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("value"))
    customer = table(spark, folder, "customer").select(
        "c_custkey", "c_mktsegment", F.when(F.col("c_acctbal") >= 5000, "known").alias("supplier")
    )
    return op.impute_lookup(customer, "supplier", "c_custkey", suppliers)


# --- standardisation ---------------------------------------------------------------


@query("""
    SELECT p_partkey, upper(p_name) AS as_is, p_name AS lowered,
           upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2)) AS capitalised
    FROM part
""")
def normalise_text(spark, folder):
    padded = F.concat(F.lit(" \t"), F.upper("p_name"), F.lit(" \n "))
    return table(spark, folder, "part").select(
        "p_partkey",
        fn.normalise_text(padded).alias("as_is"),
        fn.normalise_text(padded, "lower").alias("lowered"),
        fn.normalise_text(padded, "capitalise").alias("capitalised"),
    )


_PART_RULES = {
    "P Name": {"Small Ring": "tiny ring", "tiny ring": "ring", "red rod": "Crimson Rod ", "gold ring": "ring"},
    "p_type": {"ECONOMY": "budget", " promo ": "offer"},
    "absent": {"a": "b"},
}
_CUSTOMER_RULES = {"c_mktsegment": {"BUILDING": "construction", "machinery": "machines", "retail": "shops"}}
_REGEX_RULES = {"p_name": {"red rod": "rod $1", "rod $1": "rod", "rod": "bar", "blue .*": "x", "ring": "hoop"}}


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", "p_name", "p_type", "p_retailprice")


@query("""
    SELECT p_partkey, p_retailprice,
           CASE p_name WHEN 'small ring' THEN 'ring' WHEN 'red rod' THEN 'crimson rod' ELSE p_name END AS p_name,
           CASE lower(p_type) WHEN 'economy' THEN 'budget' WHEN 'promo' THEN 'offer' ELSE lower(p_type) END AS p_type
    FROM part
""")
def replace_exact(spark, folder):
    return op.replace_values(_parts(spark, folder), _PART_RULES)


@query("""
    SELECT p_partkey, p_type, p_retailprice, CASE
               WHEN (SELECT count(*) FROM part WHERE p_name = 'red rod') > 0
               THEN replace(p_name, 'red rod', 'rod $1') ELSE p_name END AS p_name
    FROM part
""")
def replace_regex(spark, folder):
    return op.replace_values(_parts(spark, folder), _REGEX_RULES, mode="regex")


_PART_AUDIT_SQL = """
    WITH rules(no, "column", original_value, new_value) AS (VALUES
        (0, 'p_name', 'small ring', 'tiny ring'), (1, 'p_name', 'tiny ring', 'ring'),
        (2, 'p_name', 'red rod', 'crimson rod'), (3, 'p_name', 'gold ring', 'ring'),
        (4, 'p_type', 'economy', 'budget'), (5, 'p_type', 'promo', 'offer')),
    meets(no, "column", value) AS (VALUES
        (0, 'p_name', 'small ring'), (1, 'p_name', 'small ring'), (1, 'p_name', 'tiny ring'),
        (2, 'p_name', 'red rod'), (3, 'p_name', 'gold ring'), (4, 'p_type', 'economy'), (5, 'p_type', 'promo')),
    cells AS (SELECT 'p_name' AS "column", lower(p_name) AS value FROM part
              UNION ALL SELECT 'p_type', lower(p_type) FROM part),
    audit AS (
        SELECT 'part' AS "table", r."column", 'string_replacement' AS action, r.original_value, r.new_value,
               (SELECT count(*) FROM cells c JOIN meets m ON c."column" = m."column" AND c.value = m.value
                WHERE m.no = r.no) AS occurrences
        FROM rules r)
"""
_STATUS_SQL = "CASE WHEN occurrences = 0 THEN 'Not Replaced' ELSE 'Replaced' END AS status"


@query(_PART_AUDIT_SQL + f"SELECT *, {_STATUS_SQL} FROM audit")
def replacement_audit(spark, folder):
    return op.replacement_audit(_parts(spark, folder), _PART_RULES, "part")


_CUSTOMER_AUDIT_SQL = """
    SELECT 'customer', 'c_mktsegment', 'string_replacement', old, new,
           (SELECT count(*) FROM customer WHERE lower(c_mktsegment) = old)
    FROM (VALUES ('building', 'construction'), ('machinery', 'machines'), ('retail', 'shops')) AS v(old, new)
"""


@query(_PART_AUDIT_SQL + f"SELECT *, {_STATUS_SQL} FROM (SELECT * FROM audit UNION ALL {_CUSTOMER_AUDIT_SQL})")
def audit_union(spark, folder):
    return op.combine_audits(
        [
            op.replacement_audit(_parts(spark, folder), _PART_RULES, "part"),
            op.replacement_audit(table(spark, folder, "customer"), _CUSTOMER_RULES, "customer"),
        ]
    )


# --- aggregation, profiling, checks ------------------------------------------------


@query("SELECT o_custkey, min(o_totalprice) AS o_totalprice FROM orders GROUP BY o_custkey")
def group_agg(spark, folder):
    return op.least_per_group(table(spark, folder, "orders"), "o_custkey", "o_totalprice")


@query(_CUSTOMER_GAPS_SQL + """
    SELECT unnest(['c_custkey', 'c_name', 'nation', 'segment', 'c_acctbal']) AS "column",
           unnest([count(*) - count(c_custkey), count(*) - count(c_name), count(*) - count(nation),
                   count(*) - count(segment), count(*) - count(c_acctbal)]) AS n_null
    FROM gaps
""")
def null_counts(spark, folder):
    return op.null_counts(_customer_gaps(spark, folder))


@query(_CUSTOMER_GAPS_SQL + 'SELECT nation, count(*) AS "count" FROM gaps WHERE nation IS NOT NULL GROUP BY nation')
def value_counts(spark, folder):
    return op.value_counts(_customer_gaps(spark, folder), "nation")


@query('SELECT l_orderkey, count(*) AS "count" FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1')
def duplicate_ids(spark, folder):
    return op.duplicate_ids(table(spark, folder, "lineitem"), "l_orderkey")


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = [f.name for f in df.schema if f.dataType.typeName() == "double"]
    return df.withColumns({name: F.round(name, digits) for name in doubles})


def _describe_sql(column: str) -> str:
    quartiles = ", ".join(
        f"round(quantile_cont({column}, {q}), 4) AS {name}" for name, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))
    )
    return f"""SELECT '{column}' AS "column", count({column}) AS "count", round(avg({column}), 4) AS mean,
        round(stddev_samp({column}), 4) AS std, round(min({column}), 4) AS min, {quartiles},
        round(max({column}), 4) AS max FROM lineitem"""


@query(" UNION ALL ".join(_describe_sql(c) for c in _MEASURES))
def describe_numeric(spark, folder):
    return _rounded(op.describe(table(spark, folder, "lineitem"), _MEASURES), 4)


def _profile_sql(column: str, kind: str, source: str = "gaps") -> str:
    number, text = kind == "numeric", kind == "categorical"

    def only(condition: bool, expression: str, type_name: str, name: str) -> str:
        return f"CAST({expression if condition else 'NULL'} AS {type_name}) AS {name}"

    top = f"(SELECT {{}} FROM (SELECT {column} AS v, count(*) AS c FROM {source} WHERE {column} IS NOT NULL GROUP BY v ORDER BY c DESC, v LIMIT 1))"
    facts = [
        f"'{column}' AS \"column\"",
        f"'{kind}' AS kind",
        "count(*) AS n",
        f"count(*) - count({column}) AS missing",
        f"round((count(*) - count({column})) * 100.0 / count(*), 4) AS missing_pct",
        f"count(DISTINCT {column}) AS \"distinct\"",
        f"count({column}) > 0 AND count(DISTINCT {column}) = count({column}) AS is_unique",
        f"count(DISTINCT {column}) = 1 AS is_constant",
        only(number, f"round(avg({column}), 4)", "DOUBLE", "mean"),
        only(number, f"round(stddev_samp({column}), 4)", "DOUBLE", "std"),
        only(number, f"min({column})", "DOUBLE", "min"),
        only(number, f"max({column})", "DOUBLE", "max"),
        only(number, f"count(*) FILTER ({column} = 0)", "BIGINT", "zeros"),
        only(kind == "datetime", f"min({column})", "TIMESTAMP", "earliest"),
        only(kind == "datetime", f"max({column})", "TIMESTAMP", "latest"),
        only(text, top.format("v"), "VARCHAR", "top"),
        only(text, top.format("c"), "BIGINT", "top_count"),
        only(text, f"min(length({column}))", "BIGINT", "min_length"),
        only(text, f"max(length({column}))", "BIGINT", "max_length"),
    ]
    return f"SELECT {', '.join(facts)} FROM {source}"


_GAP_KINDS = {
    "c_custkey": "numeric", "c_name": "categorical", "nation": "categorical",
    "segment": "categorical", "c_acctbal": "numeric",
}


@query(_CUSTOMER_GAPS_SQL + " UNION ALL ".join(_profile_sql(c, k) for c, k in _GAP_KINDS.items()))
def profile_columns(spark, folder):
    return _rounded(op.profile(_customer_gaps(spark, folder)), 4)


@query(
    _CUSTOMER_GAPS_SQL
    + ", unplaced AS (SELECT * FROM gaps WHERE nation IS NULL) "
    + " UNION ALL ".join(_profile_sql(c, k, "unplaced") for c, k in _GAP_KINDS.items())
)
def profile_subset(spark, folder):
    gaps = _customer_gaps(spark, folder)
    return _rounded(op.profile_subset(gaps, F.col("nation").isNull(), _GAP_KINDS), 4)


@query(_CUSTOMER_GAPS_SQL + "SELECT \"column\", kind, n, missing, mean, std, min, max, zeros, top, top_count, min_length, max_length FROM ("
       + " UNION ALL ".join(_profile_sql(c, k) for c, k in _GAP_KINDS.items() if c != "c_name") + ")")
def profile_sketches(spark, folder):
    """Profiles of two parts of the customers, stored as sketches and added up."""
    gaps = _customer_gaps(spark, folder).drop("c_name")
    path = src.scratch_dir(spark, "sketches")
    for part in (0, 1):
        op.sketch(gaps.where(f"c_custkey % 2 = {part}")).write.parquet(f"{path}/part={part}")
    parts = [spark.read.parquet(f"{path}/part={part}") for part in (0, 1)]
    out = op.profile_of(op.merge_sketches(*parts)).select(
        "column", "kind", "n", "missing", "mean", "std", "min", "max", "zeros", "top", "top_count", "min_length", "max_length"
    )
    return _rounded(out, 4)


_DATED_KINDS = {"o_orderkey": "numeric", "day": "datetime", "price": "numeric", "o_orderstatus": "categorical"}


@query("""
    WITH dated AS (
        SELECT o_orderkey, CASE WHEN o_totalprice >= 2000 THEN CAST(o_orderdate AS TIMESTAMP) END AS day,
               CASE WHEN o_totalprice <= 300000 THEN CAST(o_totalprice AS DOUBLE) END AS price, o_orderstatus
        FROM orders)
""" + " UNION ALL ".join(_profile_sql(c, k, "dated") for c, k in _DATED_KINDS.items()))
def profile_dates(spark, folder):
    price = F.col("o_totalprice").cast("double")
    dated = table(spark, folder, "orders").select(
        "o_orderkey",
        null_where(F.col("o_totalprice") < 2000, F.col("o_orderdate")).alias("day"),
        F.when(price > 300000, float("nan")).otherwise(price).alias("price"),
        "o_orderstatus",
    )
    return _rounded(op.profile(dated), 4)


def _rank_corr_sql(a: str, b: str) -> str:
    def rank(c: str) -> str:
        return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"

    return f"""SELECT '{a}' AS a, '{b}' AS b, 'spearman' AS method, round(corr(ra, rb), 6) AS corr
        FROM (SELECT {rank(a)} AS ra, {rank(b)} AS rb FROM seen WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


_PAIRS = [(a, b) for i, a in enumerate(_MEASURES) for b in _MEASURES[i + 1 :]]


@query(
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, 'pearson' AS method, round(corr({a}, {b}), 6) AS corr FROM lineitem"
        for a, b in _PAIRS
    )
)
def correlation_matrix(spark, folder):
    return _rounded(op.correlations(table(spark, folder, "lineitem"), _MEASURES))


@query("""
    WITH ranked AS (
        SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS ra,
               rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS rb
        FROM lineitem)
    SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, 'spearman' AS method, round(corr(ra, rb), 6) AS corr FROM ranked
""")
def correlation_spearman(spark, folder):
    lines = table(spark, folder, "lineitem")
    return _rounded(op.correlations(lines, ["l_quantity", "l_extendedprice"], "spearman"))


@query("""
    WITH seen AS (SELECT l_quantity, l_extendedprice, l_discount,
                         CASE WHEN l_linenumber > 1 THEN l_tax END AS l_tax FROM lineitem)
""" + " UNION ALL ".join(_rank_corr_sql(a, b) for a, b in _PAIRS))
def correlation_spearman_wide(spark, folder):
    lines = table(spark, folder, "lineitem").withColumn("l_tax", null_where(F.col("l_linenumber") <= 1, F.col("l_tax")))
    return _rounded(op.correlations(lines, _MEASURES, "spearman"))


def _dependency_sql(a: str, b: str, source: str) -> str:
    return f"""SELECT '{a}' AS a, '{b}' AS b, (SELECT count(DISTINCT {a}) FROM {source}) AS n_a,
        (SELECT count(DISTINCT {b}) FROM {source}) AS n_b,
        (SELECT max(n) FROM (SELECT count(DISTINCT {b}) AS n FROM {source} GROUP BY {a})) <= 1 AS a_determines_b,
        (SELECT max(n) FROM (SELECT count(DISTINCT {a}) AS n FROM {source} GROUP BY {b})) <= 1 AS b_determines_a"""


@query(
    _dependency_sql("c_custkey", "c_name", "customer")
    + " UNION ALL "
    + _dependency_sql("l_partkey", "l_suppkey", "lineitem")
)
def functional_dependency(spark, folder):
    accounts = op.functional_dependency(table(spark, folder, "customer"), "c_custkey", "c_name")
    return accounts.unionAll(op.functional_dependency(table(spark, folder, "lineitem"), "l_partkey", "l_suppkey"))


@query(
    " UNION ALL ".join(
        f"""SELECT a, b, CASE WHEN a_determines_b AND b_determines_a THEN '1:1' WHEN b_determines_a THEN '1:N'
            WHEN a_determines_b THEN 'N:1' ELSE 'N:M' END AS cardinality FROM ({_dependency_sql(a, b, t)})"""
        for a, b, t in (
            ("c_custkey", "c_name", "customer"),
            ("o_orderkey", "o_custkey", "orders"),
            ("o_orderstatus", "o_orderkey", "orders"),
            ("l_partkey", "l_suppkey", "lineitem"),
        )
    )
)
def relationship_cardinality(spark, folder):
    orders = table(spark, folder, "orders")
    return (
        op.cardinality(table(spark, folder, "customer"), "c_custkey", "c_name")
        .unionAll(op.cardinality(orders, "o_orderkey", "o_custkey"))
        .unionAll(op.cardinality(orders, "o_orderstatus", "o_orderkey"))
        .unionAll(op.cardinality(table(spark, folder, "lineitem"), "l_partkey", "l_suppkey"))
    )


@query(_CUSTOMER_GAPS_SQL + """
    SELECT count(*) AS n_rows,
           count(c_custkey) + count(c_name) + count(nation) + count(segment) + count(c_acctbal) AS n_cells,
           count(c_custkey) + count(c_name) + count(nation) + count(segment) + count(c_acctbal) > 1 AS "exceeds"
    FROM gaps WHERE nation IN ('3', '7')
""")
def count_exceeds(spark, folder):
    return op.count_exceeds(_customer_gaps(spark, folder), "nation", ["3", "7"])


@query("""
    SELECT DISTINCT l_orderkey FROM lineitem
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')
""")
def fk_orphans(spark, folder):
    settled = table(spark, folder, "orders").where("o_orderstatus <> 'P'")
    return op.fk_orphans(table(spark, folder, "lineitem"), settled, "l_orderkey", "o_orderkey")


# --- similarity --------------------------------------------------------------------


@query("""
    WITH names AS (SELECT DISTINCT p_name AS v FROM part)
    SELECT * FROM (
        SELECT a.v AS p_name, b.v AS matched_p_name,
               round((1 - levenshtein(a.v, b.v)::DOUBLE / greatest(length(a.v), length(b.v))) * 100.0, 6)
                   AS similarity_score
        FROM names a JOIN names b ON a.v < b.v)
    WHERE similarity_score >= 77 AND similarity_score < 100
""")
def similar_values_levenshtein(spark, folder):
    return _rounded(op.similar_values(table(spark, folder, "part"), "p_name", 77, "levenshtein"))


# Longest common subsequence by bit arithmetic: masks of where each character of x
# stands, then one step per character of y.
_COMMON_SQL = """
    lcs AS (
        SELECT p.*, length(x) - bit_count(list_reduce(
            list_transform(string_split(y, ''), lambda c: coalesce(list_sum(list_transform(range(length(x)),
                lambda i: CASE WHEN x[i + 1] = c THEN 1::HUGEINT << i::INTEGER ELSE 0::HUGEINT END)), 0)::HUGEINT),
            lambda s, m: ((s + (s & m)) | (s - (s & m))) & ((1::HUGEINT << length(x)::INTEGER) - 1),
            (1::HUGEINT << length(x)::INTEGER) - 1)) AS common
        FROM pairs p),
"""


@query(f"""
    WITH names AS (SELECT DISTINCT p_name AS v FROM part),
    pairs AS (SELECT a.v AS x, b.v AS y FROM names a JOIN names b ON a.v < b.v),
    {_COMMON_SQL}
    scored AS (SELECT x, y, round(200.0 * common / (length(x) + length(y)), 6) AS score FROM lcs)
    SELECT x AS p_name, y AS matched_p_name, score::DOUBLE AS similarity_score FROM scored
    WHERE score >= 80 AND score < 100
""")
def similar_values_indel(spark, folder):
    ship_package(spark)
    return _rounded(op.similar_values(table(spark, folder, "part"), "p_name", 80, "indel"))


@query(f"""
    WITH names AS (SELECT DISTINCT url AS v FROM pages WHERE url <> ''),
    pairs AS (SELECT a.v AS x, b.v AS y FROM names a JOIN names b ON a.v < b.v),
    {_COMMON_SQL}
    scored AS (SELECT x, y, round(200.0 * common / (length(x) + length(y)), 6) AS score FROM lcs)
    SELECT x AS url, y AS matched_url, score::DOUBLE AS similarity_score FROM scored
    WHERE score >= 90 AND score < 100
""")
def similar_values_lsh(spark, folder):
    ship_package(spark)
    return _rounded(op.similar_values(table(spark, folder, "pages"), "url", 90, "indel", method="lsh"))


# At 90 a partial score counts only where the shorter text stands in the longer one.
_WEIGHTED_SQL = f"""
    WITH names AS (SELECT DISTINCT p_name AS v, list_distinct(string_split(p_name, ' ')) AS w FROM part),
    joined AS (
        SELECT a.v AS a, b.v AS b, greatest(length(a.v), length(b.v))::DOUBLE / least(length(a.v), length(b.v)) AS r,
               list_sort(list_intersect(a.w, b.w)) AS shared,
               list_sort(list_filter(a.w, lambda t: NOT list_contains(b.w, t))) AS only_a,
               list_sort(list_filter(b.w, lambda t: NOT list_contains(a.w, t))) AS only_b
        FROM names a JOIN names b ON a.v < b.v),
    pairs AS (
        SELECT *, a AS x, b AS y, 1.0 AS weight FROM joined
        UNION ALL SELECT *, array_to_string(list_sort(string_split(a, ' ')), ' '),
                         array_to_string(list_sort(string_split(b, ' ')), ' '), 0.95 FROM joined WHERE r < 1.5
        UNION ALL SELECT *, array_to_string(list_concat(shared, only_a), ' '),
                         array_to_string(list_concat(shared, only_b), ' '), 0.95 FROM joined WHERE r < 1.5
        UNION ALL SELECT *, array_to_string(shared, ' '), array_to_string(list_concat(shared, only_a), ' '), 0.95
                  FROM joined WHERE r < 1.5 AND len(shared) > 0
        UNION ALL SELECT *, array_to_string(shared, ' '), array_to_string(list_concat(shared, only_b), ' '), 0.95
                  FROM joined WHERE r < 1.5 AND len(shared) > 0),
    {_COMMON_SQL}
    parts AS (
        SELECT a, b, 200.0 * common / (length(x) + length(y)) * weight AS score FROM lcs
        UNION ALL SELECT a, b, 95.0 FROM joined
                  WHERE r < 1.5 AND len(shared) > 0 AND (len(only_a) = 0 OR len(only_b) = 0)
        UNION ALL SELECT a, b, 90.0 FROM joined
                  WHERE r >= 1.5 AND r <= 8 AND (contains(a, b) OR contains(b, a))),
    scored AS (SELECT a, b, round(max(score), 6)::DOUBLE AS score FROM parts GROUP BY a, b)
"""


@query(_WEIGHTED_SQL + """
    SELECT a AS p_name, b AS matched_p_name, score AS similarity_score FROM scored WHERE score >= 86 AND score < 100
""")
def similar_values_wratio(spark, folder):
    ship_package(spark)
    return _rounded(op.similar_values(table(spark, folder, "part"), "p_name", 86))


@query("""
    WITH names AS (SELECT p_name AS v, count(*) AS n FROM part GROUP BY p_name),
    scored AS (
        SELECT a.v AS a, b.v AS b, a.n AS an, b.n AS bn,
               round((1 - levenshtein(a.v, b.v)::DOUBLE / greatest(length(a.v), length(b.v))) * 100.0, 6) AS score
        FROM names a JOIN names b ON a.v < b.v)
    SELECT CASE WHEN an > bn THEN b ELSE a END AS original_value, CASE WHEN an > bn THEN a ELSE b END AS new_value,
           least(an, bn) AS original_count, greatest(an, bn) AS new_count, score AS similarity_score
    FROM scored WHERE score >= 80 AND score < 100
""")
def suggest_replacements(spark, folder):
    return _rounded(op.suggest_replacements(table(spark, folder, "part"), "p_name", 80, "levenshtein"))


# --- reshape -----------------------------------------------------------------------


@query("""
    SELECT o_orderkey, CASE WHEN o_orderstatus = substr(o_orderpriority, 3, 1) THEN o_orderstatus
        ELSE o_orderstatus || '_' || substr(o_orderpriority, 3, 1) END AS group_variable
    FROM orders
""")
def conditional_concat(spark, folder):
    letter = F.substr(F.col("o_orderpriority"), F.lit(3), F.lit(1))
    return table(spark, folder, "orders").select(
        "o_orderkey", fn.conditional_concat(F.col("o_orderstatus"), letter).alias("group_variable")
    )


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("""
    WITH cells AS (SELECT o_custkey, o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)
    SELECT o_custkey, o_orderstatus, max(n) FILTER (o_orderpriority = '1-URGENT') AS "1_urgent",
           max(n) FILTER (o_orderpriority = '2-HIGH') AS "2_high",
           max(n) FILTER (o_orderpriority = '3-MEDIUM') AS "3_medium",
           max(n) FILTER (o_orderpriority = '4-NOT SPECIFIED') AS "4_not_specified",
           max(n) FILTER (o_orderpriority = '5-LOW') AS "5_low"
    FROM cells GROUP BY o_custkey, o_orderstatus
""")
def pivot_wide(spark, folder):
    cells = (
        table(spark, folder, "orders")
        .groupBy("o_custkey", "o_orderstatus", "o_orderpriority")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return op.pivot_wide(cells, ["o_custkey", "o_orderstatus"], "o_orderpriority", "n", _PRIORITIES)


@query("SELECT c_custkey AS accountid, c_name AS accountname, c_acctbal AS balance FROM customer")
def wide_projection(spark, folder):
    columns = {"c_custkey": "accountid", "c_name": "accountname", "c_acctbal": "balance"}
    return op.project(table(spark, folder, "customer"), columns)


# --- keys and dimensions -----------------------------------------------------------


@query(_CUSTOMER_GAPS_SQL + "SELECT c_custkey, md5(segment) AS segmentid FROM gaps")
def md5_key(spark, folder):
    return _customer_gaps(spark, folder).select("c_custkey", fn.md5_key(F.col("segment")).alias("segmentid"))


@query(_CUSTOMER_GAPS_SQL + """
    SELECT c_custkey, sha1(concat(c_name, segment, nation)) AS plain,
           sha1(concat_ws(chr(31), c_name, segment, nation)) AS separated
    FROM gaps
""")
def sha1_key(spark, folder):
    parts = [F.col("c_name"), F.col("segment"), F.col("nation")]
    return _customer_gaps(spark, folder).select(
        "c_custkey", fn.sha1_key(*parts).alias("plain"), fn.sha1_key(*parts, sep="\x1f").alias("separated")
    )


def _register(spark: SparkSession, folder: str) -> DataFrame:
    """Orders and their customers in the layout of the premises register."""
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_custkey").alias("account_number"),
        F.col("c_name").alias("account_name"),
        F.col("o_orderpriority").alias("premises_activity"),
        F.col("o_orderstatus").alias("local_authority"),
        F.col("c_name").alias("address_line_1"),
        null_where(F.col("c_acctbal") < 1000, F.col("c_mktsegment")).alias("address_line_2"),
        F.col("c_nationkey").cast("string").alias("city"),
        F.date_format("o_orderdate", "yyyy").alias("postcode"),
    )


_REGISTER_SQL = """
    WITH register AS (
        SELECT c_custkey AS account_number, c_name AS account_name, o_orderpriority AS premises_activity,
               o_orderstatus AS local_authority, c_name AS address_line_1,
               CASE WHEN NOT c_acctbal < 1000 THEN c_mktsegment END AS address_line_2,
               CAST(c_nationkey AS VARCHAR) AS city, strftime(o_orderdate, '%Y') AS postcode
        FROM orders JOIN customer ON o_custkey = c_custkey)
"""
_PREMISES_ID = "sha1(concat(address_line_1, address_line_2, city, postcode))"


@query(_REGISTER_SQL + "SELECT DISTINCT account_number AS accountid, account_name FROM register")
def dim_accounts(spark, folder):
    return star.dim_accounts(_register(spark, folder))


@query(_REGISTER_SQL + f"""
    SELECT {_PREMISES_ID} AS premisesid, address_line_1, address_line_2, city, postcode,
           min(local_authority) AS local_authority,
           concat_ws(', ', address_line_1, address_line_2, city, postcode) AS full_address
    FROM register GROUP BY address_line_1, address_line_2, city, postcode
""")
def dim_premises(spark, folder):
    return star.dim_premises(_register(spark, folder))


@query(_REGISTER_SQL + f"""
    SELECT DISTINCT {_PREMISES_ID} AS premisesid, account_number AS accountid, account_name FROM register
""")
def dim_account_premises(spark, folder):
    return star.dim_account_premises(_register(spark, folder))


_AS_DEPRIVATION = {
    "imd_rank_2019": "n_nationkey",
    "income": "count(c_custkey)",
    "employment": "min(c_acctbal)",
    "education_skills_and_training": "max(c_acctbal)",
    "health_deprivation_and_disability": "count(DISTINCT c_mktsegment)",
    "crime": "min(c_custkey)",
    "barriers_to_housing_and_services": "max(c_custkey)",
    "living_environment": "max(c_name)",
}


@query(
    "SELECT n_regionkey AS constituencyid, n_name AS constituencyname, "
    + ", ".join(f"{sql} AS {name}" for name, sql in _AS_DEPRIVATION.items())
    + " FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_regionkey, n_name"
)
def dim_deprivation(spark, folder):
    joined = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.expr("c_nationkey = n_nationkey"))
    measures = [F.expr(sql).alias(name) for name, sql in _AS_DEPRIVATION.items() if name != "imd_rank_2019"]
    areas = joined.groupBy("n_nationkey", "n_regionkey", "n_name").agg(*measures)
    named = {"n_regionkey": "onsconstid", "n_name": "constituencyname", "n_nationkey": "imd_rank_2019"}
    return star.dim_deprivation(op.rename(areas, named))


@query(_REGISTER_SQL + f"""
    SELECT DISTINCT sha1(concat_ws(chr(31), {_PREMISES_ID}, premises_activity)) AS premises_licenceid,
           {_PREMISES_ID} AS premisesid, premises_activity AS activity
    FROM register
""")
def dim_activity(spark, folder):
    return star.dim_activity(_register(spark, folder))


@query("""
    SELECT o_orderkey, c_name AS postcode, md5(c_name) AS postcodeid, c_mktsegment AS postcode_area,
           CAST(c_nationkey AS VARCHAR) AS postcode_district, n_name AS constituency,
           CASE WHEN n_regionkey <> 1 THEN n_nationkey END AS constituencyid
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND o_orderstatus <> 'P' AND c_acctbal > 0
    LEFT JOIN nation ON n_nationkey = c_nationkey
""")
def place_premises(spark, folder):
    customer = table(spark, folder, "customer")
    named = customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("postcode"), "c_acctbal")
    known = (F.col("o_orderstatus") != "P") & (F.col("c_acctbal") > 0)
    premises = (
        table(spark, folder, "orders")
        .join(named, "o_custkey")
        .select("o_orderkey", F.when(known, F.col("postcode")).alias("postcode"))
    )
    nation = table(spark, folder, "nation")
    postcodes = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_name").alias("postcode"),
        fn.md5_key(F.col("c_name")).alias("postcodeid"),
        F.col("c_mktsegment").alias("postcode_area"),
        F.col("c_nationkey").cast("string").alias("postcode_district"),
        F.col("n_name").alias("constituency"),
    )
    classes = nation.where("n_regionkey <> 1").select(
        F.col("n_nationkey").alias("constituencyid"), F.col("n_name").alias("constituencyname")
    )
    return star.place_premises(premises, postcodes, classes)


_AS_POSTCODES = {
    "postcode": "p_name || ' ' || p_partkey",
    "postcode_area": "p_brand",
    "postcode_district": "p_name",
    "in_use": "CASE WHEN p_size > 25 THEN 'Yes' ELSE 'No' END",
    "latitude": "p_retailprice",
    "longitude": "-p_retailprice",
    "constituency": "p_type",
    "average_income": "p_retailprice * 2",
    "population": "p_size",
    "households": "p_size - 1",
    "distance_to_station": "p_retailprice / 2",
    "index_of_multiple_deprivation": "p_partkey",
}


@query(
    "WITH postcodes AS (SELECT "
    + ", ".join(f"{sql} AS {name}" for name, sql in _AS_POSTCODES.items())
    + " FROM part) SELECT md5(postcode) AS postcodeid, * FROM postcodes"
)
def dim_postcodes(spark, folder):
    columns = [F.expr(sql).alias(name) for name, sql in _AS_POSTCODES.items()]
    return star.dim_postcodes(table(spark, folder, "part").select(*columns))


@query("""
    WITH cells AS (
        SELECT user_id, event_type, CASE WHEN event_type = 'error' THEN 'error' WHEN value < 20 THEN 'low - end'
               ELSE 'high' END AS band, count(*) AS n
        FROM events GROUP BY ALL)
    SELECT user_id AS constituencyid, 'user ' || user_id AS constituencyname,
           max(n) FILTER (event_type = 'error') AS errors,
           max(n) FILTER (event_type = 'click' AND band = 'low - end') AS small_clicks,
           max(n) FILTER (event_type = 'click' AND band = 'high') AS large_clicks,
           max(n) FILTER (event_type = 'purchase' AND band = 'high') AS large_purchases
    FROM cells GROUP BY user_id
""")
def dim_wide(spark, folder):
    kind, value = F.col("event_type"), F.col("value")
    band = F.when(kind == "error", "error").when(value < 20, "low - end").otherwise("high")
    cells = (
        table(spark, folder, "events")
        .groupBy(F.col("user_id").alias("onsconstid"), kind.alias("groups"), band.alias("variables"))
        .agg(F.count(F.lit(1)).alias("con_num"))
        .withColumn("constituencyname", F.concat(F.lit("user "), "onsconstid"))
    )
    columns = {
        "error": "errors",
        "click_low___end": "small_clicks",
        "click_high": "large_clicks",
        "purchase_high": "large_purchases",
    }
    return star.dim_classes(cells, ["error", "click_low - end", "click_high", "purchase_high"], columns)


def _day(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _snapshots(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The customers, and a later snapshot of them with changes, new keys and missing ones."""
    customer = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    balance = F.col("c_acctbal")
    segment = F.when(balance < 0, "CHANGED").when(balance < 100, None).otherwise(F.col("c_mktsegment"))
    new = table(spark, folder, "supplier").select(
        (-1 - F.col("s_suppkey")).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"), F.col("s_acctbal")
    )
    return customer, customer.where(balance < 9000).withColumn("c_mktsegment", segment).unionAll(new)


@query("""
    WITH snapshot AS (
        SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'CHANGED' WHEN c_acctbal < 100 THEN NULL
               ELSE c_mktsegment END AS c_mktsegment, c_acctbal
        FROM customer WHERE c_acctbal < 9000
        UNION ALL SELECT -1 - s_suppkey, 'NEW', s_acctbal FROM supplier),
    history AS (
        SELECT c_custkey, c_mktsegment, c_acctbal, TIMESTAMP '2024-01-01' AS valid_from,
               CAST(NULL AS TIMESTAMP) AS valid_to, TRUE AS is_current FROM customer
        UNION ALL SELECT c_custkey, 'OLD', c_acctbal, TIMESTAMP '2023-01-01', TIMESTAMP '2024-01-01', FALSE
                  FROM customer WHERE c_acctbal > 5000),
    joined AS (
        SELECT h.*, s.c_mktsegment AS now, s.c_custkey IS NOT NULL AS in_both,
               s.c_custkey IS NOT NULL AND h.is_current AND h.c_mktsegment IS DISTINCT FROM s.c_mktsegment AS changed
        FROM history h LEFT JOIN snapshot s ON h.c_custkey = s.c_custkey AND h.is_current)
    SELECT c_custkey, c_mktsegment, c_acctbal, valid_from,
           CASE WHEN changed THEN TIMESTAMP '2024-06-01' ELSE valid_to END AS valid_to,
           is_current AND NOT changed AS is_current FROM joined
    UNION ALL SELECT c_custkey, now, c_acctbal, TIMESTAMP '2024-06-01', NULL, TRUE FROM joined WHERE changed
    UNION ALL SELECT c_custkey, c_mktsegment, c_acctbal, TIMESTAMP '2024-06-01', NULL, TRUE FROM snapshot
              WHERE c_custkey < 0
""")
def scd2_merge(spark, folder):
    customer, snapshot = _snapshots(spark, folder)
    balance, day = F.col("c_acctbal"), _day
    past = customer.where(balance > 5000).select(
        "c_custkey", F.lit("OLD").alias("c_mktsegment"), "c_acctbal", day("2023-01-01").alias("valid_from"),
        day("2024-01-01").alias("valid_to"), F.lit(False).alias("is_current"),
    )
    history = op.scd2_open(customer, day("2024-01-01")).unionByName(past)
    return op.scd2_merge(history, snapshot, ["c_custkey"], ["c_mktsegment"], day("2024-06-01"))


@query("""
    WITH snapshot AS (
        SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'CHANGED' WHEN c_acctbal < 100 THEN NULL
               ELSE c_mktsegment END AS c_mktsegment, c_acctbal
        FROM customer WHERE c_acctbal < 9000
        UNION ALL SELECT -1 - s_suppkey, 'NEW', s_acctbal FROM supplier),
    first AS (
        SELECT a.c_custkey, a.c_mktsegment AS old, s.c_mktsegment AS now, a.c_acctbal, s.c_custkey IS NULL AS gone,
               s.c_custkey IS NULL OR a.c_mktsegment IS DISTINCT FROM s.c_mktsegment AS closed
        FROM customer a LEFT JOIN snapshot s USING (c_custkey)),
    versions AS (
        SELECT c_custkey, old AS c_mktsegment, c_acctbal, TIMESTAMP '2024-01-01' AS valid_from,
               CASE WHEN closed THEN TIMESTAMP '2024-06-01' END AS valid_to FROM first
        UNION ALL SELECT c_custkey, now, c_acctbal, TIMESTAMP '2024-06-01', NULL FROM first WHERE closed AND NOT gone
        UNION ALL SELECT c_custkey, c_mktsegment, c_acctbal, TIMESTAMP '2024-06-01', NULL FROM snapshot WHERE c_custkey < 0)
    SELECT c_custkey, c_mktsegment, c_acctbal, valid_from, valid_to, valid_to IS NULL AS is_current FROM versions
""")
def merge_history(spark, folder):
    customer, snapshot = _snapshots(spark, folder)
    path = src.scratch_dir(spark, "history")
    history.merge_history(customer, path, ["c_custkey"], ["c_mktsegment"], _day("2024-01-01"), close_missing=True)
    return history.merge_history(snapshot, path, ["c_custkey"], ["c_mktsegment"], _day("2024-06-01"), close_missing=True)


# --- enrichment --------------------------------------------------------------------


def _responses(spark: SparkSession, folder: str) -> DataFrame:
    """A stored search response per customer: some empty, some lacking fields, some broken."""
    segment = F.col("c_mktsegment")
    place = F.struct(
        F.concat(F.lit("place "), "c_custkey").alias("id"),
        F.when(segment != "FURNITURE", F.col("c_name")).alias("formattedAddress"),
        F.when(F.col("c_acctbal") > 0, "OPERATIONAL").alias("businessStatus"),
    )
    other = F.struct(F.lit("other").alias("id"), F.lit("x").alias("formattedAddress"), F.lit("y").alias("businessStatus"))
    answer = F.to_json(F.struct(F.array(place, other).alias("places")))
    return table(spark, folder, "customer").select(
        F.col("c_name").alias("full_address"),
        fn.sha1_key(F.col("c_name")).alias("premisesid"),
        F.when(segment == "HOUSEHOLD", '{"places":[]}')
        .when(segment == "BUILDING", "{}")
        .when(segment == "MACHINERY", '{"places":[{')
        .otherwise(answer)
        .alias("response"),
    )


@query("""
    SELECT c_name AS full_address, sha1(c_name) AS premisesid, 'place ' || c_custkey AS g_place_id,
           CASE WHEN c_mktsegment <> 'FURNITURE' THEN c_name ELSE 'Missing' END AS g_formatted_address_1,
           CASE WHEN c_acctbal > 0 THEN 'OPERATIONAL' ELSE 'Missing' END AS g_business_status_1,
           TIMESTAMP '2025-01-01 12:00:00' AS api_call_date
    FROM customer WHERE c_mktsegment IN ('FURNITURE', 'AUTOMOBILE')
""")
def flatten_responses(spark, folder):
    as_of = F.lit("2025-01-01 12:00:00").cast("timestamp_ntz")
    return op.flatten_responses(_responses(spark, folder), "response", as_of)


@query("""
    SELECT sha1(c_name) AS premisesid, c_name AS full_address, 'place ' || c_custkey AS g_place_id,
           CASE WHEN c_mktsegment <> 'FURNITURE' THEN c_name ELSE 'Missing' END AS g_formatted_address,
           CASE WHEN c_acctbal > 0 THEN 'OPERATIONAL' ELSE 'Missing' END AS g_business_status,
           CASE WHEN c_acctbal > 5000 THEN TIMESTAMP '2025-02-01' ELSE TIMESTAMP '2025-01-01' END AS api_call_date
    FROM customer WHERE c_mktsegment IN ('FURNITURE', 'AUTOMOBILE')
""")
def dim_business_status(spark, folder):
    def asked(day: str, where: Column) -> DataFrame:
        customers = table(spark, folder, "customer").where(where).select(F.col("c_name").alias("full_address"))
        again = _responses(spark, folder).join(customers, "full_address", "left_semi")
        return op.flatten_responses(again, "response", F.lit(day).cast("timestamp_ntz"))

    first, second = asked("2025-01-01", F.lit(True)), asked("2025-02-01", F.col("c_acctbal") > 5000)
    return star.dim_business_status(first.unionAll(second))


@query("""
    SELECT count(*) FILTER (c_mktsegment IN ('FURNITURE', 'AUTOMOBILE')) AS found,
           count(*) FILTER (c_mktsegment IN ('HOUSEHOLD', 'BUILDING')) AS empty,
           count(*) FILTER (c_mktsegment = 'MACHINERY') AS unreadable
    FROM customer
""")
def response_counts(spark, folder):
    return op.response_counts(_responses(spark, folder), "response")


@query("""
    SELECT count(*) FILTER (c_mktsegment IN ('FURNITURE', 'AUTOMOBILE')) AS found,
           count(*) FILTER (c_mktsegment IN ('HOUSEHOLD', 'BUILDING')) AS empty,
           count(*) FILTER (c_mktsegment = 'MACHINERY') AS unreadable,
           count(*) FILTER (c_mktsegment IN ('FURNITURE', 'AUTOMOBILE')) AS n_written
    FROM customer
""")
def flatten_counts(spark, folder):
    """What the run that writes the flattened responses saw of them."""
    seen = Observation("responses")
    flat = op.flatten_responses(_responses(spark, folder), "response", _day("2025-01-01"), counts=seen)
    written = src.write_table(flat, src.scratch_dir(spark, "responses"), "CLEAN", "responses")
    counts = seen.get
    found = spark.createDataFrame([tuple(counts[c] for c in ("found", "empty", "unreadable"))], "found long, empty long, unreadable long")
    return found.crossJoin(spark.read.parquet(written).agg(F.count("*").alias("n_written")))


@query("""
    SELECT DISTINCT o_custkey FROM orders
    WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)
""")
def pending_enrichment(spark, folder):
    answered = table(spark, folder, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return op.pending_enrichment(table(spark, folder, "orders").select("o_custkey"), answered, ["o_custkey"])


# --- star schema and marts ---------------------------------------------------------


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, o_custkey, o_orderpriority, c_name, n_name
    FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus <> 'P'
    LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
""")
def star_join(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    orders = table(spark, folder, "orders").where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority"
    )
    customer = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    joined = star.star_join(lines, [(orders, "l_orderkey"), (customer, "o_custkey"), (nation, "c_nationkey")])
    return joined.drop("c_nationkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "o_custkey", "o_orderpriority", "c_name", "n_name"
    )


def _areas(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as premises, their orders and events as what hangs off them, by nation."""
    premises = table(spark, folder, "customer").select(F.col("c_nationkey").alias("area"), F.col("c_custkey").alias("key"))
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("key"))
    events = table(spark, folder, "events").select(F.col("user_id").alias("key"))
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").alias("area"), "n_name")
    wealth = (
        table(spark, folder, "supplier")
        .groupBy(F.col("s_nationkey").alias("area"))
        .agg(F.round(F.avg("s_acctbal"), 4).alias("balance"), F.count(F.lit(1)).alias("suppliers"))
    )
    return mart.mart_by_area(premises, "area", "key", {"orders": orders, "events": events}, [nation, wealth])


_AREAS_SQL = """
    WITH o AS (SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY key),
    e AS (SELECT user_id AS key, count(*) AS n FROM events GROUP BY key),
    counts AS (
        SELECT c_nationkey AS area, count(*) AS n_premises, CAST(coalesce(sum(o.n), 0) AS BIGINT) AS n_orders,
               CAST(coalesce(sum(e.n), 0) AS BIGINT) AS n_events
        FROM customer LEFT JOIN o ON o.key = c_custkey LEFT JOIN e ON e.key = c_custkey GROUP BY c_nationkey),
    wealth AS (SELECT s_nationkey AS area, round(avg(s_acctbal), 4) AS balance, count(*) AS suppliers
               FROM supplier GROUP BY s_nationkey),
    areas AS (
        SELECT counts.*, n_name, balance, suppliers FROM counts
        LEFT JOIN nation ON n_nationkey = counts.area LEFT JOIN wealth ON wealth.area = counts.area)
"""


@query(_AREAS_SQL + "SELECT * FROM areas")
def mart_by_area(spark, folder):
    return _areas(spark, folder)


@query(
    _AREAS_SQL
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, 'pearson' AS method, round(corr({a}, {b}), 6) AS corr FROM areas"
        for a in ("n_premises", "n_orders", "n_events")
        for b in ("balance", "suppliers")
    )
)
def mart_correlation(spark, folder):
    found = mart.mart_correlation(
        _areas(spark, folder), ["n_premises", "n_orders", "n_events"], ["balance", "suppliers"]
    )
    return _rounded(found)


# --- cleaning by rule --------------------------------------------------------------

_CLEANING_RULES = {
    "deduplication_rules": {"deduplicate": True},
    "imputation_rules": {
        "Nation": {"type": "categorical", "method": "MAR", "reference_column": "segment"},
        "balance": {"type": "numeric", "method": "MAR", "reference_column": "segment"},
        "segment": {"type": "categorical", "method": "NMAR", "fill_value": "Missing"},
    },
    "replacement_rules": {"segment": {"BUILDING": "construction", "Missing": "unknown", "none": "x"}},
}


def _messy(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer of some nations twice, with gaps, all as text under awkward headers."""
    gaps = _customer_gaps(spark, folder).select(
        F.col("c_custkey").alias("_TABLE_ key"),
        F.col("nation").alias(" Nation"),
        F.col("segment").alias("Segment!"),
        null_where(F.col("c_acctbal").between(2000, 3000), F.col("c_acctbal").cast("string")).alias("Balance"),
    )
    return gaps.unionAll(gaps.where("` Nation` IN ('1', '2', '3')"))


_MESSY_SQL = f"""
    WITH gaps AS (
        SELECT c_custkey AS default_key, CASE WHEN NOT c_acctbal > 9000 THEN CAST(c_nationkey AS VARCHAR) END AS nation,
               CASE WHEN NOT c_acctbal < 1000 THEN c_mktsegment END AS segment,
               CASE WHEN NOT c_acctbal BETWEEN 2000 AND 3000 THEN c_acctbal END AS balance
        FROM customer),
    filled AS (
        SELECT default_key, segment, {_fill_sql("nation", "segment", "default_key")},
               {_fill_sql("balance", "segment", "default_key")} FROM gaps),
    lowered AS (SELECT default_key, nation, balance, lower(coalesce(segment, 'Missing')) AS segment FROM filled)
"""


@query(_MESSY_SQL + """
    SELECT default_key, nation, balance,
           CASE segment WHEN 'building' THEN 'construction' WHEN 'missing' THEN 'unknown' ELSE segment END AS segment
    FROM lowered
""")
def clean_table(spark, folder):
    messy = _messy(spark, folder)
    return cleaning.clean_table(messy, _CLEANING_RULES, ["default_key"], "customer")[0]


@query(_MESSY_SQL + _PART_AUDIT_SQL.replace("WITH rules", ", rules", 1) + f"""
    SELECT *, {_STATUS_SQL} FROM (
        SELECT 'customer' AS "table", 'segment' AS "column", 'string_replacement' AS action, old AS original_value,
               new AS new_value, (SELECT count(*) FROM lowered WHERE segment = old) AS occurrences
        FROM (VALUES ('building', 'construction'), ('missing', 'unknown'), ('none', 'x')) AS v(old, new)
        UNION ALL SELECT * FROM audit)
""")
def clean_tables_audit(spark, folder):
    return _cleaned_tables(spark, folder)[0]


@query("""
    WITH again AS (SELECT count(*) AS n FROM customer WHERE c_nationkey IN (1, 2, 3) AND NOT c_acctbal > 9000)
    SELECT 'customer' AS name, 'cleaned' AS status, count(*) + any_value(n) AS n_read, any_value(n) AS n_dropped,
           count(*) AS n_written FROM customer, again
    UNION ALL SELECT 'part', 'cleaned', count(*), 0, count(*) FROM part
    UNION ALL SELECT 'absent', 'failed', NULL, NULL, NULL
""")
def clean_tables_counts(spark, folder):
    return _cleaned_tables(spark, folder)[1].drop("error")


def _cleaned_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    base = src.scratch_dir(spark, "cleaning")
    part_rules = {"deduplication_rules": {}, "imputation_rules": {}, "replacement_rules": _PART_RULES}
    specs = [
        cleaning.TableSpec(
            "customer", src.write_table(_messy(spark, folder), base, "RAW", "customer", "csv"), _CLEANING_RULES
        ),
        cleaning.TableSpec("part", src.write_table(_parts(spark, folder), base, "RAW", "part", "csv"), part_rules),
        cleaning.TableSpec("absent", f"{base}/RAW/absent.csv", part_rules),
    ]
    return cleaning.run_pipeline(spark, specs, base)


# --- the driver's contract ---------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Premises, orders and events per area, beside the area's measures."""
    return mart_by_area(spark, "/root/testdata/sf0.001")


def _language_model_part() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and SQL of ``curate.llm`` and the corpus pipeline, if they are there."""
    try:
        import corpus_pipeline
        from curate.llm import queries as llm
    except ModuleNotFoundError as missing:
        if missing.name not in ("corpus_pipeline", "curate.llm"):
            raise
        return {}, {}
    found = llm.queries() | {"pipeline": corpus_pipeline.run}
    sql = llm.oracle_sql()
    if corpus_pipeline.ORACLE_SQL:
        sql = sql | {"pipeline": corpus_pipeline.ORACLE_SQL}
    return found, sql


def queries() -> dict[str, Query]:
    return _QUERIES | _language_model_part()[0]


def oracle_sql() -> dict[str, str]:
    return _ORACLES | _language_model_part()[1]
