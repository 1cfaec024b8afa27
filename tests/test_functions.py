import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from curate import functions as fn

NAMES = {
    "_TABLE_55helloworld": "default55helloworld",
    ",,, 93helloworld": "_93helloworld",
    "helloworld" * 301: ("helloworld" * 301)[:300],
    "": "column_",
    "9lives": "column_9lives",
    "In Use?": "in_use",
    "Rural/Urban": "ruralurban",
    "_FILE_" + "a" * 300: "default" + "a" * 294,
    "\t x y  ": "x_y",
    "__ROOT___FILE_": "default_file_",
}


def test_standardize_name(spark):
    df = spark.createDataFrame([(name,) for name in NAMES], "name string")
    found = {r.name: r.out for r in df.select("name", fn.standardize_name(F.col("name")).alias("out")).collect()}
    assert found == NAMES
    assert {name: fn.standardize_header(name) for name in NAMES} == NAMES


@given(st.text(max_size=280))
@settings(max_examples=300)
def test_header_grammar(name):
    out = fn.standardize_header(name)
    assert re.fullmatch("[a-z_][a-z0-9_]*", out)
    assert fn.standardize_header(out) == out


def test_strip_knows_all_white_space(spark):
    df = spark.createDataFrame([(" \t \x1cab c　\n",)], "t string")
    assert df.select(fn.strip(F.col("t"))).first()[0] == "ab c"


def test_normalise_text(spark):
    df = spark.createDataFrame([(" NEW quay ",), (None,)], "t string")
    cases = [fn.normalise_text(F.col("t"), case) for case in (None, "lower", "capitalise")]
    assert [tuple(r) for r in df.select(*cases).collect()] == [("NEW quay", "new quay", "New quay"), (None, None, None)]
    with pytest.raises(ValueError):
        fn.normalise_text(F.col("t"), "title")


def test_conditional_concat(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b")], "x string, y string")
    assert [r[0] for r in df.select(fn.conditional_concat(F.col("x"), F.col("y"))).collect()] == ["a", "a_b"]


def test_parse_number(spark):
    texts = {
        "1": 1.0, " 2 ": 2.0, "1e3": 1000.0, "inf": float("inf"), "-Infinity": float("-inf"), ".5": 0.5, "-7.": -7.0,
        "x": None, "0x10": None, "0x1p3": None, "1,000": None, "1d": None, "2f": None, "nan": None, "": None, "1 2": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.n for r in df.select("t", fn.parse_number(F.col("t")).alias("n")).collect()} == texts


def test_parse_times(spark):
    df = spark.createDataFrame([("2020-13-01 00:00:00",), ("2020-01-02 03:04:05",), ("2020-1-2",), (None,)], "t string")
    stamps = [str(r[0]) for r in df.select(fn.parse_timestamp(F.col("t")).cast("timestamp_ntz")).collect()]
    assert stamps == ["None", "2020-01-02 03:04:05", "None", "None"]
    assert [str(r[0]) for r in df.select(fn.parse_date(F.col("t"))).collect()] == ["None", "None", "2020-01-02", "None"]


def test_keys(spark):
    df = spark.createDataFrame([("a", None, "x")], "a string, b string, x string")
    a, b, x = F.col("a"), F.col("b"), F.col("x")
    row = df.select(fn.sha1_key(a, b), fn.md5_key(x), fn.md5_key(b), fn.sha1_key(a, x), fn.sha1_key(a, x, sep="\x1f"))
    first, *_ = found = row.first()
    assert first == "86f7e437faa5a7fce15d1ddcb9eaeaea377667b8"
    assert found[1:3] == ("9dd4e461268c8034f5c8564e155c67a6", None)
    assert found[3] != found[4]


def test_timestamps_do_not_ask_the_session_zone(spark):
    df = spark.createDataFrame([("2024-03-31 01:30:00",), ("2024-10-27 1:5:0",), ("0099-01-01 00:00:00",), ("x",), (None,)], "t string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/London")
    try:
        found = [r[0] for r in df.select(fn.parse_timestamp(F.col("t")).cast("string")).collect()]
        days = [r[0] for r in df.select(fn.parse_date(F.substr("t", F.lit(1), F.lit(10))).cast("string")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert found == ["2024-03-31 01:30:00", "2024-10-27 01:05:00", "0099-01-01 00:00:00", None, None]
    assert days == ["2024-03-31", "2024-10-27", "0099-01-01", None, None]
