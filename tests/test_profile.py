import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curate import operators as op
from curate.operators import profiling


def _numbers(seed, n=4000):
    """Two related columns with gaps and with one value in a third of all rows."""
    rng = random.Random(seed)
    data = []
    for i in range(n):
        a = 0.0 if rng.random() < 0.35 else rng.choice([rng.gauss(0, 10), float(rng.randrange(50))])
        b = None if rng.random() < 0.1 else a * rng.random() + rng.gauss(0, 3)
        data.append((i, None if rng.random() < 0.05 else a, b))
    return data


@pytest.fixture(scope="module", params=[10**9, 150], ids=["one block", "many blocks"])
def block(request):
    return request.param


@pytest.mark.parametrize("grain, most", [(1024, 2_000_000), (1, 2_000_000), (1, 20)])
def test_describe(spark, grain, most, monkeypatch):
    monkeypatch.setattr("curate.operators.profiling.BUCKETS_PER_E", grain)
    monkeypatch.setattr("curate.operators.profiling.MOST_IN_BUCKET", most)
    monkeypatch.setattr("curate.operators.profiling.PARTS_OF_BUCKET", 7)
    data = _numbers(3)
    df = spark.createDataFrame(data, "i long, a double, b double").repartition(5)
    found = op.describe(df, ["a", "b"]).toPandas().set_index("column")
    expected = pd.DataFrame(data, columns=["i", "a", "b"])[["a", "b"]].astype(float).describe().T
    expected.columns = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    for name in expected.columns:
        assert np.allclose(found.loc[["a", "b"], name].astype(float), expected[name]), name


def test_describe_small_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, None), (4, float("nan"))], "n int, v double")
    found = {r.column: r for r in op.describe(df).collect()}
    n, v = found["n"], found["v"]
    assert (n["count"], n["mean"], n.q25, n.q50, n.q75) == (4, 2.5, 1.75, 2.5, 3.25)
    assert math.isclose(n.std, 1.2909944487, rel_tol=1e-9)
    assert (v["count"], v["mean"], v.q50) == (0, None, None)


def test_describe_approximate(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    row = op.describe(df, approximate=True).first()
    assert (row["count"], row.q25, row.q50, row["max"]) == (1001, 250.0, 500.0, 1000.0)


def test_value_ranks(spark, block):
    data = [(g, float(v)) for g, values in {"p": [3, 1, 1, 2, 1] * 200, "q": list(range(900))}.items() for v in values]
    long = spark.createDataFrame(data, "group string, value double").repartition(4)
    for row in op.value_ranks(long, block).collect():
        group = [v for g, v in data if g == row.group]
        assert (row.n, row.below, row.total) == (
            group.count(row.value), sum(v < row.value for v in group), len(group)
        )


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlations(spark, block, method):
    data = [(*row, -row[0] if row[0] % 3 else None) for row in _numbers(5, 2000)]
    df = spark.createDataFrame(data, "i long, a double, b double, c long").repartition(5)
    found = {(r.a, r.b): r.corr for r in op.correlations(df, ["a", "b", "c"], method, block).collect()}
    expected = pd.DataFrame(data, columns=["i", "a", "b", "c"]).astype(float)[["a", "b", "c"]].corr(method)
    assert found.keys() == {("a", "b"), ("a", "c"), ("b", "c")}
    for (a, b), value in found.items():
        assert math.isclose(value, expected.loc[a, b], rel_tol=1e-9)


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    for method in ("pearson", "spearman"):
        assert op.correlations(df, method=method).first().corr is None
    with pytest.raises(ValueError):
        op.correlations(df, ["a"])
    with pytest.raises(ValueError):
        op.correlations(df, method="kendall")


PROFILED = [("x", 1, "2024-01-01 00:00:00", "7"), ("yy", 0, None, "?"), (None, 0, None, "7"), ("x", None, None, None)]


@pytest.mark.parametrize("approximate", [False, True])
def test_profile(spark, approximate):
    df = spark.createDataFrame(PROFILED, "t string, n int, d string, m string")
    out = op.profile(df, {"d": "datetime", "m": "numeric"}, approximate)
    found = {r.column: r.asDict() for r in out.collect()}
    t, n, d, m = (found[c] for c in "tndm")
    assert (t["kind"], t["n"], t["missing"], t["missing_pct"], t["distinct"]) == ("categorical", 4, 1, 25.0, 2)
    assert (t["is_unique"], t["is_constant"], t["min_length"], t["max_length"]) == (False, False, 1, 2)
    assert (t["top"], t["top_count"]) == ("x", 2)
    assert (n["kind"], n["zeros"], n["min"], n["max"], n["distinct"], n["top"]) == ("numeric", 2, 0.0, 1.0, 2, None)
    assert (d["kind"], d["missing"], d["is_constant"], d["is_unique"]) == ("datetime", 3, True, True)
    assert (m["kind"], m["missing"], m["is_constant"], m["is_unique"], m["mean"]) == ("numeric", 2, True, False, 7.0)


def test_profile_of_numbers_only_and_of_nothing(spark):
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    assert [r.top for r in op.profile(df).collect()] == [None, None]
    assert [(r.n, r.distinct, r.missing_pct) for r in op.profile(df.where("a > 5")).collect()] == [(0, 0, None)] * 2
    with pytest.raises(ValueError):
        op.profile(df, {"a": "colour"})


def test_profile_subset(spark):
    df = spark.createDataFrame([(None, 14), (None, 14), ("here", 3)], "constituency string, population int")
    out = {r.column: r for r in op.profile_subset(df, F.col("constituency").isNull()).collect()}
    assert out["population"].is_constant and out["population"].n == 2 and out["constituency"].missing == 2


def test_one_meaning_of_missing(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 0.0), (4, -0.0)], "g int, v double")
    assert {r.column: r.n_null for r in op.null_counts(df).collect()} == {"g": 0, "v": 2}
    assert op.where_null(df, "v").count() == 2
    row = {r.column: r for r in op.profile(df).collect()}["v"]
    assert (row.missing, row.distinct, row.is_constant) == (2, 1, True)
    filled = op.impute_group(df.selectExpr("1 AS one", "g", "v"), "v", "one", ["g"])
    assert [r.v for r in filled.orderBy("g").collect()] == [0.0, 0.0, 0.0, 0.0]


def test_profile_of_dates_and_long_ids(spark):
    df = spark.sql("SELECT * FROM VALUES (9007199254740992, DATE'2024-01-02'), (9007199254740993, DATE'2023-05-06') t(n, d)")
    n, d = op.profile(df).collect()
    assert (n.distinct, n.is_unique) == (2, True)
    assert (str(d.earliest), str(d.latest), d.distinct) == ("2023-05-06 00:00:00", "2024-01-02 00:00:00", 2)


def test_buckets_rise_with_the_values(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.standard_normal(300) * 10.0 ** rng.integers(-300, 300, 300), [0.0, -0.0, 5e-324, -5e-324, 1.0, -1.0, 1.7e308, -1.7e308]])
    values = np.concatenate([values, values[:50], [float("inf"), float("-inf")]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    held = profiling._buckets(df, ["v"]).orderBy("bucket").collect()
    assert sum(r["n"] for r in held) == len(values)
    assert all(a["high"] < b["low"] for a, b in zip(held, held[1:]))
    finite = df.where("abs(v) < 1e307")
    found = op.quartiles(finite, ["v"]).first()
    assert np.allclose(tuple(found)[1:], np.percentile(values[abs(values) < 1e307], [25, 50, 75]))


def test_describe_reads_the_table_twice_and_thrice_for_large_buckets(spark, tmp_path, monkeypatch):
    spark.range(5000).selectExpr("sqrt(id) AS a", "id % 7 * 1.5 AS b", "-id AS c").write.parquet(f"{tmp_path}/t")
    real, readings = profiling._long, []
    monkeypatch.setattr("curate.operators.profiling._long", lambda df, columns: readings.append(len(columns)) or real(df, columns))
    df = spark.read.parquet(f"{tmp_path}/t")
    op.describe(df).collect()
    assert len(readings) == 2
    readings.clear()
    monkeypatch.setattr("curate.operators.profiling.BUCKETS_PER_E", 1)
    monkeypatch.setattr("curate.operators.profiling.MOST_IN_BUCKET", 100)
    monkeypatch.setattr("curate.operators.profiling.PARTS_OF_BUCKET", 7)
    op.describe(df).collect()
    assert len(readings) == 3


def test_rank_correlations_with_unlike_gaps(spark, tmp_path, block):
    rng = np.random.default_rng(5)
    data = {c: [None if rng.random() < share else float(rng.integers(0, top)) for _ in range(400)] for c, share, top in (("a", 0.3, 9), ("b", 0.1, 50), ("c", 0.5, 400), ("d", 0.0, 4))}
    data["e"] = [None if v is None else -v * v for v in data["b"]]
    rows = list(zip(*data.values()))
    spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(4).write.parquet(f"{tmp_path}/gaps")
    out = op.correlations(spark.read.parquet(f"{tmp_path}/gaps"), list(data), "spearman", block)
    # One reading for all pairs, gaps or not.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [a#") == 1
    expected = pd.DataFrame(data).astype(float).corr("spearman")
    found = {(r["a"], r["b"]): r["corr"] for r in out.collect()}
    assert len(found) == 10
    for (a, b), value in found.items():
        assert math.isclose(value, expected.loc[a, b], abs_tol=1e-9), (a, b)


def test_rank_correlations_read_the_table_once_for_all_pairs(spark, tmp_path):
    spark.range(200).selectExpr("id % 7 AS a", "id % 5 AS b", "-id AS c", "id * id % 11 AS d", "id AS e").write.parquet(f"{tmp_path}/wide")
    df = spark.read.parquet(f"{tmp_path}/wide")
    for columns in (["a", "b", "c"], ["a", "b", "c", "d", "e"]):
        plan = op.correlations(df, columns, "spearman")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [a#") == 1 and plan.count("Join") == len(columns) * 2


def test_sketches_of_two_days_are_that_of_both(spark, rows):
    rng = np.random.default_rng(4)
    names = [f"n{int(i)}" if i < 3000 else None for i in rng.zipf(1.3, 6000).clip(max=4000)]
    data = [(n, float(v) if v % 5 else None, i % 2) for i, (n, v) in enumerate(zip(names, rng.integers(-9, 900, 6000)))]
    df = spark.createDataFrame(data, "name string, v double, day int").repartition(3)
    one = op.profile_of(op.sketch(df.drop("day")))
    days = [op.sketch(df.where(f"day = {d}").drop("day")) for d in (0, 1)]
    both = op.profile_of(op.merge_sketches(*days, op.sketch(df.where("day > 5").drop("day"))))
    exact = {r["column"]: r for r in op.profile(df.drop("day")).collect()}
    assert both.columns == one.columns == [*op.profile(df).columns, "top_error"]
    for out in (one, both):
        found = {r["column"]: r for r in out.collect()}
        for column, r in found.items():
            e = exact[column]
            for c in ("kind", "n", "missing", "min", "max", "zeros", "min_length", "max_length", "top"):
                assert r[c] == e[c], (column, c)
            for c in ("mean", "std"):
                assert r[c] == e[c] or math.isclose(r[c], e[c], rel_tol=1e-9)
            assert abs(r["distinct"] - e["distinct"]) <= 0.05 * e["distinct"]
        assert abs(found["name"]["top_count"] - exact["name"]["top_count"]) <= found["name"]["top_error"] < 10
        assert found["v"]["top"] is None
