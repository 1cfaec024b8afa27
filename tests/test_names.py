"""Users' columns survive, whatever names operators use while they work."""

import pytest
from pyspark.sql import functions as F

from curate import operators as op
from curate import sources as src
from curate.operators.joins import left_lookup
from curate.operators.standardize import _replace_exact


def test_replace_keeps_columns_named_like_its_own(spark):
    df = spark.createDataFrame([("a", 1, 2, 3)], "name string, v int, _old_price int, _new_0 int")
    many = [("a", "b")] + [(f"x{i}", f"y{i}") for i in range(2_000)]
    for rules in ([("a", "b")], many):
        out = _replace_exact(df, {"name": rules})
        assert out.columns == df.columns and out.first() == ("b", 1, 2, 3)


def test_where_in_is_the_same_at_any_length(spark):
    df = spark.createDataFrame([("p", 1.0), ("q", 5.5), ("r", None)], "name string, v double")
    for n in (2, 1_500):
        out = op.where_in(df, "v", list(range(n)))
        assert out.columns == ["name", "v"] and [r["name"] for r in out.where("v < 2").collect()] == ["p"]
    assert op.where_in(df, "v", []).count() == 0
    assert [r["name"] for r in op.where_in(df, "v", [1, 5.5, None]).orderBy("name").collect()] == ["p", "q"]


def test_keep_one_and_lookup_keep_columns(spark):
    df = spark.createDataFrame([(1, 2, 7, 8, 9)], "k int, o int, _rank int, _key int, _spread int")
    assert op.keep_one(df, ["k"], ["o"]).first() == (1, 2, 7, 8, 9)
    table = spark.createDataFrame([(1, "x")], "at int, word string")
    assert left_lookup(df, table, F.col("k"), "at").first() == (1, 2, 7, 8, 9, "x")


def test_fill_by_group_keeps_columns_and_cuts_every_large_group(spark):
    rows = [(g, i, None if i % 3 else g * 100 + i, 70 + i, "c") for g in range(30) for i in range(40)]
    df = spark.createDataFrame(rows, "g int, i int, v int, _block int, _cut string")
    whole = op.impute_group(df, "v", "g", ["i"])
    cut = op.impute_group(df, "v", "g", ["i"], rows_per_block=10)
    assert cut.columns == df.columns
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))
    assert {r["_block"] for r in cut.collect()} == {70 + i for i in range(40)}


def test_pivot_names_must_differ(spark):
    df = spark.createDataFrame([(1, "a-b", 1), (1, "a b", 2)], "i int, k string, v int")
    with pytest.raises(ValueError, match="share a column name"):
        op.pivot_wide(df, ["i"], "k", "v")


def test_datasets_of_one_stem_land_apart(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,2\n")
    (tmp_path / "t.json").write_text('{"a": 3}\n')
    out = src.land_datasets(spark, str(tmp_path), str(tmp_path / "zone")).collect()
    assert sorted(r[0] for r in out) == ["t_csv", "t_json"] and all(r[2] == "landed" for r in out)


def test_history_rejects_repeated_keys_and_joins_null_keys(spark):
    history = spark.sql("SELECT CAST(NULL AS INT) k, 'a' v, DATE'2020-01-01' valid_from, CAST(NULL AS DATE) valid_to, true is_current")
    as_of = F.lit("2021-01-01").cast("date")
    same = spark.createDataFrame([(None, "a")], "k int, v string")
    assert op.scd2_merge(history, same, ["k"], ["v"], as_of).count() == 1
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="more than one row"):
        op.scd2_merge(history, twice, ["k"], ["v"], as_of).collect()


def test_small_operators_keep_columns_named_like_their_own(spark):
    df = spark.createDataFrame([(1, None, 5, 7, "x")], "k int, v string, _value int, _lookup_key int, _parent string")
    lookup = spark.createDataFrame([(1, "found")], "key int, value string")
    assert op.impute_lookup(df, "v", "k", lookup).first() == (1, "found", 5, 7, "x")
    children = spark.createDataFrame([(1,), (2,), (None,)], "_parent int")
    parents = spark.createDataFrame([(1,)], "_parent int")
    assert [tuple(r) for r in op.fk_orphans(children, parents, "_parent", "_parent").collect()] == [(2,)]
    totals = spark.createDataFrame([(1, 5), (1, 2), (2, 9)], "_total int, v int")
    assert [tuple(r) for r in op.least_per_group(totals, "_total", "v").collect()] == [(2, 9), (1, 2)]
    response = spark.createDataFrame([('{"places": [{"id": "p"}]}', 3, 4)], "json string, _place int, `a.b` int")
    row = op.flatten_responses(response, "json", F.lit(None).cast("timestamp")).first()
    assert (row["_place"], row["a.b"], row["g_place_id"]) == (3, 4, "p")


def test_nan_is_missing_in_counts_and_checks(spark):
    nan = float("nan")
    df = spark.createDataFrame([(nan, 1.0), (nan, nan), (1.0, 2.0), (1.0, 2.0), (None, 3.0)], "a double, b double")
    assert [tuple(r) for r in op.value_counts(df, "a").collect()] == [(1.0, 2)]
    assert [tuple(r) for r in op.duplicate_ids(df, "a").collect()] == [(1.0, 2)]
    assert tuple(op.functional_dependency(df, "a", "b").first()) == ("a", "b", 1, 1, True, True)
    assert op.cardinality(df, "a", "b").first()["cardinality"] == "1:1"
    assert tuple(op.count_exceeds(df, "b", [2.0]).first()) == (2, 4, True)
    assert op.fk_orphans(df, df.where("a < 0"), "a", "a").count() == 1


def test_landed_datasets_never_share_a_target(spark, tmp_path):
    for name, text in (("a.csv", "x\n1\n"), ("a.json", '{"x": 2}\n'), ("a_csv.csv", "x\n3\n"), ("b.csv", "x\n4\n")):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    out = src.land_datasets(spark, str(tmp_path / "in"), str(tmp_path / "base")).collect()
    names = [r["name"] for r in out]
    assert len(set(names)) == 4 and all(r["status"] == "landed" for r in out)
    values = sorted(str(spark.read.parquet(f"{tmp_path}/base/RAW/{n}.parquet").first()[0]) for n in names)
    assert values == ["1", "2", "3", "4"]
