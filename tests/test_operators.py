import random

import pytest
from pyspark.sql import functions as F

from curate import operators as op
from curate.operators.blocks import with_bounds_passed


def test_headers(spark):
    names = ["_TABLE_55helloworld", ",,, 93helloworld", "helloworld", "helloworld", ""]
    df = spark.createDataFrame([(1,) * 5], "a int, b int, c int, d int, e int").toDF(*names)
    expected = ["default55helloworld", "_93helloworld", "helloworld", "helloworld_1", "column_"]
    assert op.standardize_headers(df).columns == expected
    assert op.distinct_headers(["a", "a", "a_1"]) == ["a", "a_1", "a_1_1"]


def test_other_headers(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int").toDF("In Use?", "Never worked / long-term, x")
    assert op.simple_headers(df).columns == ["in_use?", "never_worked_/_long-term,_x"]
    assert op.pivot_headers(df).columns == ["in_use?", "never_worked___long_term__x"]
    assert op.rename(df, {"In Use?": "in_use", "none": "x"}).columns == ["in_use", "Never worked / long-term, x"]
    assert op.project(df, {"In Use?": "u"}).columns == ["u"]
    with pytest.raises(ValueError, match="nothing"):
        op.project(df, {"nothing": "x"})


def test_apply_schema(spark):
    df = spark.createDataFrame([("1.5", 2, "2020-01-02", "x"), ("?", None, "02/03/2021", "y")], "n string, i int, d string, o string")
    out = op.apply_schema(df, {"n": "float", "i": "string"}, ["d", "absent"])
    assert dict(out.dtypes) == {"n": "double", "i": "string", "d": "timestamp_ntz", "o": "string"}
    found = out.withColumn("d", F.col("d").cast("string")).collect()
    assert [tuple(r) for r in found] == [(1.5, "2", "2020-01-02 00:00:00", "x"), (None, None, "2021-03-02 00:00:00", "y")]
    with pytest.raises(ValueError, match="absent"):
        op.apply_schema(df, {"absent": "float"})
    with pytest.raises(ValueError, match="unknown type"):
        op.apply_schema(df, {"n": "money"})


def test_coerce_types_leaves_set_types(spark):
    df = spark.createDataFrame([(1, "7", 2.5)], "i int, t string, f float").withColumn("d", F.current_date())
    out = op.coerce_types(df, {"i": "numeric", "t": "numeric", "f": "categorical", "d": "date"})
    assert dict(out.dtypes) == {"i": "int", "t": "double", "f": "string", "d": "date"}


def test_filters(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "n int, t string")
    assert rows(op.where_null(df, "t")) == [(2, None)]
    assert rows(op.where_in(df, "t", ["a", "z"])) == [(1, "a")]
    assert rows(op.where_in(df, "n", range(3, 5000))) == [(3, "c")]
    assert [r.n for r in op.top_n(df, "t", 2, ["n"]).collect()] == [3, 1]


def test_deduplicate(spark, rows):
    df = spark.createDataFrame([(1, None, 5), (1, None, 3), (2, "b", 4)], "n int, t string, at int")
    assert rows(op.deduplicate(df, order_by=["at"])) == [(1, None, 3), (2, "b", 4)]
    assert rows(op.deduplicate(df.drop("at"))) == [(1, None), (2, "b")]
    assert rows(op.dedup_report(df.drop("at"))) == [(3, 2, 1)]
    assert rows(op.dedup_report(df.where("n > 9"))) == [(0, 0, 0)]


def test_keep_one(spark, rows):
    df = spark.createDataFrame([("k", 2), ("k", None), ("k", 1), ("l", None)], "k string, v int")
    assert rows(op.keep_one(df, ["k"], ["v"])) == [("k", 1), ("l", None)]
    with pytest.raises(ValueError):
        op.keep_one(df, ["k"], [])
    assert "WindowGroupLimit" in op.keep_one(df, ["k"], ["v"])._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", [0, 1, 2, 3, 7, 64])
def test_bounds_passed(spark, size):
    bounds = [float(i // 2) for i in range(size)]
    df = spark.range(-2, 40).select((F.col("id") / 2).alias("v"), F.array(*map(F.lit, bounds)).cast("array<double>").alias("b"))
    for row in with_bounds_passed(df, F.col("b"), F.col("v"), size, "k").collect():
        assert row.k == sum(b <= row.v for b in bounds)
    unbounded = df.withColumn("b", F.lit(None).cast("array<double>"))
    assert with_bounds_passed(unbounded, F.col("b"), F.col("v"), 5, "k").where("k <> 0").count() == 0


GAPS = [(1, "a", None), (2, None, 5), (3, "a", 2), (4, "b", None), (5, "b", 3)]


def test_impute_group(spark, rows):
    df = spark.createDataFrame(GAPS, "r int, k string, v int")
    assert rows(op.impute_group(df, "v", "k", ["r"])) == [(1, "a", 2), (2, None, 5), (3, "a", 2), (4, "b", 3), (5, "b", 3)]
    wiped = rows(op.impute_group(df, "v", "k", ["r"], null_reference="wipe"))
    assert wiped == [(1, "a", 2), (2, None, None), (3, "a", 2), (4, "b", 3), (5, "b", 3)]
    for wrong in ({"order_by": []}, {"order_by": ["r"], "null_reference": "?"}):
        with pytest.raises(ValueError):
            op.impute_group(df, "v", "k", **wrong)


def _filled(data, keep=True):
    """Forward then backward fill by brute force; data is (order, key, a, b)."""
    out = {}
    for at in (2, 3):
        for key in {r[1] for r in data}:
            group = sorted(r for r in data if r[1] == key)
            known = [r[at] for r in group if r[at] is not None]
            last = known[0] if known else None
            for r in group:
                last = r[at] if r[at] is not None else last
                out[r[0], at] = (r[at] if keep else None) if key is None else last
    return sorted((r[0], r[1], out[r[0], 2], out[r[0], 3]) for r in data)


@pytest.mark.parametrize("seed", [1, 2])
def test_impute_group_cuts_large_groups(spark, seed, monkeypatch):
    monkeypatch.setattr("curate.operators.impute.SAMPLES_PER_BLOCK", 20)
    rng = random.Random(seed)
    keys = ["hot"] * 6 + ["warm"] * 3 + ["x", "y", None, "bare"]
    data = []
    for i in range(3000):
        key = rng.choice(keys)
        sparse = 0.97 if 500 < i < 2500 else 0.6
        a = None if key == "bare" or rng.random() < sparse else rng.randrange(100)
        b = f"b{i}" if key == "hot" and i > 2900 else None
        data.append((i, key, a, b))
    shuffled = data[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "r int, k string, a int, b string").repartition(6)
    df = df.withColumn("r2", F.col("r") % 10).withColumn("r1", F.floor(F.col("r") / 10))
    out = op.impute_group(df, ["a", "b"], "k", ["r1", "r2"], rows_per_block=200)
    assert "_carry_0" in out._jdf.queryExecution().optimizedPlan().toString()
    key = lambda r: r[0]
    found = sorted((tuple(r) for r in out.select("r", "k", "a", "b").collect()), key=key)
    assert found == sorted(_filled(data), key=key)


def test_impute_group_needs_no_join_without_large_groups(spark):
    df = spark.createDataFrame(GAPS, "r int, k string, v int")
    plan = op.impute_group(df, "v", "k", ["r"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1 and plan.count("Window [") == 1


def test_impute_constant(spark, rows):
    df = spark.createDataFrame([(None, 1), ("x", None)], "t string, n int")
    assert rows(op.impute_constant(df, ["t"])) == [("Missing", 1), ("x", None)]
    assert rows(op.impute_constant(df, {"t": "?"})) == [("?", 1), ("x", None)]
    with pytest.raises(ValueError, match="not text"):
        op.impute_constant(df, ["n"])


def test_impute_lookup(spark, rows):
    df = spark.createDataFrame([("p1", None), ("p2", None), (None, None), ("p1", "kept")], "p string, la string")
    lookup = spark.createDataFrame([("p1", "council")], "key string, value string")
    assert rows(op.impute_lookup(df, "la", "p", lookup)) == [
        ("p1", "council"),
        ("p1", "kept"),
        ("p2", None),
        (None, None),
    ]


def test_replace_exact_and_regex(spark, rows):
    df = spark.createDataFrame([("Oak ",), ("cloak",), ("oak st giles",), (None,)], "city string")
    rules = {"City": {"Oak": "Oak St. Giles"}, "absent": {"a": "b"}}
    exact = ["cloak", "oak st giles", "oak st. giles", None]
    assert [r[0] for r in rows(op.replace_values(df, rules))] == exact
    regex = ["cloak st. giles", "oak st. giles", "oak st. giles st giles", None]
    assert [r[0] for r in rows(op.replace_values(df, rules, "regex"))] == regex
    with pytest.raises(ValueError):
        op.replace_values(df, rules, "glob")


@pytest.mark.parametrize(
    "mode, values, rules, expected",
    [
        ("exact", ["x (hyde)"], {"x (hyde)": "z"}, ["z"]),
        ("regex", ["x (hyde)"], {"x (hyde)": "z"}, ["x (hyde)"]),
        ("exact", ["lamp", "lamps"], {"lamp": "lamps"}, ["lamps", "lamps"]),
        ("regex", ["lamp", "lamps"], {"lamp": "lamps"}, ["lamps", "lampss"]),
        ("regex", ["cost"], {"cost": r"$1\x"}, [r"$1\x"]),
        ("regex", ["ab", "abc"], {"q": "r", "ab": "q"}, ["q", "qc"]),
        ("exact", ["a"], {"a": "b", "b": "a"}, ["a"]),
    ],
)
def test_replacement_cases(spark, rows, mode, values, rules, expected):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    assert [r[0] for r in rows(op.replace_values(df, {"t": rules}, mode))] == expected


def _replay(values, rules, mode):
    """Rules one by one on all values, as counts and values."""
    import re

    counts = []
    for old, new in rules.items():
        counts.append(sum(v == old for v in values))
        if mode == "exact":
            values = [new if v == old else v for v in values]
        elif counts[-1]:
            values = [re.sub(old, new, v) for v in values]
    return counts, sorted(values)


@pytest.mark.parametrize("mode", ["exact", "regex"])
@pytest.mark.parametrize("seed", range(4))
def test_rules_replayed(spark, rows, mode, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("ab", k=rng.randrange(1, 4))) for _ in range(14)]
    values = rng.choices(words, k=60)
    rules = {old: rng.choice(words) for old in dict.fromkeys(words)}
    df = spark.createDataFrame([(v,) for v in values], "t string")
    out, audit = op.replace_with_audit(df, {"t": rules}, "tab", mode)
    counts, expected = _replay(values, rules, mode)
    assert [r[0] for r in rows(out)] == expected
    found = {r.original_value: (r.occurrences, r.status) for r in audit.collect()}
    assert found == {old: (n, "Replaced" if n else "Not Replaced") for old, n in zip(rules, counts)}


def test_many_rules_use_a_join(spark, rows):
    rules = {f"v{i}": f"v{i + 1}" for i in range(0, 600, 2)}
    df = spark.createDataFrame([("v0",), ("v598",), ("other",)], "t string")
    assert [r[0] for r in rows(op.replace_values(df, {"t": rules}))] == ["other", "v1", "v599"]


def test_audit_rows(spark, rows):
    df = spark.createDataFrame([("A ",), ("a",), ("b",)], "t string")
    audit = op.replacement_audit(df, {"T": {"a": "b", "B": "c", "q": "r"}}, "tab")
    assert audit.columns == ["table", "column", "action", "original_value", "new_value", "occurrences", "status"]
    assert rows(audit) == [
        ("tab", "t", "string_replacement", "a", "b", 2, "Replaced"),
        ("tab", "t", "string_replacement", "b", "c", 3, "Replaced"),
        ("tab", "t", "string_replacement", "q", "r", 0, "Not Replaced"),
    ]
    both = op.combine_audits([audit, audit.drop("status")])
    assert both.count() == 6 and both.where("status IS NULL").count() == 3


def test_quality(spark, rows):
    df = spark.createDataFrame([(1, "a", 5.0), (1, "a", None), (2, "b", 1.0), (None, "b", 2.0)], "k int, t string, v double")
    assert rows(op.null_counts(df)) == [("k", 1), ("t", 0), ("v", 1)]
    assert [tuple(r) for r in op.value_counts(df, "k").collect()] == [(1, 2), (2, 1)]
    assert rows(op.duplicate_ids(df, "k")) == [(1, 2)]
    assert [r.k for r in op.least_per_group(df, "k", "v").collect()] == [1, None, 2]
    assert rows(op.count_exceeds(df, "k", [1])) == [(2, 5, True)]
    assert rows(op.cardinality(df, "k", "t")) == [("k", "t", "1:1")]
    parents = spark.createDataFrame([(1,)], "id int")
    assert rows(op.fk_orphans(df, parents, "k", "id")) == [(2,)]


@pytest.mark.parametrize(
    "pairs, label",
    [([(1, 1), (2, 2)], "1:1"), ([(1, 1), (1, 2)], "1:N"), ([(1, 1), (2, 1)], "N:1"), ([(1, 1), (1, 2), (2, 1)], "N:M")],
)
def test_cardinality(spark, pairs, label):
    assert op.cardinality(spark.createDataFrame(pairs, "a int, b int"), "a", "b").first().cardinality == label


def test_pivot(spark, rows):
    df = spark.createDataFrame([(1, "x y", 1), (1, "z", 2), (2, "x y", 3)], "i int, a string, v int")
    for attributes in (None, ["x y", "z"]):
        wide = op.pivot_wide(df, ["i"], "a", "v", attributes)
        assert wide.columns == ["i", "x_y", "z"] and rows(wide) == [(1, 1, 2), (2, 3, None)]
    twice = df.unionAll(df.where("i = 2").withColumn("v", F.lit(9)))
    with pytest.raises(Exception, match="more than one row"):
        op.pivot_wide(twice, ["i"], "a", "v", ["x y", "z"]).collect()
    assert rows(op.pivot_wide(twice, ["i"], "a", "v", ["x y", "z"], "first")) == [(1, 1, 2), (2, 3, None)]


def test_scd2(spark, rows):
    def stamp(day):
        return F.lit(f"2024-01-0{day}").cast("timestamp")

    history = op.scd2_open(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "k int, t string"), stamp(1))
    snapshot = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d"), (5, "e")], "k int, t string")
    once = op.scd2_merge(history, snapshot, ["k"], ["t"], stamp(2))

    def shown(df):
        days = df.select("k", "t", F.dayofmonth("valid_from"), F.dayofmonth("valid_to"), "is_current")
        return rows(days)

    assert shown(once) == [
        (1, "a", 1, None, True),
        (2, "B", 2, None, True),
        (2, "b", 1, 2, False),
        (3, "c", 1, None, True),
        (4, "d", 2, None, True),
        (4, None, 1, 2, False),
        (5, "e", 2, None, True),
    ]
    again = op.scd2_merge(once, snapshot, ["k"], ["t"], stamp(3))
    assert shown(again) == shown(once)
    closed = op.scd2_merge(once, snapshot, ["k"], ["t"], stamp(3), close_missing=True)
    assert (3, "c", 1, 3, False) in shown(closed) and len(shown(closed)) == 7


def test_responses(spark, rows):
    texts = [
        '{"places":[{"id":"p1","formattedAddress":"x"},{"id":"p2"}]}', '{"places":[]}', "{}", "broken{",
        '{"places":[{}]}', None,
    ]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "premisesid string, r string")
    out = op.flatten_responses(df, "r", F.lit("2025-01-01").cast("timestamp"))
    assert out.columns == ["premisesid", "g_place_id", "g_formatted_address_1", "g_business_status_1", "api_call_date"]
    assert rows(out.drop("api_call_date")) == [("0", "p1", "x", "Missing"), ("4", "Missing", "Missing", "Missing")]
    assert rows(op.response_counts(df, "r")) == [(2, 2, 2)]
    asked = spark.createDataFrame([("0",), ("1",), ("1",), ("7",)], "premisesid string")
    assert rows(op.pending_enrichment(asked, out, ["premisesid"])) == [("1",), ("7",)]


def test_left_lookup_spreads_rows_without_a_key(spark, rows):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "z")], "id int, k string")
    table = spark.createDataFrame([("a", 7), (None, 8)], "k string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = op.left_lookup(df, table, F.col("k"), "k")
        assert "hashpartitioning(_key" in out._jdf.queryExecution().executedPlan().toString()
        assert "_spread" in out._jdf.queryExecution().executedPlan().toString().split("hashpartitioning(_key")[1][:30]
        assert rows(out) == [(1, None, None), (2, None, None), (3, "a", 7), (4, "z", None)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
