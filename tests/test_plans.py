import json

import pytest

from curate import operators as op
from curate import sources as src
from curate.plans import cleaning, mart, star
from curate.plans.rules import check_rules, parse_rules

LOANS = """Reader No,Reader,Shelf,Branch,Remark,Town,County
7,Ann,Old Maps,North,Tornn Page,Ayr,Fife
7,,Novels,North,Tornn Page,,Fife
,Bo,Poems,,Stained,Elgin,
9,Bo,Novels,South,NA,Elgin,Moray
9,Bo,Novels,South,NA,Elgin,Moray
4,Cy,Poems,,fine,,
"""
RULES = {
    "deduplication_rules": {"deduplicate": True},
    "imputation_rules": {
        "reader_no": {"type": "numeric", "method": "MAR", "reference_column": "reader"},
        "reader": {"type": "categorical", "method": "MAR", "reference_column": "reader_no"},
        "branch": {"type": "categorical", "method": "NMAR", "reference_column": None},
        "remark": {"type": "categorical", "method": "NMAR", "fill_value": "No remark"},
        "town": {"type": "categorical", "method": "MAR", "reference_column": "reader_no"},
        "county": {"type": "categorical", "method": "MAR", "reference_column": "reader_no"},
    },
    "replacement_rules": {
        "shelf": {"Old Maps": "maps"},
        "remark": {"tornn page": "torn page", "stained": "spotted", "faded": "pale"},
    },
}


def test_rules():
    rules = parse_rules(RULES)
    assert rules.deduplicate and rules.warnings == ()
    assert [r.column for r in rules.columns][:2] == ["reader_no", "reader"]
    assert {r.column: r.fill_value for r in rules.columns}["remark"] == "No remark"
    assert parse_rules({"imputation_rules": {"a, b": {"type": "numeric"}}}).columns[0].column == "a_b"
    with pytest.raises(ValueError, match="object"):
        parse_rules([])


def test_rule_warnings_and_errors():
    rules = parse_rules(
        {
            "imputation_rules": {"a": {"type": "numeric", "method": "MAR"}, "gone": {"type": "numeric"}},
            "replacement_rules": {"lost": {}},
        }
    )
    assert check_rules(rules, ["a"]) == [
        "rules have no section deduplication_rules",
        "a has no reference column; it is not filled",
        "column gone is not in the table; its rule is skipped",
        "column lost is not in the table; its replacements are skipped",
    ]
    for rule in (
        {"type": "money"},
        {"type": "numeric", "method": "NMAR"},
        {"type": "numeric", "method": "MAR", "reference_column": "nowhere"},
    ):
        with pytest.raises(ValueError):
            check_rules(parse_rules({"imputation_rules": {"a": rule}}), ["a"])


def test_rules_that_share_a_reference_share_a_shuffle(spark):
    rules = parse_rules(RULES)
    assert [[r.column for r in batch] for batch in cleaning._batches(rules.columns)][-1] == ["town", "county"]
    df = spark.createDataFrame([(1, "1", None, None)], "r int, reader_no string, town string, county string")
    two = [r for r in rules.columns if r.column in ("town", "county")]
    plan = cleaning.apply_imputation(df, two, ["r"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_clean_table(spark, tmp_path, rows):
    path = tmp_path / "loans.csv"
    path.write_text(LOANS)
    table = src.read_table(spark, str(path), file_order=True)
    order = src.tables.FILE_ORDER
    clean, audit = cleaning.clean_table(table, RULES, order, "loans", hidden=order)
    assert rows(clean) == [
        (4.0, "Cy", "poems", "Missing", "fine", None, None),
        (7.0, "Ann", "maps", "North", "torn page", "Ayr", "Fife"),
        (7.0, "Ann", "novels", "North", "torn page", "Ayr", "Fife"),
        (9.0, "Bo", "novels", "South", "no remark", "Elgin", "Moray"),
        (9.0, "Bo", "poems", "Missing", "spotted", "Elgin", "Moray"),
    ]
    assert [(r.original_value, r.occurrences) for r in audit.orderBy("original_value").collect()] == [
        ("faded", 0), ("old maps", 1), ("stained", 1), ("tornn page", 2),
    ]


def test_each_fill_reads_the_stored_last_one(spark, tmp_path):
    path = tmp_path / "loans.csv"
    path.write_text(LOANS)
    order = src.tables.FILE_ORDER
    table = src.read_table(spark, str(path), file_order=True)
    clean, _ = cleaning.clean_table(table, RULES, order, "loans", hidden=order)
    plan = clean._jdf.queryExecution().executedPlan().toString()
    # However many fills came before, the last one is all that is left to do.
    assert plan.count("FileScan") == 1 and plan.count("Window") == 1 and "loans.csv" not in plan


def test_clean_table_without_rules(spark, rows):
    df = spark.createDataFrame([(1, " X ")], "a int, b string").toDF("A b", "A-b")
    clean, audit = cleaning.clean_table(df, {})
    assert clean.columns == ["a_b", "ab"] and rows(clean) == [(1, " X ")]
    assert audit.columns == ["table", "column", "action", "original_value", "new_value", "occurrences", "status"]
    assert audit.count() == 0
    with pytest.raises(ValueError, match="order_by"):
        cleaning.clean_table(df, {"imputation_rules": {"ab": {"method": "MAR", "reference_column": "a_b"}}})


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_run_pipeline(spark, tmp_path, rows, fmt):
    (tmp_path / "loans.csv").write_text(LOANS)
    (tmp_path / "plain.csv").write_text("a\nx\n")
    (tmp_path / "rules.json").write_text(json.dumps(RULES, indent=2))
    rules = cleaning.read_rules(spark, str(tmp_path / "rules.json"))
    specs = [
        cleaning.TableSpec("loans", str(tmp_path / "loans.csv"), rules),
        cleaning.TableSpec("plain", str(tmp_path / "plain.csv"), {"replacement_rules": {"a": {"x": "y"}}}, mode="regex"),
        cleaning.TableSpec("absent", str(tmp_path / "absent.csv"), rules),
        cleaning.TableSpec("bad", str(tmp_path / "plain.csv"), [1]),
    ]
    audit, status = cleaning.run_pipeline(spark, specs, str(tmp_path), fmt)
    assert rows(status.select("name", "status")) == [
        ("absent", "failed"), ("bad", "failed"), ("loans", "cleaned"), ("plain", "cleaned"),
    ]
    counts = {r["name"]: (r["n_read"], r["n_dropped"], r["n_written"]) for r in status.collect()}
    assert counts["absent"] == counts["bad"] == (None, None, None) and counts["plain"] == (1, 0, 1)
    read, dropped, written = counts["loans"]
    assert (read, written) == (len(LOANS.strip().splitlines()) - 1, 5) and dropped == read - 5
    assert audit.count() == 5 and audit.where("table = 'plain'").first().new_value == "y"
    assert src.read_table(spark, f"{tmp_path}/CLEAN/loans.{fmt}").count() == 5
    assert src.read_table(spark, f"{tmp_path}/AUDITS/combined_audit.{fmt}").count() == 5


@pytest.fixture(scope="module")
def register(spark):
    data = [
        (1, "Acme", "Bingo", "Leeds", "a", None, "Leeds", "LS1"),
        (1, "Acme", "Casino", "Leeds", "a", None, "Leeds", "LS1"),
        (2, "Beta", "Bingo", "York", "a", None, "Leeds", "LS1"),
        (2, "Beta", "Bingo", "York", "b", "c", "York", "YO1"),
    ]
    columns = ["account_number", "account_name", "premises_activity", "local_authority", *star.ADDRESS]
    return spark.createDataFrame(data, ", ".join(f"{c} {'int' if i == 0 else 'string'}" for i, c in enumerate(columns)))


def test_dimensions(register, rows):
    assert rows(star.dim_accounts(register)) == [(1, "Acme"), (2, "Beta")]
    assert star.dim_premises(register, one_per_key=False).count() == 3
    assert op.duplicate_ids(star.dim_premises(register, one_per_key=False), "premisesid").count() == 1
    premises = star.dim_premises(register)
    assert op.duplicate_ids(premises, "premisesid").count() == 0
    assert rows(premises.select("local_authority", "full_address")) == [("Leeds", "a, Leeds, LS1"), ("York", "b, c, York, YO1")]
    activity = star.dim_activity(register)
    assert activity.columns == ["premises_licenceid", "premisesid", "activity"] and activity.count() == 3
    assert op.fk_orphans(activity, premises, "premisesid", "premisesid").count() == 0
    assert star.dim_account_premises(register).count() == 3


def test_dim_postcodes(spark):
    columns = ", ".join(f"'{i}' AS {c}" for i, c in enumerate(star.POSTCODE_COLUMNS))
    dim = star.dim_postcodes(spark.sql(f"SELECT {columns}, 1 AS other"))
    assert dim.columns == ["postcodeid", *star.POSTCODE_COLUMNS]
    assert dim.first().postcodeid == "cfcd208495d565ef66e7dff9f98764da"


GROUPS = [
    ("Full-time students", "Full-time students"),
    ("Intermediate occupations", "Intermediate occupations"),
    ("Intermediate occupations", "Small employers and own account workers"),
    ("Managerial, administrative and professional occupations",
     "Higher managerial, administrative and professional occupations"),
    ("Managerial, administrative and professional occupations",
     "Lower managerial, administrative and professional occupations"),
    ("Never worked / long-term unemployed", "Never worked / long-term unemployed"),
    ("Routine and manual occupations", "Lower supervisory and technical occupations"),
    ("Routine and manual occupations", "Routine occupations"),
    ("Routine and manual occupations", "Semi-routine occupations"),
]


def test_dim_classes(spark):
    data = [(f"E{c}", f"Place {c}", *pair, 10 * c + i) for c in (1, 2) for i, pair in enumerate(GROUPS)]
    long = spark.createDataFrame(data[:-1], "onsconstid string, constituencyname string, groups string, variables string, con_num int")
    dim = star.dim_classes(long)
    assert dim.columns == ["constituencyid", "constituencyname", *star.CLASS_COLUMNS]
    first, second = dim.orderBy("constituencyid").collect()
    assert tuple(first)[2:] == tuple(range(10, 19)) and second[-1] is None


def test_dim_deprivation(spark):
    columns = ", ".join(f"1.0 AS {c}" for c in star.DEPRIVATION_COLUMNS)
    dim = star.dim_deprivation(spark.sql(f"SELECT 'E1' AS onsconstid, 'x' AS constituencyname, 9 AS regionid, {columns}"))
    assert dim.columns == ["constituencyid", "constituencyname", *star.DEPRIVATION_COLUMNS]


def test_star_join_keeps_all_facts(spark, rows):
    fact = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, k string")
    dim = spark.createDataFrame([("a", 10)], "k string, v int")
    assert rows(star.star_join(fact, [(dim, "k")]).select("id", "v")) == [(1, 10), (2, None), (3, None)]
    with pytest.raises(ValueError, match="both sides"):
        star.star_join(fact, [(dim.withColumnRenamed("v", "id"), "k")])


def test_mart(spark, rows):
    premises = spark.createDataFrame([("N", 1), ("N", 2), ("S", 3), ("W", 4)], "area string, id int")
    licences = spark.createDataFrame([(1,), (1,), (2,), (3,)], "id int")
    accounts = spark.createDataFrame([(1,), (1,), (1,)], "id int")
    dim = spark.createDataFrame([("N", 2.0), ("S", 1.0), ("W", 0.0)], "area string, income double")
    out = mart.mart_by_area(premises, "area", "id", {"licences": licences, "accounts": accounts}, [dim])
    assert out.columns == ["area", "n_premises", "n_licences", "n_accounts", "income"]
    assert rows(out) == [("N", 2, 3, 3, 2.0), ("S", 1, 1, 0, 1.0), ("W", 1, 0, 0, 0.0)]
    corr = mart.mart_correlation(out, ["n_licences", "n_accounts"], ["income"])
    found = {r.a: r.corr for r in corr.collect()}
    assert found.keys() == {"n_licences", "n_accounts"}
    assert found["n_licences"] == pytest.approx(0.9819805)
    ranked = mart.mart_correlation(out, ["n_licences"], ["income"], "spearman").first().corr
    assert ranked == pytest.approx(1.0)
