import json

import pytest
from pyspark.sql import functions as F

from curate import sources as src
from curate.operators import standardize_headers
from curate.sources.tables import FILE_ORDER


def test_csv_headers_and_missing_values(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,a,,"b ""c"", d"\n1,NA, x ,"say ""hi"", you"\n,null,nan,2\n', encoding="utf-8")
    df = src.read_table(spark, str(path))
    assert df.columns == ["a", "a", "", 'b "c", d']
    assert [tuple(r) for r in df.collect()] == [("1", None, " x ", 'say "hi", you'), (None, None, None, "2")]
    assert standardize_headers(df).columns == ["a", "a_1", "column_", "b_c_d"]
    kept = src.read_table(spark, str(path), na_texts=["1"])
    assert kept.collect()[0][:2] == (None, "NA")


def test_csv_roundtrip(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, 'x, "y"', None), (2, " z ", "ü")], "id int, t string, u string")
    path = src.write_table(df, str(tmp_path), "CLEAN", "t", "csv")
    assert path == f"{tmp_path}/CLEAN/t.csv"
    assert rows(src.read_table(spark, path)) == [("1", 'x, "y"', None), ("2", " z ", "ü")]


def test_multi_line_field(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n"one\ntwo",3\n', encoding="utf-8")
    assert [tuple(r) for r in src.read_table(spark, str(path), multi_line=True).collect()] == [("one\ntwo", "3")]


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_typed_formats(spark, tmp_path, fmt, rows):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id long, t string")
    assert rows(src.read_table(spark, src.write_table(df, str(tmp_path), "RAW", "t", fmt))) == rows(df)


def test_unknown_format(spark, tmp_path):
    with pytest.raises(ValueError, match="suffix"):
        src.read_table(spark, f"{tmp_path}/t.xlsx")
    with pytest.raises(ValueError, match="format"):
        src.write_table(spark.range(1), str(tmp_path), "RAW", "t", "xlsx")


def test_file_order(spark, tmp_path):
    folder = tmp_path / "t.csv"
    folder.mkdir()
    for part, start in (("b", 1000), ("a", 0), ("c", 2000)):
        (folder / f"{part}.csv").write_text("n\n" + "".join(f"{i}\n" for i in range(start, start + 1000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1024)
    try:
        df = src.read_table(spark, str(folder), file_order=True)
        assert df.columns == ["n", *FILE_ORDER]
        assert df.rdd.getNumPartitions() > 5
        ordered = df.repartition(7).orderBy(*FILE_ORDER).select(F.col("n").cast("int")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r[0] for r in ordered] == list(range(3000))


def test_lookup(spark, tmp_path, rows):
    whole = tmp_path / "whole.json"
    whole.write_text(json.dumps({"k 1": "A / B", "k 2": "C"}, indent=4))
    assert rows(src.read_lookup(spark, str(whole))) == [("k 1", "A / B"), ("k 2", "C")]
    lines = tmp_path / "lines.json"
    lines.write_text('{"a": "1", "b": "2"}\n{"c": "3"}\n')
    assert rows(src.read_lookup(spark, str(lines), "lines")) == [("a", "1"), ("b", "2"), ("c", "3")]
    with pytest.raises(ValueError):
        src.read_lookup(spark, str(lines), "rows")


def test_lookup_of_any_layout(spark, tmp_path, rows):
    table = {f"k {i}": f"v, \"{i}\"" for i in range(300)}
    for i, text in enumerate((json.dumps(table), json.dumps(table, indent=1), '{"k": "v",\n"l": "w"}', '{\n"k": {\n"l": "w"\n}\n}')):
        path = tmp_path / f"l{i}.json"
        path.write_text(text)
        expected = {k: v if isinstance(v, str) else json.dumps(v, separators=(",", ":")) for k, v in json.loads(text).items()}
        assert dict(rows(src.read_lookup(spark, str(path)))) == expected


def test_one_line_lookup_is_read_by_several_tasks(spark, tmp_path, rows):
    table = {f'k {i}, "{i % 7}" {{': ["a, b", 'he said "no", then', "]}{[", "c:\\\\", "", None, "é,\n,"][i % 7] for i in range(2000)}
    table["nested"] = {"x": [1, 2, {"y": "},{"}], "z": ""}
    table["list"] = [1, "a,b", [2, 3]]
    folder = tmp_path / "lookups"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(table, ensure_ascii=False))
    (folder / "b.json").write_text("{}")
    (folder / "c.json").write_text('  {"only": "one, two"}  \n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        found = src.read_lookup(spark, str(folder))
        assert spark.read.text(str(folder / "a.json"), lineSep=",").rdd.getNumPartitions() > 5
        out = {r["key"]: r["value"] for r in found.collect()}
        assert found.count() == len(table) + 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    plain = {k: v if v is None or isinstance(v, str) else json.dumps(v, separators=(",", ":")) for k, v in table.items()}
    assert out == plain | {"only": "one, two"}


def test_rows_that_do_not_fit_the_header(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n1,2\n3\n")
    assert [tuple(r) for r in src.read_table(spark, str(path)).collect()] == [("1", "2"), ("3", None)]
    path.write_text('a,b\n1,"x, y"\n3,4,5\n')
    for use in (lambda df: df.collect(), lambda df: df.count(), lambda df: df.select("a").collect()):
        with pytest.raises(Exception, match="more than 2 fields"):
            use(src.read_table(spark, str(path)))


def test_part_files_must_agree_in_headers(spark, tmp_path):
    folder = tmp_path / "t.csv"
    folder.mkdir()
    (folder / "1.csv").write_text("a,b\n1,2\n")
    (folder / "2.csv").write_text("b,a\n9,8\n")
    with pytest.raises(Exception, match="(?i)header"):
        src.read_table(spark, str(folder)).collect()


def test_landing_of_repeated_headers(spark, tmp_path, rows):
    source = tmp_path / "in"
    source.mkdir()
    (source / "t.csv").write_text("a,a,\n1,2,3\n")
    status = src.land_datasets(spark, str(source), str(tmp_path / "out")).first()
    assert (status.status, status.raw_headers) == ("landed", ["a", "a", ""])
    landed = spark.read.parquet(f"{tmp_path}/out/RAW/t.parquet")
    assert landed.columns == ["a", "a_1", "column_"] and rows(landed) == [("1", "2", "3")]


def test_select_distinct(spark, rows):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "n int, t string")
    assert rows(src.select_distinct(df, ["n"], "t = 'a'")) == [(1,), (2,)]
    assert rows(src.select_distinct(df, ["n"])) == [(1,), (2,)]
    with pytest.raises(ValueError):
        src.select_distinct(df, [])


def test_land_datasets(spark, tmp_path, rows):
    source = tmp_path / "in"
    source.mkdir()
    (source / "one.csv").write_text("a,b\n1,2\n3,4\n")
    (source / "two.json").write_text('{"a": 1}\n')
    (source / "three.xlsx").write_text("?")
    (source / ".hidden").write_text("?")
    status = src.land_datasets(spark, str(source), str(tmp_path / "out"))
    assert rows(status.select("name", "n_rows", "status")) == [
        ("one", 2, "landed"),
        ("three", None, "failed"),
        ("two", 1, "landed"),
    ]
    assert "suffix" in status.where("name = 'three'").first().error
    assert rows(spark.read.parquet(f"{tmp_path}/out/RAW/one.parquet")) == [("1", "2"), ("3", "4")]


def test_scratch_dir(spark, monkeypatch):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    path = src.scratch_dir(spark, "x")
    assert path.startswith(shared.rstrip("/") if shared else "/tmp")
    assert src.scratch_dir(spark, "x") != path
