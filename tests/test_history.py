"""Histories kept as files, and writes that are swapped in."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from curate import operators as op
from curate import sources as src
from curate.plans import history


def _stamp(day):
    return F.lit(f"2024-01-{day:02d}").cast("timestamp_ntz")


def _files(folder):
    return {str(p): hashlib.sha1(p.read_bytes()).hexdigest() for p in Path(folder).rglob("*.parquet")}


def test_a_merge_touches_only_the_current_partition(spark, tmp_path, rows):
    path = f"{tmp_path}/dim"
    days = [
        [(1, "a"), (2, "b"), (3, None)],
        [(1, "a"), (2, "c"), (4, "d")],
        [(1, "x"), (2, "c"), (4, "d"), (None, "n")],
        [(1, "x"), (2, "c"), (4, "d"), (None, "n")],
    ]
    whole = None
    for day, snapshot in enumerate(days, 1):
        df = spark.createDataFrame(snapshot, "k int, v string")
        before = {p: h for p, h in _files(path).items() if "is_current=false" in p}
        out = history.merge_history(df, path, ["k"], ["v"], _stamp(day), close_missing=True)
        whole = op.scd2_open(df, _stamp(day)) if whole is None else op.scd2_merge(whole, df, ["k"], ["v"], _stamp(day), True)
        assert out.columns == whole.columns and rows(out) == rows(whole)
        after = _files(path)
        assert all(after[p] == h for p, h in before.items())
    current = out.where("is_current")
    files = [r[0] for r in current.select(F.input_file_name()).distinct().collect()]
    assert current.count() == 4 and all("is_current=true" in f for f in files)


def test_the_same_merge_again_changes_nothing(spark, tmp_path, rows, monkeypatch):
    path = f"{tmp_path}/dim"
    old, new = (spark.createDataFrame(r, "k int, v string") for r in ([(1, "a"), (2, "b")], [(1, "z")]))
    history.merge_history(old, path, ["k"], ["v"], _stamp(1))
    real = history.replace_folder

    def fails_at_current(df, folder, *more):
        if "is_current=true" in folder:
            raise OSError("lost")
        real(df, folder, *more)

    monkeypatch.setattr(history, "replace_folder", fails_at_current)
    with pytest.raises(OSError):
        history.merge_history(new, path, ["k"], ["v"], _stamp(2))
    monkeypatch.setattr(history, "replace_folder", real)
    once = rows(history.merge_history(new, path, ["k"], ["v"], _stamp(2)))
    assert len(once) == 3 and rows(history.merge_history(new, path, ["k"], ["v"], _stamp(2))) == once


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_a_failed_write_leaves_the_former_table(spark, tmp_path, fmt):
    base = str(tmp_path)
    path = src.write_table(spark.range(5), base, "CLEAN", "t", fmt)
    broken = spark.range(5).withColumn("id", F.raise_error(F.lit("broken")).cast("long"))
    with pytest.raises(Exception, match="broken"):
        src.write_table(broken, base, "CLEAN", "t", fmt)
    assert src.read_table(spark, path).count() == 5
    # A table may be made of the one it replaces.
    src.write_table(src.read_table(spark, path).limit(2), base, "CLEAN", "t", fmt)
    assert src.read_table(spark, path).count() == 2
    assert [p.name for p in Path(base, "CLEAN").iterdir() if not p.name.startswith(("_", "."))] == [f"t.{fmt}"]
    assert not list(Path(base, "CLEAN", "_staged").glob("t*"))
