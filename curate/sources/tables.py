"""Tables and lookups as files."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# CSV texts that mean "no value".
NA_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Where each row stood in its file, see with_file_order.
FILE_ORDER = ("_file_path", "_file_block", "_file_row")

FORMATS = ("csv", "json", "parquet")

# Doubled quotes inside quoted fields, and white space kept as it is.
_CSV = {
    "encoding": "UTF-8",
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}

_LOOKUP = T.MapType(T.StringType(), T.StringType())


def format_of(path: str) -> str:
    """The format named by the path's suffix."""
    suffix = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()
    if suffix not in FORMATS:
        raise ValueError(f"cannot read {path!r}: the suffix must be one of {', '.join(FORMATS)}")
    return suffix


def with_file_order(df: DataFrame) -> DataFrame:
    """Add the columns ``FILE_ORDER``, which sort rows as they stand in the files.

    Call it right on a table that was read from files. Spark may pack several file
    splits into one partition in any order; path and split start put them in order
    again, and the row number counts upwards inside a split.
    """
    path, block, row = FILE_ORDER
    return df.select(
        "*",
        F.col("_metadata.file_path").alias(path),
        F.col("_metadata.file_block_start").alias(block),
        F.monotonically_increasing_id().alias(row),
    )


def _csv_header(spark: SparkSession, path: str, multi_line: bool) -> list[str]:
    first = spark.read.options(header=False, multiLine=multi_line, **_CSV).csv(path).head()
    if first is None:
        raise ValueError(f"{path!r} has no header line")
    return [value or "" for value in first]


def read_table(
    spark: SparkSession,
    path: str,
    *,
    na_texts: Sequence[str] = NA_TEXTS,
    multi_line: bool = False,
    file_order: bool = False,
) -> DataFrame:
    """Read CSV, JSON lines or Parquet by suffix. CSV columns stay text, and texts in
    ``na_texts`` become null, so that typed rules decide about types later.

    Headers come back exactly as written, repeats and blanks included. ``multi_line``
    allows line breaks inside quoted CSV fields; such files cannot be split.
    ``file_order`` adds the columns of :func:`with_file_order`.

    A CSV row with more fields than the header is an error when the row is read; one with
    fewer ends in nulls. Files of a folder must agree in their headers, which is checked
    file by file unless names repeat or are blank.
    """
    kind = format_of(path)
    if kind != "csv":
        reader = spark.read.option("multiLine", multi_line) if kind == "json" else spark.read
        df = reader.format(kind).load(path)
        return with_file_order(df) if file_order else df
    names = _csv_header(spark, path, multi_line)
    distinct = len({name.lower() for name in names if name.strip()}) == len(names)
    places = [f"_{i}" for i in range(len(names))]
    misfit = "_misfit"
    while misfit in names:
        misfit += "_"
    schema = T.StructType([T.StructField(name, T.StringType()) for name in (*(names if distinct else places), misfit)])
    # With its own names as the schema, each file's header is held against them.
    options = {"header": True, "multiLine": multi_line, "enforceSchema": not distinct, "columnNameOfCorruptRecord": misfit}
    # The parser counts fields only if it parses all of them.
    options |= {"columnPruning": False}
    df = spark.read.schema(schema).options(**options, **_CSV).csv(path)
    extra = list(FILE_ORDER) if file_order else []
    df = (with_file_order(df) if file_order else df).toDF(*places, misfit, *extra)
    # A row of another length comes whole in this column; read again with room for one more.
    wider = F.from_csv(misfit, ", ".join(f"f{i} string" for i in range(len(names) + 1)), {"escape": '"'})
    surplus = F.col(misfit).isNotNull() & wider[f"f{len(names)}"].isNotNull()
    # Spark reads no file for the misfit column alone, as in a count; the error names a field too.
    start = F.concat_ws(" ", F.lit(f"more than {len(names)} fields in a row of {path}, at"), places[0], F.lit(":"))
    error = F.raise_error(F.concat(start, F.substring(misfit, 1, 200)))
    df = df.where(F.when(surplus, error.cast("boolean")).otherwise(True))
    known = [F.when(~F.col(place).isin(*na_texts), F.col(place)).alias(place) for place in places]
    return df.select(*known, *extra).toDF(*names, *extra)


def write_table(df: DataFrame, base: str, zone: str, name: str, fmt: str = "parquet") -> str:
    """Write ``df`` to ``base/zone/name.fmt``, replacing what is there; return the path.

    The table is written beside its place and swapped in when it is complete, so a failed
    run leaves the former table as it was, and ``df`` may read the table it replaces.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; use one of {', '.join(FORMATS)}")
    path = f"{base.rstrip('/')}/{zone}/{name}.{fmt}"
    replace_folder(df, path, fmt, f"{base.rstrip('/')}/{zone}")
    return path


def replace_folder(df: DataFrame, path: str, fmt: str = "parquet", beside: str | None = None) -> None:
    """Write ``df`` to a staged folder, under ``beside`` or the path's parent, and swap it in at ``path``."""
    parent, name = path.rsplit("/", 1)
    staged = f"{beside or parent}/{STAGED}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer = writer.options(header=True, **_CSV)
    try:
        writer.format(fmt).save(staged)
        _swap_in(df.sparkSession, staged, path)
    finally:
        _delete(df.sparkSession, staged)


def exists(spark: SparkSession, path: str) -> bool:
    place, files = _file_system(spark, path)
    return files.exists(place)


#: Readers pass over names that begin so.
STAGED = "_staged"


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    place, files = _file_system(spark, path)
    files.delete(place, True)


def _swap_in(spark: SparkSession, staged: str, path: str) -> None:
    """Put a complete table in a table's place by two renames; undo the first if the second fails."""
    new, files = _file_system(spark, staged)
    old, _ = _file_system(spark, path)
    aside, _ = _file_system(spark, f"{staged}.former")
    files.mkdirs(old.getParent())
    held = files.exists(old)
    if held and not files.rename(old, aside):
        raise OSError(f"{path} could not be set aside")
    if not files.rename(new, old):
        if held:
            files.rename(aside, old)
        raise OSError(f"{staged} could not be put in place of {path}")
    if held:
        files.delete(aside, True)


def read_lookup(spark: SparkSession, path: str, layout: str = "file") -> DataFrame:
    """Read JSON objects as rows ``(key, value)``.

    ``layout="lines"`` takes each line as one object, ``layout="file"`` each file, laid out
    in any way, on one line too. A file splits like any text: it is read in pieces between
    commas, and running counts of quotes and brackets tell which commas part its pairs.
    """
    if layout not in ("file", "lines"):
        raise ValueError(f"unknown layout {layout!r}; use 'file' or 'lines'")
    if layout == "lines":
        return spark.read.text(path).select(F.explode(F.from_json("value", _LOOKUP)).alias("key", "value"))
    return _pairs(with_file_order(spark.read.text(path, lineSep=",")))


def _running(df: DataFrame, amount: Column, before: str) -> DataFrame:
    """Add ``before``: the sum of ``amount`` over the file's earlier pieces.

    Blocks of the file are summed on their own; only their sums meet in one window.
    """
    file, block, row = FILE_ORDER
    counted = df.withColumn("_amount", amount)
    sums = counted.groupBy(file, block).agg(F.sum("_amount").alias("_sum"))
    earlier = Window.partitionBy(file).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(file, block, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(file, block).orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    found = counted.withColumn("_inside", F.coalesce(F.sum("_amount").over(inside), F.lit(0))).join(starts, [file, block])
    return found.withColumn(before, F.col("_start") + F.col("_inside")).drop("_amount", "_start", "_inside")


def _pairs(pieces: DataFrame) -> DataFrame:
    """The pairs of one JSON object a file, from its pieces between commas."""
    file, block, row = FILE_ORDER
    # A comma never parts an escape, so each piece knows its own quotes.
    unescaped = F.regexp_replace("value", r"\\.", "")
    quotes = F.length(unescaped) - F.length(F.replace(unescaped, F.lit('"'), F.lit("")))
    pieces = _running(pieces, quotes, "quotes")
    in_text = F.col("quotes") % 2 == 1
    outside = F.regexp_replace(F.concat(F.when(in_text, '"').otherwise(""), unescaped), r'(?s)"[^"]*("|$)', "")
    depth = F.length(F.regexp_replace(outside, r"[^{\[]", "")) - F.length(F.regexp_replace(outside, r"[^}\]]", ""))
    pieces = _running(pieces.withColumn("within", depth), F.col("within"), "depth")
    # A pair begins at the file's first piece and after each comma of the object itself.
    begins = (F.col("quotes") % 2 == 0) & (F.col("depth") <= 1)
    pieces = _running(pieces.withColumn("begins", begins.cast("long")), F.col("begins"), "earlier")
    pair = (F.col("earlier") + F.col("begins")).alias("pair")
    # Only the pairs that commas run through have several pieces to bring together.
    texts = pieces.groupBy(file, pair).agg(
        F.array_sort(F.collect_list(F.struct(block, row, "value", "depth", "within"))).alias("pieces")
    )
    text = F.array_join(F.transform("pieces", lambda piece: piece["value"]), ",")
    first, last = F.get("pieces", F.lit(0)), F.element_at("pieces", -1)
    text = F.when(first["depth"] == 0, F.regexp_replace(text, r"^\s*\{", "")).otherwise(text)
    text = F.when(last["depth"] + last["within"] == 0, F.regexp_replace(text, r"\}\s*$", "")).otherwise(text)
    found = F.from_json(F.concat(F.lit("{"), text, F.lit("}")), _LOOKUP)
    return texts.select(F.explode(found).alias("key", "value"))


def select_distinct(df: DataFrame, columns: Sequence[str], where: str | None = None) -> DataFrame:
    """Distinct rows of ``columns``; ``where`` may use columns that are not selected."""
    if not columns:
        raise ValueError("at least one column must be named")
    rows = df.where(F.expr(where)) if where else df
    return rows.select(*columns).distinct()
