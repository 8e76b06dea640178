"""Sources and sinks: CSV/Parquet scans, merging files, preview, metadata, reports, models."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_datetime_type, is_numeric_type, is_text_type

SUFFIXES = {".csv": "csv", ".parquet": "parquet"}


# Texts of a CSV cell that mean a missing value.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
           "NaN", "None", "n/a", "nan", "null")


class SourceError(ValueError):
    pass


def _local_path(path: str) -> bool:
    return "://" not in path or path.startswith("file:")


def _check_path(path: str) -> str:
    if not path:
        raise SourceError("no path given")
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in SUFFIXES:
        raise SourceError(f"unsupported file type {suffix or '(none)'!r}; expected one of {sorted(SUFFIXES)}")
    if _local_path(path):
        local = path[5:] if path.startswith("file:") else path
        if not os.path.exists(local):
            raise SourceError(f"path does not exist: {path}")
        if suffix == ".csv" and not os.path.isfile(local) and not os.path.isdir(local):
            raise SourceError(f"not a file: {path}")
    return SUFFIXES[suffix]


#: CSV as spreadsheets and databases write it: cells with separators, quotes or line breaks stand
#: in quotes, and a quote inside is doubled.
_CSV = {"header": True, "quote": '"', "escape": '"'}


def cells_span_lines(spark: SparkSession, path: str) -> bool:
    """Whether a cell may hold a line break: only then has some line an odd number of quotes.

    One pass over the lines, without parsing them; quotes are ASCII, so any encoding that keeps
    ASCII will do."""
    line = F.col("value")
    quotes = F.octet_length(line) - F.octet_length(F.replace(line, F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def write_csv(df: DataFrame, path: str, mode: str = "error") -> str:
    """Write CSV (a header row in each file) that :func:`read_table` reads back cell by cell:
    cells with separators, quotes, line breaks or outer blanks are quoted, quotes doubled.
    Missing cells are empty; a text that is a missing-value token reads back as missing."""
    plain = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}
    df.write.mode(mode).options(**_CSV, **plain).csv(path)
    return path


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, infer: bool = True,
               check: bool = True, multiline: bool | None = None, position: bool = False) -> DataFrame:
    """Scan one CSV (header row) or Parquet file, chosen by suffix (case-insensitive).

    Quoted CSV cells may hold separators, doubled quotes and line breaks. A file in which no cell
    spans lines is cut into splits at line ends; one in which some does is read by one task (so
    large tables of that kind belong in many files). Line breaks in cells are kept, but in a file
    whose lines end in CR LF those are read as LF. ``multiline`` says which it is; None finds
    out by one more pass (:func:`cells_span_lines`).

    CSV takes an explicit ``schema`` when given, else infers types after the missing-value
    tokens (``MISSING``) were set to null (one extra pass; prefer a schema at scale); with a
    schema the tokens are null as well. With ``check``, a table without columns or rows is an
    error. With ``position``, two more columns (``POSITION``) say where in the source a row
    stands: sorted by them, rows are in file order.
    """
    fmt = _check_path(path)
    if fmt == "csv":
        whole = cells_span_lines(spark, path) if multiline is None else multiline
        df = spark.read.options(**_CSV, mode="FAILFAST", multiLine=whole).csv(path)
        cells = df.columns
        # a task numbers the rows of each block of a file in their order
        df = df.select(*[_without_tokens(c) for c in cells], *_place(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
        if schema is not None:
            kinds = spark.createDataFrame([], schema).schema
            if len(kinds) != len(cells):
                raise SourceError(f"the schema has {len(kinds)} columns, {path} has {len(cells)}")
            df = df.select(*[F.col(f"`{c}`").cast(f.dataType).alias(f.name) for c, f in zip(cells, kinds)], *POSITION)
        elif infer:
            df = infer_types(df, cells)
    else:
        df = spark.read.schema(schema).parquet(path) if schema is not None else spark.read.parquet(path)
        df = df.select("*", *_place(F.lit(0).cast("long"), F.col("_metadata.row_index")))
    if not position:
        df = df.drop(*POSITION)
    if check:
        if not df.columns:
            raise SourceError(f"no columns in {path}")
        if df.isEmpty():
            raise SourceError(f"no rows in {path}")
    return df


#: Columns that place a row in its source: the file, and block and number in it.
POSITION = ("_file", "_row")


def _place(block: Column, at: Column) -> list[Column]:
    return [F.col("_metadata.file_path").alias(POSITION[0]), F.struct(block.alias("block"), at.alias("at")).alias(POSITION[1])]


def _without_tokens(name: str) -> Column:
    cell = F.col(f"`{name}`")
    return F.when(~cell.isin(*MISSING), cell).alias(name)


def infer_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Cast text ``columns`` (all by default) to the narrowest type that reads all their present
    values: int, bigint, double, boolean, date, timestamp, else text. One wide aggregation."""
    columns = df.columns if columns is None else columns
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`")
        aggs += [F.count(x).alias(f"n{i}"), *[F.count_if(test(x)).alias(f"{kind}{i}") for kind, test in _READS.items()]]
    row = df.agg(*aggs).first() if aggs else None
    kinds = {c: next((k for k in _READS if row[f"n{i}"] and row[f"{k}{i}"] == row[f"n{i}"]), "string") for i, c in enumerate(columns)}
    return df.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in df.columns])


_READS = {
    "int": lambda x: x.rlike(r"^\s*[+-]?[0-9]+\s*$") & x.try_cast("int").isNotNull(),
    "bigint": lambda x: x.rlike(r"^\s*[+-]?[0-9]+\s*$") & x.try_cast("bigint").isNotNull(),
    "double": lambda x: x.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$|^\s*[+-]?(inf|Infinity)\s*$") & x.try_cast("double").isNotNull(),
    "boolean": lambda x: F.lower(x).isin("true", "false"),
    "date": lambda x: x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & x.try_cast("date").isNotNull(),
    "timestamp": lambda x: x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T]") & x.try_cast("timestamp").isNotNull(),
}


def read_tables(spark: SparkSession, paths: list[str] | str, schema=None, check: bool = True,
                multiline: bool | None = None) -> DataFrame:
    """Several files (a list or a comma-separated string): the sets of column names must be
    equal; rows are concatenated in file order with columns aligned by name (first file's
    column order)."""
    if isinstance(paths, str):
        paths = [p.strip() for p in paths.split(",") if p.strip()]
    if not paths:
        raise SourceError("no paths given")
    frames = [read_table(spark, p, schema, check=check, multiline=multiline) for p in paths]
    return merge_tables(frames)


def merge_tables(frames: list[DataFrame]) -> DataFrame:
    first = frames[0]
    names = set(first.columns)
    for i, f in enumerate(frames[1:], start=2):
        if set(f.columns) != names:
            raise SourceError(
                f"table {i} has columns {sorted(set(f.columns) ^ names)} that differ from the first table"
            )
    # a column that is a number in one table and text in another becomes text
    mixed = [c for c in first.columns if not _compatible([f.schema[c].dataType for f in frames])]
    frames = [f.withColumns({c: F.col(f"`{c}`").cast("string") for c in mixed}) if mixed else f for f in frames]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _compatible(kinds: list[T.DataType]) -> bool:
    """Whether Spark's union finds a common type that keeps the values as they are."""
    if all(k == kinds[0] for k in kinds) or all(isinstance(k, T.NumericType) for k in kinds):
        return True
    return all(isinstance(k, (T.DateType, T.TimestampType)) for k in kinds)


def preview(df: DataFrame, key: list[str] | str | None = None, n: int = 5) -> DataFrame:
    """The first ``n`` rows in ``key`` order (a top-n: each task keeps n rows); without a key in
    file order, for tables read with ``position``."""
    keys = [key] if isinstance(key, str) else list(key or POSITION)
    if missing := [c for c in keys if c not in df.columns]:
        raise SourceError(f"no column {missing}: name a key, or read the table with its position")
    return df.orderBy(*keys).limit(n).drop(*(() if key else POSITION))


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def metadata(df: DataFrame) -> DataFrame:
    """One row per column: ``column_name, position, dtype, kind, n_rows, n_columns`` where
    kind is numeric / categorical / datetime / other by the metadata rule (categorical is
    text only; booleans are numeric)."""
    spark = df.sparkSession
    rows = []
    for i, f in enumerate(df.schema.fields):
        dt = f.dataType
        kind = (
            "numeric" if is_numeric_type(dt) else "categorical" if is_text_type(dt) else "datetime" if is_datetime_type(dt) else "other"
        )
        rows.append((f.name, i, dt.simpleString(), kind))
    cols = spark.createDataFrame(rows, "column_name string, position int, dtype string, kind string")
    n = df.count()
    return cols.select("*", F.lit(n).cast("long").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write a report table as JSON lines (one file per task; a report is small)."""
    df.write.mode(mode).json(path)
    return path


def read_report(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return spark.read.schema(schema).json(path) if schema is not None else spark.read.json(path)


def save_model(model, path: str) -> str:
    """Write a fitted model (:class:`lathe.operators.models.FittedModel`) with its labels."""
    model.save(path)
    return path


def load_model(spark: SparkSession, path: str):
    from ..operators.models import load_model as load

    return load(spark, path)
