"""Column kinds and the one notion of a missing cell.

A cell is missing when it is NULL, or NaN in a floating-point column (pandas treats
NaN/None/NaT alike). Every operator that counts or skips missing cells goes through
:func:`is_missing` / :func:`present` so the rule lives in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)
_DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)
_TEXT = (T.StringType, T.CharType, T.VarcharType)


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_floating(dt: T.DataType) -> bool:
    return isinstance(dt, _FLOATING)


def is_numeric_type(dt: T.DataType) -> bool:
    """Numeric flag of the profile: numbers and booleans (pandas counts bool as numeric)."""
    return isinstance(dt, _INTEGRAL + _FLOATING + (T.DecimalType, T.BooleanType))


def is_number_type(dt: T.DataType) -> bool:
    """Numbers only (no booleans): what mean/median/scaling accept."""
    return isinstance(dt, _INTEGRAL + _FLOATING + (T.DecimalType,))


def is_categorical_type(dt: T.DataType) -> bool:
    """Categorical flag of the profile: text and booleans."""
    return isinstance(dt, _TEXT + (T.BooleanType,))


def is_datetime_type(dt: T.DataType) -> bool:
    return isinstance(dt, _DATETIME)


def is_text_type(dt: T.DataType) -> bool:
    """Categorical rule of the metadata extractor: text only, no booleans."""
    return isinstance(dt, _TEXT)


def kind_of(dt: T.DataType) -> str:
    """One-word kind used in reports: numeric, categorical, boolean, datetime, other."""
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if is_number_type(dt):
        return "numeric"
    if is_text_type(dt):
        return "categorical"
    if is_datetime_type(dt):
        return "datetime"
    return "other"


def is_missing(c: str | Column, dt: T.DataType | None = None) -> Column:
    """NULL, or NaN when the column is floating point."""
    col = F.col(c) if isinstance(c, str) else c
    if dt is not None and is_floating(dt):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def present(c: str | Column, dt: T.DataType | None = None) -> Column:
    return ~is_missing(c, dt)


def clean(name: str, dt: T.DataType) -> Column:
    """The column with NaN turned into NULL, so aggregates skip it."""
    if is_floating(dt):
        return F.nanvl(F.col(name), F.lit(None).cast(dt))
    return F.col(name)


def missing_mask(df: DataFrame, name: str) -> Column:
    return is_missing(name, dtype_of(df, name))


def require_columns(df: DataFrame, names) -> None:
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"unknown column(s): {unknown}")


def hashable(col: Column, dt: T.DataType) -> Column:
    """What a hash of the cell is taken of: nested values as JSON, since hashes of arrays and
    structs pass over missing elements, and maps have none; -0.0 as 0.0."""
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(col, {"ignoreNullFields": "false"})
    return col + F.lit(0.0) if is_floating(dt) else col
