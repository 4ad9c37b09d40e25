"""Schema helpers: column lists by type, type families, missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
SEMANTIC_KEY = "semantic_type"


def quoted(name: str) -> str:
    """Column name with backticks, so that dots, spaces and ``#`` are safe."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def numeric_columns(df: DataFrame) -> list[str]:
    """Integer, float and decimal columns; booleans are not numeric."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def integer_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def plain_columns(df: DataFrame) -> list[str]:
    """Columns whose values can be compared and counted (no nested types)."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, NESTED_TYPES)]


def existing(df: DataFrame, names) -> list[str]:
    """The names that exist in ``df``, in the given order."""
    have = set(df.columns)
    return [n for n in names if n in have]


def require(df: DataFrame, names) -> list[str]:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return list(names)


def type_family(field: T.StructField) -> str:
    """Coarse type label of a field, as shown in profiles."""
    if (field.metadata or {}).get(SEMANTIC_KEY) == "category":
        return "Category"
    if isinstance(field.dataType, T.IntegralType):
        return "Integer"
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return "Float"
    if isinstance(field.dataType, T.StringType):
        return "String/Object"
    if isinstance(field.dataType, DATETIME_TYPES):
        return "DateTime"
    if isinstance(field.dataType, T.BooleanType):
        return "Boolean"
    return field.dataType.simpleString()


def missing_as_null(df: DataFrame) -> DataFrame:
    """Turn NaN in float columns into NULL, the one mark for a missing value."""
    floats = {
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    }
    if not floats:
        return df
    return df.select(
        *[
            F.when(~F.isnan(col(n)), col(n)).alias(n) if n in floats else col(n)
            for n in df.columns
        ]
    )


def tidy(summary: DataFrame, rows: list[dict[str, Column]]) -> DataFrame:
    """One output row per dict, all computed from a one-row aggregate."""
    structs = [F.struct(*[c.alias(n) for n, c in row.items()]) for row in rows]
    return summary.select(F.inline(F.array(*structs)))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part`` in percent of ``whole``; 0 when there are no rows."""
    share = F.try_divide(part * F.lit(100.0), whole)
    return F.round(F.coalesce(share, F.lit(0.0)), digits)


def distinct_key(df: DataFrame, name: str) -> Column:
    """Value to feed into a distinct count.

    Long texts are replaced by their SHA-256, so that only 64 characters per
    row are shuffled however long the text is.
    """
    if name in string_columns(df):
        return F.when(F.length(col(name)) > 128, F.sha2(col(name), 256)).otherwise(col(name))
    return col(name)
