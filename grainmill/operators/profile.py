"""First look at a table: size, column types, sample rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.functions.columns import col, type_family


def type_distribution(df: DataFrame) -> DataFrame:
    """Number of columns per type family."""
    families: dict[str, int] = {}
    for f in df.schema.fields:
        families[type_family(f)] = families.get(type_family(f), 0) + 1
    return df.sparkSession.createDataFrame(
        sorted(families.items()), "family string, n_columns bigint"
    )


def initial_profile(df: DataFrame) -> DataFrame:
    """Row and column count, columns per type family and the column names."""
    fixed = [("summary", "columns", str(len(df.columns)))]
    families: dict[str, int] = {}
    for f in df.schema.fields:
        families[type_family(f)] = families.get(type_family(f), 0) + 1
    fixed += [("types", k, str(v)) for k, v in sorted(families.items())]
    fixed += [("column", f"{i:04d}", c) for i, c in enumerate(df.columns)]
    structs = [
        F.struct(F.lit(a).alias("section"), F.lit(b).alias("name"), F.lit(c).alias("value"))
        for a, b, c in fixed
    ]
    rows = F.struct(
        F.lit("summary").alias("section"),
        F.lit("rows").alias("name"),
        F.col("n").cast("string").alias("value"),
    )
    return df.agg(F.count("*").alias("n")).select(F.inline(F.array(rows, *structs)))


def sample_rows(df: DataFrame, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """A few rows to look at; the first ones if an order is given."""
    if order_by:
        df = df.orderBy(*[col(c) for c in order_by])
    return df.limit(n)
