"""Value counts and distinct counts of several columns."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.functions.columns import col, distinct_key, tidy


def value_counts(df: DataFrame, columns: list[str], as_text: bool = True) -> DataFrame:
    """Rows per present value: ``column``, ``value`` and ``n``.

    Values are shown as text, or kept if all columns have the same type.
    Counting starts before the shuffle, so a frequent value stays cheap.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string, n bigint")
    values = df.select(
        *[(col(c).cast("string") if as_text else col(c)).alias(c) for c in columns]
    )
    long = values.unpivot([], [col(c) for c in columns], "column", "value")
    return (
        long.where("value IS NOT NULL")
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )


def distinct_counts(df: DataFrame, columns: list[str], approx: bool = False) -> DataFrame:
    """Distinct present values per column: ``column`` and ``unique_count``.

    Columns of one type share a shuffle of (column, value) pairs, which are made
    distinct before it. That is lighter than several distinct aggregates in one
    ``agg``, where every pair would carry the buffers of all other aggregates.
    ``approx`` estimates within about 2 % without a shuffle of values.
    """
    spark = df.sparkSession
    if not columns:
        return spark.createDataFrame([], "column string, unique_count bigint")
    if approx:
        sketches = df.agg(
            *[F.approx_count_distinct(col(c), 0.02).alias(f"u{i}") for i, c in enumerate(columns)]
        )
        return tidy(
            sketches,
            [
                {"column": F.lit(c), "unique_count": F.col(f"u{i}")}
                for i, c in enumerate(columns)
            ],
        )
    by_type: dict[str, list[str]] = {}
    for c in columns:
        by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    parts = []
    for names in by_type.values():
        keys = df.select(*[distinct_key(df, c).alias(c) for c in names])
        pairs = keys.unpivot([], [col(c) for c in names], "column", "value").distinct()
        parts.append(pairs.groupBy("column").agg(F.count("value").alias("unique_count")))
    return functools.reduce(DataFrame.unionAll, parts)


def most_frequent(counts: DataFrame) -> DataFrame:
    """The top value of each column; the smallest one if several tie.

    The highest counts are found first, so only values that reach them are
    compared. Both steps read the same shuffled counts.
    """
    # One row per column.
    highest = F.broadcast(
        counts.groupBy("column").agg(F.max("n").alias("n"), F.count("*").alias("distinct"))
    )
    return (
        counts.join(highest, ["column", "n"])
        .groupBy("column")
        .agg(F.min("value").alias("value"), F.max("n").alias("n"), F.max("distinct").alias("distinct"))
    )


def top_values(counts: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` most frequent values of each column with their rank.

    Spark cuts each column to ``limit`` rows before the shuffle as well.
    """
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value"))
    return (
        counts.withColumn("rank", F.row_number().over(order).cast("bigint"))
        .where(F.col("rank") <= limit)
        .select("column", "rank", "value", "n")
    )
