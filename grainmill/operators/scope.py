"""Which columns are worth keeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.columns import (
    NESTED_TYPES,
    col,
    distinct_key,
    existing,
    numeric_columns,
    percent,
    plain_columns,
    string_columns,
    tidy,
)
from grainmill.plans.counts import distinct_counts, most_frequent, top_values, value_counts

# Shares in percent from which a column is flagged.
NEAR_CONSTANT_PCT = 95
HIGH_MISSING_PCT = 50
TOP_VALUES = 5
FEW_VALUES = 20


def _dtype(df: DataFrame, name: str) -> str:
    dtype = df.schema[name].dataType
    return "nested" if isinstance(dtype, NESTED_TYPES) else dtype.simpleString()


def _cardinality(df: DataFrame, extra=None) -> DataFrame:
    """Per column: type, rows, missing values and extra aggregates.

    ``extra`` maps a name to a function that gives the aggregate of a column.
    """
    extra = extra or {}
    columns = list(df.columns)
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        aggs.append(F.count(col(c)).alias(f"n{i}"))
        aggs += [f(c).alias(f"{name}{i}") for name, f in extra.items()]
    return tidy(
        df.agg(*aggs),
        [
            {
                "column": F.lit(c),
                "dtype": F.lit(_dtype(df, c)),
                "rows": F.col("rows"),
                "null_count": F.col("rows") - F.col(f"n{i}"),
                **{name: F.col(f"{name}{i}") for name in extra},
            }
            for i, c in enumerate(columns)
        ],
    )


def _unique_and_mode(df: DataFrame) -> DataFrame:
    """Distinct values per column; for text columns the top count as well."""
    texts = string_columns(df)
    others = [c for c in plain_columns(df) if c not in set(texts)]
    keys = df.select(*[distinct_key(df, c).alias(c) for c in texts])
    # The counts per value of a text column give both numbers.
    modes = most_frequent(value_counts(keys, texts))
    return modes.select(
        "column", F.col("distinct").alias("unique_count"), F.col("n").alias("mode_count")
    ).unionByName(
        distinct_counts(df, others).withColumn("mode_count", F.lit(0).cast("bigint"))
    )


def column_recommendations(df: DataFrame) -> DataFrame:
    """Per column: counts, flags and the advice to keep, review or drop it."""
    # One row per column of the table on either side.
    profile = _cardinality(df).join(F.broadcast(_unique_and_mode(df)), "column", "left")

    def share(part: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part) * F.lit(100.0), F.col("rows")), F.lit(0.0))

    # A text column without values has no counts at all.
    nested = F.col("dtype") == "nested"
    unique = F.when(~nested, F.coalesce("unique_count", F.lit(0)))
    zero = F.coalesce(unique <= 1, F.lit(False))
    identifier = F.coalesce(~zero & (unique == F.col("rows")), F.lit(False))
    near = ~zero & ~identifier & (share("mode_count") > NEAR_CONSTANT_PCT)
    sparse = share("null_count") > HIGH_MISSING_PCT
    return profile.select(
        "column",
        "dtype",
        unique.alias("unique_count"),
        "null_count",
        percent(F.col("null_count"), F.col("rows")).alias("null_pct"),
        F.concat_ws(
            ",",
            F.when(zero, "zero_variance"),
            F.when(identifier, "high_cardinality"),
            F.when(near, "near_zero_variance"),
            F.when(sparse, "high_missing"),
        ).alias("flags"),
        # A mostly missing column ends as "review" even if it is constant.
        F.when(sparse | identifier | near, "review")
        .when(zero, "drop")
        .otherwise("keep")
        .alias("recommendation"),
    )


def _auto_drop_reasons(
    df: DataFrame, columns: list[str], zero_variance: bool, high_cardinality: bool
) -> dict[str, str]:
    plain = [c for c in columns if c in set(plain_columns(df))]
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(plain):
        # Constant if smallest equals largest: no distinct count needed.
        aggs.append(F.min(col(c)).eqNullSafe(F.max(col(c))).alias(f"z{i}"))
        if high_cardinality:
            aggs.append(F.count(col(c)).alias(f"n{i}"))
            aggs.append(F.approx_count_distinct(col(c), 0.05).alias(f"a{i}"))
    row = df.agg(*aggs).first()
    reasons = {}
    candidates = []
    for i, c in enumerate(plain):
        if zero_variance and row[f"z{i}"]:
            reasons[c] = "zero_variance"
        elif high_cardinality and row[f"n{i}"] == row["rows"]:
            # The estimate is off by 5 % (one sigma); only clear misses are skipped.
            if row[f"a{i}"] >= row["rows"] * 0.6:
                candidates.append(c)
    if candidates:
        for r in distinct_counts(df, candidates).collect():
            if r["unique_count"] == row["rows"]:
                reasons[r["column"]] = "high_cardinality"
    return reasons


def apply_scope_selection(
    df: DataFrame,
    selected: list[str] | None = None,
    drop_zero_variance: bool = True,
    drop_high_cardinality: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The chosen columns less the automatically dropped ones, and the reasons.

    Unknown names are ignored; an empty choice means all columns.
    """
    spark = df.sparkSession
    chosen = existing(df, selected) if selected else list(df.columns)
    reasons = {}
    if drop_zero_variance or drop_high_cardinality:
        reasons = _auto_drop_reasons(df, chosen, drop_zero_variance, drop_high_cardinality)
    kept = [c for c in chosen if c not in reasons]
    stats = spark.createDataFrame(
        [
            (c, c in kept, reasons.get(c, None if c in chosen else "not_selected"))
            for c in df.columns
        ],
        "column string, kept boolean, reason string",
    )
    return df.select(*[col(c) for c in kept]), stats


def column_summary(df: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """Per column: type, distinct and missing counts, numeric range and mean."""
    numbers = set(numeric_columns(df))

    def numeric(aggregate):
        nothing = F.first(F.lit(None).cast("double"))
        return lambda c: aggregate(col(c)).cast("double") if c in numbers else nothing

    stats = {"min": numeric(F.min), "max": numeric(F.max), "mean": numeric(F.avg)}
    # One row per column of the table on either side.
    unique = F.broadcast(distinct_counts(df, plain_columns(df), approx_distinct))
    return _cardinality(df, stats).join(unique, "column", "left").select(
        "column",
        "dtype",
        "unique_count",
        "null_count",
        percent(F.col("null_count"), F.col("rows")).alias("null_pct"),
        *stats,
    )


def column_top_values(df: DataFrame, limit: int = TOP_VALUES) -> DataFrame:
    """Most frequent values of text columns and of columns with few values.

    A column counts as having few values if an estimate allows it; the exact
    number decides in the same pass that ranks the values.
    """
    plain = plain_columns(df)
    texts = set(string_columns(df))
    others = [c for c in plain if c not in texts]
    candidates = [c for c in plain if c in texts]
    if others:
        row = df.agg(
            *[F.approx_count_distinct(col(c), 0.05).alias(f"a{i}") for i, c in enumerate(others)]
        ).first()
        candidates += [c for i, c in enumerate(others) if row[f"a{i}"] <= FEW_VALUES * 2]
    counts = value_counts(df, candidates)
    sizes = counts.groupBy("column").agg(F.count("*").alias("distinct"))
    is_text = F.col("column").isin([c for c in candidates if c in texts]) if texts else F.lit(False)
    # One row per column of the table.
    wanted = F.broadcast(sizes.where((F.col("distinct") <= FEW_VALUES) | is_text).select("column"))
    return top_values(counts, limit).join(wanted, "column", "left_semi")


