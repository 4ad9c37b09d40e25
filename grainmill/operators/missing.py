"""Missing values: where they are, how they go together, how to fill them."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.functions.columns import (
    col,
    numeric_columns,
    percent,
    require,
    tidy,
)
from grainmill.functions.moments import sample_skewness
from grainmill.plans.counts import most_frequent, value_counts
from grainmill.plans.quantiles import quantiles

METHODS = ("mean", "median", "mode", "constant", "unknown_tag", "drop")
# Skewness above which the median is advised, co-occurrence share
# above which a pair is reported, and how many pairs.
SKEW_LIMIT = 1
PATTERN_SHARE = 0.5
PATTERN_PAIRS = 10


def missing_summary(df: DataFrame) -> DataFrame:
    """Columns with missing values: count, share and a suggested way to fill."""
    numbers = set(numeric_columns(df))
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(df.columns):
        aggs.append(F.count(col(c)).alias(f"n{i}"))
        if c in numbers:
            aggs.append(sample_skewness(col(c).cast("double")).alias(f"s{i}"))
    rows = []
    for i, f in enumerate(df.schema.fields):
        missing = F.col("rows") - F.col(f"n{i}")
        if f.name in numbers:
            skewed = F.abs(F.col(f"s{i}")) > SKEW_LIMIT
            advice = F.when(skewed, "median").otherwise("mean")
            reason = F.when(skewed, "skewed").otherwise("not skewed")
        else:
            advice, reason = F.lit("mode"), F.lit("categorical")
        rows.append(
            {
                "column": F.lit(f.name),
                "dtype": F.lit(f.dataType.simpleString()),
                "missing_count": missing,
                "missing_pct": percent(missing, F.col("rows")),
                "suggested_strategy": advice,
                "reason": reason,
            }
        )
    return tidy(df.agg(*aggs), rows).where("missing_count > 0")


def missing_totals(df: DataFrame) -> DataFrame:
    """Missing cells of the whole table."""
    aggs = [F.count("*").alias("rows")]
    aggs += [F.count(col(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]
    width = len(df.columns)
    missing = [F.col("rows") - F.col(f"n{i}") for i in range(width)]
    with_missing = sum((F.when(m > 0, 1).otherwise(0) for m in missing), F.lit(0))
    cells = sum(missing, F.lit(0))
    total = F.col("rows") * F.lit(width)
    return df.agg(*aggs).select(
        F.lit(width).cast("bigint").alias("total_columns"),
        with_missing.cast("bigint").alias("columns_with_missing"),
        cells.cast("bigint").alias("total_missing_cells"),
        total.cast("bigint").alias("total_cells"),
        percent(cells, total).alias("overall_missing_pct"),
    )


@dataclass
class Imputation:
    """Fitted imputation: fill values, row filters and what they change."""

    fills: dict[str, Any] = field(default_factory=dict)
    drop_missing: list[str] = field(default_factory=list)
    stats: list[tuple] = field(default_factory=list)
    rows_after: int = 0

    def apply(self, df: DataFrame) -> DataFrame:
        """Fill and drop; row by row, also on a streaming DataFrame."""
        for c in self.drop_missing:
            df = df.where(col(c).isNotNull())
        return df.select(
            *[
                self._filled(f).alias(f.name) if f.name in self.fills else col(f.name)
                for f in df.schema.fields
            ]
        )

    def _filled(self, f: T.StructField) -> Column:
        fill = self.fills[f.name]
        if isinstance(fill, float) and isinstance(f.dataType, T.IntegralType):
            # The mean of an integer column has a fraction.
            return F.coalesce(col(f.name).cast("double"), F.lit(fill))
        return F.coalesce(col(f.name), F.lit(fill).cast(f.dataType))

    def stats_frame(self, spark) -> DataFrame:
        rows = [(*s, self.rows_after) for s in self.stats]
        return spark.createDataFrame(
            rows,
            "column string, method string, fill_value string, values_imputed bigint, "
            "error string, rows_after_imputation bigint",
        )


def _check_constant(value: Any, dtype: T.DataType) -> str | None:
    if isinstance(dtype, T.NumericType):
        try:
            number = float(value)
        except (TypeError, ValueError):
            return f"{value!r} does not fit {dtype.simpleString()}"
        if isinstance(dtype, T.IntegralType) and not number.is_integer():
            return f"{value!r} does not fit {dtype.simpleString()}"
    elif isinstance(dtype, T.BooleanType):
        if not isinstance(value, bool) and str(value).lower() not in ("true", "false"):
            return f"{value!r} does not fit {dtype.simpleString()}"
    elif isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        # Dates and times, or texts that write them in the ISO way.
        if not isinstance(value, datetime.date):
            try:
                datetime.datetime.fromisoformat(str(value))
            except ValueError:
                return f"{value!r} does not fit {dtype.simpleString()}"
    elif not isinstance(dtype, T.StringType):
        return f"no constant for {dtype.simpleString()}"
    return None


def fit_imputation(
    df: DataFrame, strategies: dict[str, dict[str, Any]], approx: bool = False
) -> Imputation:
    """Fill values for the strategies, taken in order.

    A ``drop`` removes rows for the strategies after it, which therefore look at
    their column only where the earlier dropped columns are present. That keeps
    the whole fit at one aggregation, one quantile run and one value count.
    """
    names = [c for c in strategies if c in df.columns]
    for c in names:
        method = strategies[c].get("method", "drop")
        if method not in METHODS:
            raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    kept: Column = F.lit(True)
    seen: dict[str, Column] = {}
    aggs: list[Column] = []
    medians: dict[str, Column] = {}
    modes: dict[str, Column] = {}
    for i, c in enumerate(names):
        seen[c] = kept
        method = strategies[c].get("method", "drop")
        value = F.when(kept, col(c))
        aggs.append(F.count_if(kept & col(c).isNull()).alias(f"missing{i}"))
        numeric = isinstance(df.schema[c].dataType, T.NumericType)
        if method == "mean" and numeric:
            aggs.append(F.avg(value).cast("double").alias(f"mean{i}"))
        elif method == "median" and numeric:
            medians[c] = value
        elif method == "mode":
            modes[c] = value
        elif method == "drop":
            kept = kept & col(c).isNotNull()
    aggs.append(F.count_if(kept).alias("rows"))
    row = df.agg(*aggs).first()
    needed = {c for i, c in enumerate(names) if row[f"missing{i}"]}

    medians = {c: v for c, v in medians.items() if c in needed}
    median_values = quantiles(
        df.select(*[v.cast("double").alias(c) for c, v in medians.items()]),
        {c: [0.5] for c in medians},
        approx,
    ) if medians else {}
    modes = {c: v for c, v in modes.items() if c in needed}
    mode_values = _mode_values(df.select(*[v.alias(c) for c, v in modes.items()])) if modes else {}

    fitted = Imputation(rows_after=row["rows"])
    for i, c in enumerate(names):
        missing = row[f"missing{i}"]
        if not missing:
            continue
        method = strategies[c].get("method", "drop")
        dtype = df.schema[c].dataType
        fill, error = None, None
        if method in ("mean", "median") and not isinstance(dtype, T.NumericType):
            error = f"{method} needs a numeric column"
        elif method == "mean":
            fill = row[f"mean{i}"]
        elif method == "median":
            fill = median_values[c][0]
        elif method == "mode":
            fill = mode_values.get(c)
        elif method == "constant":
            fill = strategies[c].get("value", 0)
            error = _check_constant(fill, dtype)
        elif method == "unknown_tag":
            fill = strategies[c].get("tag", strategies[c].get("value", "Unknown"))
            if not isinstance(dtype, T.StringType):
                error = "a tag needs a text column"
        if error:
            fitted.stats.append((c, method, None, None, error))
            continue
        if method == "drop":
            fitted.drop_missing.append(c)
        elif fill is not None:
            fitted.fills[c] = fill
        done = missing if method == "drop" or fill is not None else 0
        fitted.stats.append((c, method, None if fill is None else str(fill), done, None))
    return fitted


def _mode_values(df: DataFrame) -> dict[str, Any]:
    """Most frequent present value per column, the smallest one if several tie.

    Columns of the same type are counted in one shuffle.
    """
    by_type: dict[str, list[str]] = {}
    for name, dtype in df.dtypes:
        by_type.setdefault(dtype, []).append(name)
    found = {}
    for names in by_type.values():
        for r in most_frequent(value_counts(df, names, as_text=False)).collect():
            found[r["column"]] = r["value"]
    return found


def impute_missing_values(
    df: DataFrame, strategies: dict[str, dict[str, Any]], approx: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Filled table and one row of statistics per treated column."""
    fitted = fit_imputation(df, strategies, approx)
    return fitted.apply(df), fitted.stats_frame(df.sparkSession)


def missing_cooccurrence(
    df: DataFrame, columns: list[str] | None = None, limit: int | None = PATTERN_PAIRS
) -> DataFrame:
    """Pairs whose second column is mostly missing where the first one is.

    Rows are first reduced to counts per set of missing columns; only these sets
    are taken apart into pairs.
    """
    names = require(df, columns) if columns else list(df.columns)
    numbers = F.array_compact(
        F.array(*[F.when(col(c).isNull(), F.lit(i)) for i, c in enumerate(names)])
    )
    patterns = df.groupBy(numbers.alias("missing")).agg(F.count("*").alias("n"))
    firsts = patterns.select("n", "missing", F.explode("missing").alias("i"))
    seconds = firsts.select(
        "n", "i", F.explode(F.filter("missing", lambda j: j >= F.col("i"))).alias("j")
    )
    # A column paired with itself gives its number of missing cells. There are
    # at most as many rows as pairs of columns.
    both = seconds.groupBy("i", "j").agg(F.sum("n").alias("n"))
    alone = F.broadcast(both.where("i = j").select("i", F.col("n").alias("total")))
    labels = F.array(*[F.lit(c) for c in names])
    found = (
        both.where("i < j")
        .join(alone, "i")
        .withColumn("share", F.col("n") / F.col("total"))
        .where(F.col("share") > PATTERN_SHARE)
    )
    if limit:
        found = found.orderBy("i", "j").limit(limit)
    return found.select(
        F.element_at(labels, F.col("i") + 1).alias("column1"),
        F.element_at(labels, F.col("j") + 1).alias("column2"),
        F.round("share", 3).alias("co_occurrence_rate"),
    )


def _pattern(columns: list[str]) -> Column:
    return F.concat(*[F.when(col(c).isNull(), "1").otherwise("0") for c in columns])


def null_pattern_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows per pattern of missing columns, one ``1`` or ``0`` per column."""
    names = columns or list(df.columns)
    return df.groupBy(_pattern(names).alias("pattern")).agg(F.count("*").alias("n"))


def missing_matrix(df: DataFrame, key: list[str], max_rows: int = 100, seed: int = 42) -> DataFrame:
    """A repeatable sample of rows with 1 where a cell is missing, else 0."""
    require(df, key)
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(c).cast("string") for c in key]))
    return (
        df.orderBy(mark, *[col(c) for c in key])
        .limit(max_rows)
        .select(*[col(c).isNull().cast("int").alias(c) for c in df.columns])
    )


