"""Outliers: bounds, reports and treatment."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.columns import col, existing, numeric_columns, percent, require, tidy
from grainmill.functions.moments import collect_moments, sample_kurtosis, sample_skewness
from grainmill.plans.quantiles import quantiles

METHODS = ("iqr", "zscore", "modified_zscore", "percentile")
# Usual threshold per method and the factor that scales the
# median absolute deviation to a standard deviation.
THRESHOLDS = {"iqr": 1.5, "zscore": 3.0, "modified_zscore": 3.5, "percentile": 1.0}
MAD_FACTOR = 0.6745
SAMPLE_VALUES = 20
REPORT_SCHEMA = (
    "column string, outlier_count bigint, outlier_pct double, lower_bound double, "
    "upper_bound double, mean double, median double, std double, min double, max double, "
    "skewness double, kurtosis double"
)


@dataclass(frozen=True)
class Bounds:
    """Fitted limits of one column.

    ``lower`` and ``upper`` are reported. With a ``center`` the test is the
    distance from it, else the limits themselves; if not ``active``, nothing
    is an outlier.
    """

    lower: float
    upper: float
    center: float | None = None
    reach: float | None = None
    active: bool = True

    def outside(self, c: Column) -> Column:
        """Filter condition for outliers; NULL for a missing value."""
        if not self.active:
            return F.lit(False)
        if self.center is not None:
            return F.abs(c - F.lit(self.center)) > F.lit(self.reach)
        return (c < F.lit(self.lower)) | (c > F.lit(self.upper))

    def is_outlier(self, c: Column) -> Column:
        """True for a present value outside the limits, else false."""
        return F.coalesce(self.outside(c), F.lit(False))


def _threshold(method: str, threshold: float | None) -> float:
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    return THRESHOLDS[method] if threshold is None else threshold


def fit_outlier_bounds(
    df: DataFrame,
    columns: list[str] | None = None,
    method: str = "iqr",
    threshold: float | None = None,
    approx: bool = False,
) -> dict[str, Bounds]:
    """Limits per numeric column; columns without values are left out."""
    return _fit(df, columns, method, threshold, approx)[0]


def _fit(df: DataFrame, columns, method: str, threshold, approx: bool):
    """Bounds per column and, where the method yields them anyway, medians."""
    t = _threshold(method, threshold)
    names = existing(df, columns) if columns is not None else numeric_columns(df)
    if not names:
        return {}, {}
    if method == "zscore":
        moments = collect_moments(df, {c: col(c) for c in names}, ["mean", "std", "std_pop"])
        fitted = {}
        for c, m in moments.items():
            if not m["count"]:
                continue
            # The test uses the population deviation, the report the sample one.
            spread = t * (m["std"] or 0.0)
            fitted[c] = Bounds(
                m["mean"] - spread,
                m["mean"] + spread,
                center=m["mean"],
                reach=t * m["std_pop"],
                active=m["std_pop"] > 0,
            )
        return fitted, None
    if method == "modified_zscore":
        medians = {
            c: v[0]
            for c, v in quantiles(df, {c: [0.5] for c in names}, approx).items()
            if v[0] is not None
        }
        if not medians:
            return {}, {}
        distances = df.select(
            *[F.abs(col(c).cast("double") - F.lit(m)).alias(c) for c, m in medians.items()]
        )
        mads = quantiles(distances, {c: [0.5] for c in medians}, approx)
        fitted = {}
        for c, m in medians.items():
            mad = mads[c][0]
            reach = t * mad / MAD_FACTOR
            fitted[c] = Bounds(m - reach, m + reach, center=m, reach=reach, active=mad > 0)
        return fitted, medians
    shares = [0.25, 0.75] if method == "iqr" else [t / 100, 1 - t / 100]
    fitted, medians = {}, {}
    for c, (low, high, median) in quantiles(
        df, {c: [*shares, 0.5] for c in names}, approx
    ).items():
        if low is None:
            continue
        medians[c] = median
        margin = t * (high - low) if method == "iqr" else 0.0
        fitted[c] = Bounds(low - margin, high + margin)
    return fitted, medians


def detect_outliers(
    df: DataFrame,
    columns: list[str] | None = None,
    method: str = "iqr",
    threshold: float | None = None,
    approx: bool = False,
) -> DataFrame:
    """Per column: outlier count, share, bounds and seven statistics."""
    bounds, medians = _fit(df, columns, method, threshold, approx)
    if medians is None:
        found = quantiles(df, {c: [0.5] for c in bounds}, approx)
        medians = {c: v[0] for c, v in found.items()}
    aggs = []
    for i, (c, b) in enumerate(bounds.items()):
        v = col(c).cast("double")
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.count_if(b.is_outlier(v)).alias(f"o{i}"),
            F.avg(v).alias(f"mean{i}"),
            F.stddev_samp(v).alias(f"std{i}"),
            F.min(v).alias(f"min{i}"),
            F.max(v).alias(f"max{i}"),
            sample_skewness(v).alias(f"skew{i}"),
            sample_kurtosis(v).alias(f"kurt{i}"),
        ]
    if not bounds:
        return df.sparkSession.createDataFrame([], REPORT_SCHEMA)
    return tidy(
        df.agg(*aggs),
        [
            {
                "column": F.lit(c),
                "outlier_count": F.col(f"o{i}"),
                "outlier_pct": percent(F.col(f"o{i}"), F.col(f"n{i}")),
                "lower_bound": F.lit(b.lower),
                "upper_bound": F.lit(b.upper),
                "mean": F.col(f"mean{i}"),
                "median": F.lit(medians[c]),
                "std": F.col(f"std{i}"),
                "min": F.col(f"min{i}"),
                "max": F.col(f"max{i}"),
                "skewness": F.col(f"skew{i}"),
                "kurtosis": F.col(f"kurt{i}"),
            }
            for i, (c, b) in enumerate(bounds.items())
        ],
    )


def outlier_summary(
    df: DataFrame, method: str = "iqr", threshold: float | None = None, approx: bool = False
) -> DataFrame:
    """The columns of ``detect_outliers`` that have outliers."""
    return detect_outliers(df, None, method, threshold, approx).where("outlier_count > 0")


def outlier_totals(
    df: DataFrame, method: str = "iqr", threshold: float | None = None, approx: bool = False
) -> DataFrame:
    """One row: columns looked at, columns with outliers, number of outliers."""
    return detect_outliers(df, None, method, threshold, approx).agg(
        F.count("*").alias("columns_analyzed"),
        F.count_if(F.col("outlier_count") > 0).alias("columns_with_outliers"),
        F.coalesce(F.sum("outlier_count"), F.lit(0)).cast("bigint").alias("total_outliers"),
    )


def outlier_rows(
    df: DataFrame,
    column: str,
    method: str = "iqr",
    threshold: float | None = None,
    approx: bool = False,
) -> DataFrame:
    """The rows whose value in ``column`` is an outlier."""
    require(df, [column])
    bounds = fit_outlier_bounds(df, [column], method, threshold, approx)
    if column not in bounds:
        return df.where(F.lit(False))
    return df.where(bounds[column].outside(col(column).cast("double")))


def outlier_samples(
    df: DataFrame,
    column: str,
    order_by: list[str],
    method: str = "iqr",
    threshold: float | None = None,
    n: int = SAMPLE_VALUES,
) -> DataFrame:
    """The first ``n`` outlier rows in the given order."""
    rows = outlier_rows(df, column, method, threshold)
    return rows.orderBy(*[col(c) for c in order_by]).limit(n)


@dataclass
class OutlierTreatment:
    """Fitted treatment of outliers, column by column."""

    actions: dict[str, str]
    bounds: dict[str, Bounds]
    clips: dict[str, tuple[float, float]]

    def _marked(self) -> Column:
        mark = F.lit(False)
        for c, action in self.actions.items():
            if action == "drop" and c in self.bounds:
                mark = mark | self.bounds[c].is_outlier(col(c).cast("double"))
        return mark

    def apply(self, df: DataFrame) -> DataFrame:
        """Drop and clip; row by row, also on a streaming DataFrame."""
        if "drop" in self.actions.values():
            df = df.where(~self._marked())
        replaced = {}
        for c, (low, high) in self.clips.items():
            v = col(c)
            # A missing value stays missing: greatest and least would skip it.
            replaced[c] = F.when(v < low, F.lit(low)).when(v > high, F.lit(high)).otherwise(v)
        return df.withColumns(replaced) if replaced else df

    def stats(self, df: DataFrame) -> DataFrame:
        """Per column: outliers found, cells changed, rows left at the end."""
        aggs = [F.count_if(~self._marked()).alias("rows_after")]
        for i, c in enumerate(self.actions):
            v = col(c).cast("double")
            found = self.bounds[c].is_outlier(v) if c in self.bounds else F.lit(False)
            aggs.append(F.count_if(found).alias(f"o{i}"))
            if c in self.clips:
                low, high = self.clips[c]
                aggs.append(F.count_if((v < low) | (v > high)).alias(f"c{i}"))
        rows = []
        for i, (c, action) in enumerate(self.actions.items()):
            clip = self.clips.get(c)
            rows.append(
                {
                    "column": F.lit(c),
                    "action": F.lit(action),
                    "outliers_found": F.lit(0).cast("bigint")
                    if action == "keep"
                    else F.col(f"o{i}"),
                    "cells_clipped": F.col(f"c{i}") if clip else F.lit(0).cast("bigint"),
                    "lower_bound": F.lit(clip[0] if clip else None).cast("double"),
                    "upper_bound": F.lit(clip[1] if clip else None).cast("double"),
                    "rows_after": F.col("rows_after"),
                }
            )
        return tidy(df.agg(*aggs), rows)


def fit_outlier_treatment(
    df: DataFrame,
    config: dict[str, dict[str, Any]],
    method: str = "iqr",
    threshold: float | None = None,
    approx: bool = False,
) -> OutlierTreatment:
    """Limits for the columns to drop from or to clip.

    Every column is treated on its own values, so all are fitted together.
    """
    config = {c: conf for c, conf in config.items() if c in df.columns}
    actions = {c: conf.get("action", "keep") for c, conf in config.items()}
    for action in actions.values():
        if action not in ("keep", "drop", "winsorize"):
            raise ValueError(f"action must be keep, drop or winsorize, not {action!r}")
    active = [c for c, a in actions.items() if a != "keep"]
    bounds = fit_outlier_bounds(df, active, method, threshold, approx) if active else {}
    shares = {
        c: [config[c].get("lower_pct", 1) / 100, config[c].get("upper_pct", 99) / 100]
        for c, a in actions.items()
        if a == "winsorize"
    }
    clips = {
        c: (v[0], v[1])
        for c, v in quantiles(df, shares, approx).items()
        if v[0] is not None
    }
    return OutlierTreatment(actions, bounds, clips)


def resolve_outliers(
    df: DataFrame,
    config: dict[str, dict[str, Any]],
    method: str = "iqr",
    threshold: float | None = None,
    approx: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Treated table and one row of statistics per column."""
    fitted = fit_outlier_treatment(df, config, method, threshold, approx)
    return fitted.apply(df), fitted.stats(df)
