"""Distribution statistics and chart data: histograms, density, boxes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.columns import (
    col,
    distinct_key,
    numeric_columns,
    require,
    string_columns,
)
from grainmill.functions.moments import collect_moments
from grainmill.operators.outliers import Bounds, fit_outlier_bounds
from grainmill.plans.counts import top_values, value_counts
from grainmill.plans.quantiles import quantiles

# Reported percentiles, list lengths, bin and grid counts.
PERCENTILES = [1, 5, 25, 50, 75, 95, 99]
TOP_TEN, TOP_TWENTY = 10, 20
BINS = 30
GRID_POINTS = 100
DENSITY_MIN_VALUES = 11
DENSITY_ORDER = 16
STATISTICS = ["mean", "median", "std", "min", "max", "skewness", "kurtosis"]


def distribution_stats(df: DataFrame, column: str, approx: bool = False) -> DataFrame:
    """Long form: moments and percentiles of the present values."""
    return _describe(df, column, approx).where("metric != 'missing'")


def _describe(df: DataFrame, column: str, approx: bool) -> DataFrame:
    require(df, [column])
    moments = collect_moments(df, {column: col(column)})[column]
    shares = [p / 100 for p in PERCENTILES]
    found = quantiles(df, {column: shares}, approx)[column]
    rows = [("count", float(moments["count"])), ("missing", float(moments["missing"]))]
    rows += [(m, moments[m]) for m in ("mean", "std", "min", "max", "skewness", "kurtosis")]
    rows += [("median", found[PERCENTILES.index(50)])]
    rows += [(f"{p}%", v) for p, v in zip(PERCENTILES, found)]
    return df.sparkSession.createDataFrame(rows, "metric string, value double")


def inspect_numeric(df: DataFrame, column: str, approx: bool = False) -> DataFrame:
    """Moments, percentiles and the number of missing values."""
    return _describe(df, column, approx).where("metric != 'count'")


def categorical_stats(df: DataFrame, column: str, limit: int = TOP_TEN) -> DataFrame:
    """Most frequent values with the number of distinct and missing ones."""
    require(df, [column])
    counts = value_counts(df, [column])
    top = top_values(counts, limit).drop("column")
    size = df.agg(
        F.count_distinct(distinct_key(df, column)).alias("unique_count"),
        F.count_if(col(column).isNull()).alias("missing_count"),
    ).first()
    return top.select(
        "rank",
        "value",
        "n",
        (F.col("rank") == 1).alias("is_mode"),
        F.lit(size["unique_count"]).cast("bigint").alias("unique_count"),
        F.lit(size["missing_count"]).cast("bigint").alias("missing_count"),
    )


def inspect_categorical(df: DataFrame, column: str) -> DataFrame:
    return categorical_stats(df, column, TOP_TWENTY)


def numeric_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Mean, median, deviation, skewness and missing count per numeric column."""
    names = columns or numeric_columns(df)
    moments = collect_moments(df, {c: col(c) for c in names}, ["mean", "std", "skewness"])
    medians = quantiles(df, {c: [0.5] for c in names})
    return df.sparkSession.createDataFrame(
        [
            (c, m["mean"], medians[c][0], m["std"], m["skewness"], m["missing"])
            for c, m in moments.items()
        ],
        "column string, mean double, median double, std double, skewness double, missing bigint",
    )


def bin_number(c: Column, low: float, high: float, bins: int) -> Column:
    """Equal-width bin from 0; the last one includes the upper end."""
    if high == low:
        # One value: centred in a range of width 1.
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    number = F.floor((c.cast("double") - F.lit(low)) / F.lit(width)).cast("int")
    return F.least(number, F.lit(bins - 1))


def _edges(low: float, high: float, bins: int) -> tuple[float, float]:
    if high == low:
        low, high = low - 0.5, high + 0.5
    return low, (high - low) / bins


def _ranges(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(
        *[F.min(col(c)).cast("double").alias(f"l{i}") for i, c in enumerate(columns)],
        *[F.max(col(c)).cast("double").alias(f"h{i}") for i, c in enumerate(columns)],
    ).first()
    return {
        c: (row[f"l{i}"], row[f"h{i}"])
        for i, c in enumerate(columns)
        if row[f"l{i}"] is not None
    }


def _binned(df: DataFrame, ranges: dict[str, tuple[float, float]], bins: int) -> dict:
    """Rows per column and bin, from one pre-aggregated shuffle."""
    numbers = F.array(*[bin_number(col(c), *r, bins) for c, r in ranges.items()])
    long = df.select(F.posexplode(numbers).alias("i", "bin")).where("bin IS NOT NULL")
    counted = long.groupBy("i", "bin").agg(F.count("*").alias("n"))
    return {(r["i"], r["bin"]): r["n"] for r in counted.collect()}


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """Equal-width bins with their edges and counts, empty ones included."""
    require(df, [column])
    return histogram_multi(df, [column], bins).drop("column")


def histogram_multi(
    df: DataFrame, columns: list[str] | None = None, bins: int = BINS
) -> DataFrame:
    """Histograms of several columns, by default of all numeric ones, from one pass.

    See ``category_bars`` for text columns.
    """
    names = require(df, columns if columns is not None else numeric_columns(df))
    numbers = set(numeric_columns(df))
    ranges = _ranges(df, [c for c in names if c in numbers])
    counts = _binned(df, ranges, bins) if ranges else {}
    rows = []
    for i, (c, (low, high)) in enumerate(ranges.items()):
        start, width = _edges(low, high, bins)
        rows += [
            (c, b, start + b * width, start + (b + 1) * width, counts.get((i, b), 0))
            for b in range(bins)
        ]
    return df.sparkSession.createDataFrame(
        rows, "column string, bin bigint, bin_start double, bin_end double, n bigint"
    )


def category_bars(df: DataFrame, columns: list[str], limit: int = BINS) -> DataFrame:
    """Most frequent values of text columns, the bars shown beside histograms."""
    texts = [c for c in columns if c in string_columns(df)]
    return top_values(value_counts(df, texts), limit)


def histogram_compare(
    before: DataFrame, after: DataFrame, column: str, bins: int = BINS
) -> DataFrame:
    """Two states of a column over a shared range of bins."""
    states = [("before", before), ("after", after)]
    found = [_ranges(frame, [column]).get(column) for _, frame in states]
    found = [r for r in found if r]
    if not found:
        raise ValueError(f"{column!r} has no values")
    low, high = min(r[0] for r in found), max(r[1] for r in found)
    tagged = before.select(F.lit("before").alias("state"), col(column).alias("v")).unionByName(
        after.select(F.lit("after").alias("state"), col(column).alias("v"))
    )
    counted = (
        tagged.where("v IS NOT NULL")
        .groupBy("state", bin_number(F.col("v"), low, high, bins).alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    counts = {(r["state"], r["bin"]): r["n"] for r in counted.collect()}
    start, width = _edges(low, high, bins)
    return before.sparkSession.createDataFrame(
        [
            (s, b, start + b * width, start + (b + 1) * width, counts.get((s, b), 0))
            for s, _ in states
            for b in range(bins)
        ],
        "state string, bin bigint, bin_start double, bin_end double, n bigint",
    )


def _density_cells(
    df: DataFrame, column: str, low: float, high: float, bandwidth: float, bins: int
) -> tuple[dict[int, list[float]], int]:
    """Per filled cell the power sums of the distances from its centre, in bandwidths; the tallest bin."""
    v = col(column).cast("double")
    place = (v - F.lit(low)) / F.lit(bandwidth)
    cell = F.floor(place)
    rows = df.where(v.isNotNull()).select(
        cell.alias("cell"), bin_number(v, low, high, bins).alias("bin"), (place - cell - 0.5).alias("t1")
    )
    # Each power from two smaller ones, in projections of their own.
    have = 1
    while have < DENSITY_ORDER:
        new = range(have + 1, min(2 * have, DENSITY_ORDER) + 1)
        rows = rows.withColumns({f"t{k}": F.col(f"t{have}") * F.col(f"t{k - have}") for k in new})
        have = new[-1]
    powers = [f"t{k}" for k in range(1, DENSITY_ORDER + 1)]
    found = rows.groupBy("cell", "bin").agg(F.count("*").alias("n"), *[F.sum(p).alias(p) for p in powers]).collect()
    cells: dict[int, list[float]] = {}
    heights: dict[int, int] = {}
    for r in found:
        own = cells.setdefault(r["cell"], [0.0] * (DENSITY_ORDER + 1))
        for k, value in enumerate([r["n"], *[r[p] for p in powers]]):
            own[k] += value
        heights[r["bin"]] = heights.get(r["bin"], 0) + r["n"]
    return cells, max(heights.values())


def kernel_density(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """Gaussian density at 100 points, also scaled to the histogram's height.

    Fast Gauss transform: values are summed up in cells as wide as the bandwidth,
    as power sums of their distance t from the centre, |t| <= 1/2. At a point
    y bandwidths from the centre the kernels of a cell are
    ``exp(-y^2 / 2) * sum(He_k(y) / k! * sum(t^k))`` with Hermite polynomials He_k.
    By Cramer's inequality the terms beyond order K = DENSITY_ORDER add less than
    ``1.1 * sum(2^-k / sqrt(k!), k > K)``, below 1e-12, of the largest possible
    density. The rows are read twice, for the range and for the cells, whatever
    the number of points. Of n values at most about n^0.5 cells are filled
    (Chebyshev), which is all that reaches the driver.
    """
    require(df, [column])
    spark = df.sparkSession
    schema = "point bigint, x double, density double, scaled double"
    m = collect_moments(df, {column: col(column)}, ["std", "min", "max"])[column]
    if m["count"] < DENSITY_MIN_VALUES or not m["std"]:
        return spark.createDataFrame([], schema)
    n = m["count"]
    bandwidth = n ** (-1 / 5) * m["std"]
    step = (m["max"] - m["min"]) / (GRID_POINTS - 1)
    grid = [m["min"] + i * step for i in range(GRID_POINTS)]
    cells, tallest = _density_cells(df, column, m["min"], m["max"], bandwidth, bins)
    centres = np.array(list(cells), float) + 0.5
    sums = np.array(list(cells.values()))
    density = np.zeros(GRID_POINTS)
    for i in range(GRID_POINTS):
        y = i * step / bandwidth - centres
        near = np.abs(y) < 40  # beyond that a kernel is 0 in double precision
        y, own = y[near], sums[near]
        before, polynomial, total = np.zeros_like(y), np.ones_like(y), own[:, 0].copy()
        for k in range(1, DENSITY_ORDER + 1):
            # He_k / k! from its two predecessors.
            before, polynomial = polynomial, (y * polynomial - before) / k
            total += polynomial * own[:, k]
        density[i] = max(0.0, float(np.exp(-0.5 * y * y) @ total))
    density /= n * bandwidth * math.sqrt(2 * math.pi)
    scale = tallest / density.max() if density.max() > 0 else 1.0
    return spark.createDataFrame(
        [(i, grid[i], float(d), float(d * scale)) for i, d in enumerate(density)], schema
    )


def boxplot(df: DataFrame, column: str, approx: bool = False) -> DataFrame:
    """Quartiles, whisker ends and the number of points beyond the whiskers."""
    require(df, [column])
    q1, median, q3 = quantiles(df, {column: [0.25, 0.5, 0.75]}, approx)[column]
    if q1 is None:
        raise ValueError(f"{column!r} has no values")
    fences = Bounds(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    v = col(column).cast("double")
    outside = fences.is_outlier(v)
    return df.agg(
        F.min(F.when(~outside, v)).alias("lower_whisker"),
        F.max(F.when(~outside, v)).alias("upper_whisker"),
        F.count_if(outside).alias("outlier_count"),
    ).select(
        F.lit(q1).alias("q1"),
        F.lit(median).alias("median"),
        F.lit(q3).alias("q3"),
        "lower_whisker",
        "upper_whisker",
        "outlier_count",
    )


def boxplot_points(df: DataFrame, column: str) -> DataFrame:
    """The points beyond the whiskers."""
    q1, q3 = quantiles(df, {column: [0.25, 0.75]})[column]
    fences = Bounds(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return df.where(fences.is_outlier(col(column).cast("double")))


def boxplot_bounds(
    df: DataFrame, column: str, method: str = "iqr", threshold: float | None = None
) -> DataFrame:
    """Box data together with the outlier bounds of a detection method."""
    b = fit_outlier_bounds(df, [column], method, threshold)[column]
    return boxplot(df, column).select(
        "*", F.lit(b.lower).alias("lower_bound"), F.lit(b.upper).alias("upper_bound")
    )


def compare_distributions(
    before: DataFrame, after: DataFrame, columns: list[str] | None = None
) -> DataFrame:
    """Statistics of the common numeric columns in two states and the change."""
    shared = [c for c in numeric_columns(before) if c in set(numeric_columns(after))]
    names = [c for c in shared if columns is None or c in columns]
    # Both states side by side, so that one fit covers them.
    states = (("before", before), ("after", after))
    tagged = [
        frame.select(
            *[
                (col(c).cast("double") if own == state else F.lit(None).cast("double")).alias(f"{own} {c}")
                for own, _ in states
                for c in names
            ]
        )
        for state, frame in states
    ]
    both = tagged[0].unionAll(tagged[1])
    moments = collect_moments(both, {c: col(c) for c in both.columns})
    medians = quantiles(both, {c: [0.5] for c in both.columns})
    stats = [
        {c: {**moments[f"{own} {c}"], "median": medians[f"{own} {c}"][0]} for c in names}
        for own, _ in states
    ]
    rows = []
    for c in names:
        for metric in STATISTICS:
            a, b = stats[0][c][metric], stats[1][c][metric]
            change = None
            if a is not None and b is not None:
                change = (b - a) / abs(a) * 100 if a else 0.0
            rows.append((c, metric, a, b, change))
    return before.sparkSession.createDataFrame(
        rows, "column string, metric string, before double, after double, change_pct double"
    )
