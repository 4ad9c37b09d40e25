"""Moment statistics with the sample corrections that pandas users expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_skewness(c: Column) -> Column:
    """Bias-corrected skewness; NULL below 3 values and on constant columns."""
    n = F.count(c).cast("double")
    factor = F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(n >= 3, F.skewness(c) * factor)


def sample_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis; NULL below 4 values and on constant columns."""
    n = F.count(c).cast("double")
    factor = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when(n >= 4, factor * ((n + 1) * F.kurtosis(c) + 6))


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation over rows where both are present, NULL if constant."""
    both_a = F.when(b.isNotNull(), a)
    both_b = F.when(a.isNotNull(), b)
    spread = F.stddev_samp(both_a) * F.stddev_samp(both_b)
    return F.try_divide(F.covar_samp(a, b), spread)


MOMENTS = {
    "count": F.count,
    "mean": F.avg,
    "std": F.stddev_samp,
    "std_pop": F.stddev_pop,
    "min": F.min,
    "max": F.max,
    "skewness": sample_skewness,
    "kurtosis": sample_kurtosis,
}


def collect_moments(
    df: DataFrame, columns: dict[str, Column], wanted: list[str] | None = None
) -> dict[str, dict[str, float]]:
    """Moments of the given expressions from one aggregation over ``df``.

    The number of missing values is always included.
    """
    names = list(dict.fromkeys(["count", *(wanted or MOMENTS)]))
    if not columns:
        return {}
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(columns.values()):
        aggs += [MOMENTS[m](c.cast("double")).alias(f"m{i}_{m}") for m in names]
    row = df.agg(*aggs).first()
    return {
        name: {
            **{m: row[f"m{i}_{m}"] for m in names},
            "missing": row["rows"] - row[f"m{i}_count"],
        }
        for i, name in enumerate(columns)
    }
