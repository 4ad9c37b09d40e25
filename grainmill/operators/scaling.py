"""Scaling of numeric columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.columns import col, existing, numeric_columns, require
from grainmill.functions.moments import collect_moments
from grainmill.plans.quantiles import quantiles

METHODS = ("standard", "minmax", "robust")


@dataclass
class Scaling:
    """Fitted parameters; a scaled value is ``(x - shift) / size``."""

    method: str
    params: dict[str, dict[str, float]] = field(default_factory=dict)

    def shift_and_size(self, column: str) -> tuple[float, float]:
        p = self.params[column]
        if self.method == "standard":
            return p["mean"], p["std"]
        if self.method == "minmax":
            return p["min"], p["max"] - p["min"]
        return p["median"], p["q3"] - p["q1"]

    def scaled(self, column: str) -> Column:
        shift, size = self.shift_and_size(column)
        return (col(column).cast("double") - F.lit(shift)) / F.lit(size)

    def apply(self, df: DataFrame) -> DataFrame:
        """Scale; missing stays missing. Works row by row, also on a stream."""
        return df.select(
            *[self.scaled(c).alias(c) if c in self.params else col(c) for c in df.columns]
        )

    def params_frame(self, spark) -> DataFrame:
        rows = [(c, k, v) for c, p in self.params.items() for k, v in p.items()]
        return spark.createDataFrame(rows, "column string, parameter string, value double")


def fit_scaling(
    df: DataFrame,
    method: str = "standard",
    columns: list[str] | None = None,
    approx: bool = False,
) -> Scaling:
    """Parameters per numeric column; constant and empty columns are left out."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    names = existing(df, columns) if columns is not None else numeric_columns(df)
    fitted = Scaling(method)
    if method == "robust":
        for c, (q1, median, q3) in quantiles(
            df, {c: [0.25, 0.5, 0.75] for c in names}, approx
        ).items():
            if q1 is not None and q3 != q1:
                fitted.params[c] = {"median": median, "q1": q1, "q3": q3}
        return fitted
    wanted = ["mean", "std", "min", "max"] if method == "standard" else ["min", "max"]
    for c, m in collect_moments(df, {c: col(c) for c in names}, wanted).items():
        if not m["count"] or m["min"] == m["max"]:
            continue
        if method == "standard":
            fitted.params[c] = {"mean": m["mean"], "std": m["std"]}
        else:
            fitted.params[c] = {"min": m["min"], "max": m["max"]}
    return fitted


def apply_scaling(
    df: DataFrame, method: str = "standard", columns: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Scaled table and the parameters used."""
    fitted = fit_scaling(df, method, columns)
    return fitted.apply(df), fitted.params_frame(df.sparkSession)


def scaling_preview(df: DataFrame, column: str, method: str = "standard") -> DataFrame:
    """Range, mean and deviation of a column before and after scaling."""
    require(df, [column])
    if column not in numeric_columns(df):
        raise ValueError(f"{column!r} has no numbers to scale")
    fitted = fit_scaling(df, method, [column])
    before = col(column).cast("double")
    after = fitted.scaled(column) if column in fitted.params else F.lit(None).cast("double")
    stages = df.select(
        F.explode(
            F.array(
                F.struct(F.lit("before").alias("stage"), before.alias("v")),
                F.struct(F.lit("after").alias("stage"), after.alias("v")),
            )
        ).alias("s")
    ).select("s.stage", "s.v")
    return stages.groupBy("stage").agg(
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
    )
