"""Summary report of a prepared table."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.functions.columns import col, numeric_columns
from grainmill.plans.quantiles import quantiles


def prep_report(df: DataFrame, config: dict[str, Any] | None = None) -> DataFrame:
    """Long form: section, position, column, metric and value as text.

    Size, column types, missing counts and shares, statistics of the numeric
    columns at two decimals, and the configuration.
    """
    numbers = numeric_columns(df)
    medians = quantiles(df, {c: [0.5] for c in numbers})
    aggs = [F.count("*").alias("rows")]
    aggs += [F.count(col(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]
    for i, c in enumerate(numbers):
        v = col(c).cast("double")
        aggs += [
            F.avg(v).alias(f"mean{i}"),
            F.stddev_samp(v).alias(f"std{i}"),
            F.min(v).alias(f"min{i}"),
            F.max(v).alias(f"max{i}"),
        ]
    row = df.agg(*aggs).first()

    def shown(value: float | None) -> str | None:
        return None if value is None else f"{value:.2f}"

    total = row["rows"]
    lines = [
        ("summary", None, "rows", str(total)),
        ("summary", None, "columns", str(len(df.columns))),
    ]
    lines += [
        ("types", f.name, "type", f.dataType.simpleString())
        for f in df.schema.fields
    ]
    for i, c in enumerate(df.columns):
        missing = total - row[f"n{i}"]
        if missing:
            lines.append(("missing", c, "missing_count", str(missing)))
            lines.append(("missing", c, "missing_pct", shown(missing / total * 100)))
    for i, c in enumerate(numbers):
        lines += [("numeric", c, m, shown(row[f"{m}{i}"])) for m in ("mean", "std", "min", "max")]
        lines.append(("numeric", c, "median", shown(medians[c][0])))
    if config is not None:
        lines.append(("config", None, "json", json.dumps(config, indent=2, default=str)))
    return df.sparkSession.createDataFrame(
        lines, "section string, column string, metric string, value string"
    )


def as_markdown(report: DataFrame) -> str:
    """The report as text; its size depends on the number of columns only."""
    parts: list[str] = []
    section = None
    for r in report.collect():
        if r["section"] != section:
            section = r["section"]
            parts += ["", f"## {section.capitalize()}", ""]
        label = f"{r['column']} {r['metric']}" if r["column"] else r["metric"]
        parts.append(f"- {label}: {r['value']}")
    return "\n".join(["# Data preparation report", *parts, ""])
