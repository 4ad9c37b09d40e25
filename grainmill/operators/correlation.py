"""Correlation, variance inflation and what to do about related columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql import functions as F

from grainmill.functions.columns import col, existing, numeric_columns
from grainmill.functions.moments import collect_moments, safe_corr
from grainmill.plans.gram import gram_matrix, standardized
from grainmill.plans.ranks import kendall_matrix, spearman_matrix

METHODS = ("pearson", "spearman", "kendall")
# Limits for strong pairs, the default thresholds and the VIF grades.
MODERATE, HIGH = 0.7, 0.9
PAIR_THRESHOLD = 0.90
VIF_THRESHOLD = 10.0
VIF_GRADES = [(20, "very_high"), (10, "high"), (5, "moderate")]
# Doubtful pairs that one aggregation covers; more take further passes of the same kind.
PAIRS_A_PASS = 100
# Below this share of its square a sum of squared deviations is computed anew.
DOUBTFUL = 1e-6
# Eigenvalues of a correlation matrix that count as 0, per column, and the part of
# a column in their space from which it counts as determined by others.
SINGULAR, DETERMINED = 1e-13, 1e-8

PAIR_SCHEMA = "column1 string, column2 string, r double"


def _pair_keys(columns: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]


def _complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    kept = df.select(*[col(c).cast("double").alias(c) for c in columns])
    for c in columns:
        kept = kept.where(col(c).isNotNull())
    return kept


def _chosen(df: DataFrame, columns: list[str] | None) -> list[str]:
    names = existing(df, columns) if columns is not None else numeric_columns(df)
    for c in names:
        dtype = df.schema[c].dataType
        if not isinstance(dtype, (T.NumericType, T.BooleanType)):
            raise ValueError(f"{c!r} is not numeric but {dtype.simpleString()}")
    return names


def _in_passes(df: DataFrame, aggs: list[Column]) -> dict[str, float | None]:
    """The aggregates, PAIRS_A_PASS at a time."""
    row: dict[str, float | None] = {}
    for k in range(0, len(aggs), PAIRS_A_PASS):
        row |= df.agg(*aggs[k : k + PAIRS_A_PASS]).first().asDict()
    return row


def fit_correlations(
    df: DataFrame, columns: list[str], method: str = "pearson"
) -> dict[tuple[str, str], float | None]:
    """Correlation per pair over the rows without a missing value.

    ``None`` where a column is constant.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    if len(columns) < 2:
        raise ValueError("correlation takes two or more numeric columns")
    rows = _complete_rows(df, columns)
    pairs = _pair_keys(columns)
    if method in ("spearman", "kendall"):
        found = (spearman_matrix if method == "spearman" else kendall_matrix)(rows, columns)
        return {p: found.get(p) for p in pairs}
    # Standardized first, so that neither large means nor tiny spreads lose digits.
    moments = collect_moments(rows, {c: col(c) for c in columns}, ["mean", "std", "min", "max"])
    varies = {c: bool(m["std"]) and m["min"] < m["max"] for c, m in moments.items()}
    spread = {c: m["std"] if varies[c] else None for c, m in moments.items()}
    if not any(varies.values()):
        return dict.fromkeys(pairs)
    gram = gram_matrix(rows, [standardized(col(c), moments[c]["mean"], spread[c]) for c in columns])
    size = np.sqrt(np.diag(gram))
    place = {c: i for i, c in enumerate(columns)}
    result = {}
    for a, b in pairs:
        i, j = place[a], place[b]
        result[a, b] = float(gram[i, j] / (size[i] * size[j])) if varies[a] and varies[b] else None
    return result


def correlation_matrix(
    df: DataFrame, columns: list[str] | None = None, method: str = "pearson"
) -> DataFrame:
    """Long form, one row per pair of columns, at four decimals."""
    found = fit_correlations(df, _chosen(df, columns), method)
    rows = [(a, b, r) for (a, b), r in found.items()]
    return df.sparkSession.createDataFrame(rows, PAIR_SCHEMA).withColumn("r", F.round("r", 4))


def high_correlation_pairs(
    df: DataFrame,
    columns: list[str] | None = None,
    method: str = "pearson",
    limit: int | None = None,
) -> DataFrame:
    """The strong pairs, strongest first, with their strength and their number."""
    found = fit_correlations(df, _chosen(df, columns), method)
    strong = [
        (a, b, round(r, 4), "high" if abs(r) > HIGH else "moderate")
        for (a, b), r in found.items()
        if r is not None and abs(r) > MODERATE
    ]
    strong.sort(key=lambda row: (-abs(row[2]), row[0], row[1]))
    rows = [(i + 1, *row, len(strong)) for i, row in enumerate(strong[:limit])]
    return df.sparkSession.createDataFrame(
        rows,
        "rank bigint, column1 string, column2 string, correlation double, "
        "strength string, total_high_correlations bigint",
    )


def pairwise_correlations(
    df: DataFrame, columns: list[str] | None = None, threshold: float = 0.0
) -> DataFrame:
    """Full matrix in long form; each pair uses the rows where both are present.

    Cells below the threshold are blanked.
    """
    names = _chosen(df, columns)
    moments = collect_moments(df, {c: col(c) for c in names}, ["mean", "std"])
    gaps = [c for c in names if moments[c]["missing"]]
    away = [standardized(col(c).cast("double"), moments[c]["mean"], moments[c]["std"]) for c in names]
    present = [col(c).isNotNull().cast("double") for c in gaps]
    size = len(names)
    # Besides the values their squares and presence, if cells are missing, and a constant.
    squares = [v * v for v in away] if gaps else []
    present = [col(c).isNotNull().cast("double") for c in gaps]
    parts = [*away, *squares, *present, F.lit(1.0)]
    one = len(parts) - 1
    mask = {c: size + len(squares) + i for i, c in enumerate(gaps)}
    varying = [c for c in names if moments[c]["std"]]
    gram = gram_matrix(df, parts) if varying else None
    cells: dict[tuple[str, str], float | None] = {(c, c): 1.0 if moments[c]["std"] else None for c in names}
    doubtful = []
    for i, a in enumerate(names):
        for j, b in list(enumerate(names))[i + 1 :]:
            r = None
            if moments[a]["std"] and moments[b]["std"]:
                # Over the rows in which both are present; a missing value is a 0.
                other = mask.get(b, one), mask.get(a, one)
                n = gram[other]
                sums = gram[i, other[0]], gram[j, other[1]]
                square = [gram[size + x, o] if gaps else gram[x, x] for x, o in zip((i, j), other, strict=True)]
                left = [q - t * t / n if n else 0.0 for q, t in zip(square, sums, strict=True)]
                if any(v <= DOUBTFUL * q for v, q in zip(left, square, strict=True)):
                    doubtful.append((a, b))  # nearly constant where the other one is present
                else:
                    r = float((gram[i, j] - sums[0] * sums[1] / n) / math.sqrt(left[0] * left[1]))
            cells[a, b] = cells[b, a] = r
    exact = [safe_corr(col(a).cast("double"), col(b).cast("double")).alias(f"p{k}") for k, (a, b) in enumerate(doubtful)]
    row = _in_passes(df, exact)
    for k, (a, b) in enumerate(doubtful):
        cells[a, b] = cells[b, a] = row[f"p{k}"]

    def shown(r: float | None) -> float | None:
        return None if r is None or abs(r) < threshold else r

    rows = [(a, b, shown(cells[a, b])) for a in names for b in names]
    return df.sparkSession.createDataFrame(rows, PAIR_SCHEMA)


def categorize_vif(vif: float) -> str:
    for limit, grade in VIF_GRADES:
        if math.isinf(vif) or vif > limit:
            return grade
    return "ok"


def _many_valued(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with more than two values: some value lies between the extremes."""
    ends = df.agg(
        *[F.min(col(c)).alias(f"l{i}") for i, c in enumerate(columns)],
        *[F.max(col(c)).alias(f"h{i}") for i, c in enumerate(columns)],
    ).first()
    between = df.agg(
        *[
            F.coalesce(
                F.bool_or((col(c) > F.lit(ends[f"l{i}"])) & (col(c) < F.lit(ends[f"h{i}"]))),
                F.lit(False),
            ).alias(f"b{i}")
            for i, c in enumerate(columns)
        ]
    ).first()
    return [c for i, c in enumerate(columns) if between[f"b{i}"]]


def fit_vif(
    df: DataFrame, columns: list[str] | None = None, include_binary: bool = False
) -> dict[str, float]:
    """Variance inflation per column, unrounded; infinite if determined by others.

    Two passes give the correlations; the rest is one decomposition of a matrix
    with one row per column.
    """
    names = _chosen(df, columns)
    if len(names) < 2:
        raise ValueError("variance inflation takes two or more columns")
    if not include_binary:
        names = _many_valued(df, names)
    if not names:
        return {}
    rows = _complete_rows(df, names)
    if rows.limit(len(names)).count() < len(names):
        raise ValueError("fewer complete rows than columns")
    if len(names) == 1:
        return {names[0]: 1.0}
    found = fit_correlations(rows, names)
    size = len(names)
    place = {c: i for i, c in enumerate(names)}
    matrix = np.eye(size)
    for (a, b), r in found.items():
        i, j = place[a], place[b]
        matrix[i, j] = matrix[j, i] = 0.0 if r is None else r
    # One decomposition: the diagonal of the (pseudo-)inverse.
    values, vectors = np.linalg.eigh(matrix)
    null = values <= SINGULAR * size
    determined = (vectors[:, null] ** 2).sum(axis=1) > DETERMINED
    inflation = (vectors[:, ~null] ** 2 / values[~null]).sum(axis=1)
    return {c: math.inf if determined[i] else max(1.0, float(inflation[i])) for i, c in enumerate(names)}


def _rounded_vif(vif: dict[str, float]) -> list[tuple[str, float, str]]:
    rows = [
        (c, v if math.isinf(v) else round(v, 2), categorize_vif(v)) for c, v in vif.items()
    ]
    return sorted(rows, key=lambda r: -r[1])


def calculate_vif(
    df: DataFrame, columns: list[str] | None = None, include_binary: bool = False
) -> DataFrame:
    """Variance inflation per column with its grade, highest first."""
    rows = _rounded_vif(fit_vif(df, columns, include_binary))
    high = sum(1 for r in rows if r[2] in ("high", "very_high"))
    return df.sparkSession.createDataFrame(
        [(i + 1, *r, high) for i, r in enumerate(rows)],
        "rank bigint, column string, vif double, status string, high_vif_count bigint",
    )


def vif_display(
    df: DataFrame, columns: list[str] | None = None, threshold: float = VIF_THRESHOLD
) -> DataFrame:
    """Chart data: variance inflation cut at 100 and whether it is too high."""
    return calculate_vif(df, columns).select(
        "column",
        F.least("vif", F.lit(100.0)).alias("display_vif"),
        (F.col("vif") > threshold).alias("over_threshold"),
    )


@dataclass
class Multicollinearity:
    pairs: list[tuple[str, str, float]]
    high_vif: list[tuple[str, float, str]]
    recommendations: list[tuple[str, str, str]]
    columns_analyzed: int

    def summary_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(
            [
                (
                    self.columns_analyzed,
                    len(self.pairs),
                    len(self.high_vif),
                    len(self.recommendations),
                )
            ],
            "columns_analyzed bigint, high_correlation_count bigint, high_vif_count bigint, "
            "columns_recommended_for_removal bigint",
        )

    def recommendations_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(
            self.recommendations, "action string, column string, reason string"
        )

    def pairs_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(
            self.pairs, "column1 string, column2 string, correlation double"
        )


def detect_multicollinearity(
    df: DataFrame,
    correlation_threshold: float = PAIR_THRESHOLD,
    vif_threshold: float = VIF_THRESHOLD,
    columns: list[str] | None = None,
) -> Multicollinearity:
    """Strong pairs, inflated columns and which columns to drop.

    Pairs are compared at four decimals. Of a pair the column with the higher
    VIF goes, the second one if that does not decide; a column already
    recommended settles its other pairs.
    """
    names = _chosen(df, columns)
    found = fit_correlations(df, names) if len(names) > 1 else {}
    pairs = [
        (a, b, round(r, 4))
        for (a, b), r in found.items()
        if r is not None and abs(round(r, 4)) > correlation_threshold
    ]
    try:
        vifs = _rounded_vif(fit_vif(df, names))
    except ValueError:
        vifs = []
    known = {c: v for c, v, _ in vifs}
    recommendations: list[tuple[str, str, str]] = []
    gone: set[str] = set()
    for a, b, r in pairs:
        if a in gone or b in gone:
            continue
        drop, keep = (a, b) if known.get(a, 0) > known.get(b, 0) else (b, a)
        # Fixed format of the reason.
        recommendations.append(("drop", drop, f"High correlation ({r:.2f}) with {keep}"))
        gone.add(drop)
    return Multicollinearity(
        pairs, [v for v in vifs if v[1] > vif_threshold], recommendations, len(names)
    )


def resolve_multicollinearity(
    df: DataFrame,
    actions: dict[str, str],
    combine_formulas: dict[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Drop and flag columns, then add columns from SQL formulas.

    Formulas see the columns that are left. A division by zero gives NULL if
    written as ``try_divide(a, b)``.
    """
    for action in actions.values():
        if action not in ("drop", "keep", "flag"):
            raise ValueError(f"action must be drop, keep or flag, not {action!r}")
    done: list[tuple] = []
    drops = [c for c, a in actions.items() if a == "drop" and c in df.columns]
    df = df.drop(*drops)
    done += [("drop", c, None, None) for c in drops]
    for c, a in actions.items():
        if a == "flag" and c in df.columns:
            df = df.withColumn(f"{c}_multicollinear_flag", F.lit(True))
            done.append(("flag", c, None, None))
    for name, formula in (combine_formulas or {}).items():
        try:
            df = df.withColumn(name, F.expr(formula))
            df.schema  # noqa: B018  resolves the formula, runs nothing
            done.append(("combine", name, formula, None))
        except AnalysisException as error:
            done.append(("combine", name, formula, error.getCondition()))
    stats = df.sparkSession.createDataFrame(
        [(*d, len(df.columns)) for d in done],
        "action string, column string, formula string, error string, remaining_columns bigint",
    )
    return df, stats
