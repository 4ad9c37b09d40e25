"""Exact quantiles over any number of rows.

``percentile`` keeps every distinct value of a column in one task. Here a
first aggregation counts values in coarse logarithmic bins, which also yields
each bin's exact bounds. Only the bins that hold a wanted rank are looked at
again: big ones are cut into finer bins, small ones go to ``percentile``. All
shuffles are pre-aggregated and the driver sees bin counts only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.columns import col

BINS_PER_OCTAVE = 32
FINE_BINS = 4096
# Values that one ``percentile`` buffer may hold.
DIRECT_VALUES = 1_000_000
# Range of the binary exponent of a double, subnormals included.
EXPONENT_LIMIT = 1100.0


@dataclass
class _Segment:
    """A run of consecutive values of one column that holds wanted ranks."""

    column: int
    low: float
    high: float
    size: int
    ranks: set[int] = field(default_factory=set)
    start: int = 0


def _coarse_bin(v: Column) -> Column:
    """Monotone bin number: sign and a fraction of the binary exponent."""
    exponent = F.greatest(
        F.least(F.log2(F.abs(v)), F.lit(EXPONENT_LIMIT)), F.lit(-EXPONENT_LIMIT)
    )
    magnitude = F.floor((exponent + EXPONENT_LIMIT) * BINS_PER_OCTAVE).cast("int") + 1
    return F.when(v == 0, 0).when(v > 0, magnitude).otherwise(-magnitude)


def _present(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v)


def _long_form(wide: DataFrame) -> DataFrame:
    """Column number and value, one row per present value."""
    values = F.posexplode(F.array(*[col(c) for c in wide.columns])).alias("column", "v")
    return wide.select(values).where(_present(F.col("v")))


def _bin_counts(binned: DataFrame, keys: list[str]) -> dict:
    grouped = binned.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    bins: dict = {}
    for row in grouped.collect():
        bins.setdefault(row[keys[0]], []).append((row["low"], row["high"], row["n"]))
    for found in bins.values():
        found.sort()
    return bins


def _place(bins, ranks, column, start, known, pending):
    """Resolve ranks that fall on a bin bound, queue the others by bin."""
    before = start
    wanted = sorted(ranks)
    for low, high, n in bins:
        inside = [r for r in wanted if before <= r < before + n]
        for r in inside:
            if low == high or r == before:
                known[column, r] = low
            elif r == before + n - 1:
                known[column, r] = high
            else:
                key = (column, low, high)
                segment = pending.setdefault(
                    key, _Segment(column, low, high, n, set(), before)
                )
                segment.ranks.add(r)
        before += n


def _segment_number(segments: list[_Segment]) -> Column:
    """Number of the segment a row of the long form falls into, else NULL."""
    number = None
    for i, s in enumerate(segments):
        inside = (F.col("column") == s.column) & F.col("v").between(s.low, s.high)
        number = F.when(inside, i) if number is None else number.when(inside, i)
    return number


def _refine(long: DataFrame, segments: list[_Segment], known, pending):
    """Cut each segment into equal-width bins and place its ranks again."""
    offset = None
    for i, s in enumerate(segments):
        width = (s.high - s.low) / FINE_BINS
        step = F.floor((F.col("v") - s.low) / F.lit(width or 1.0)).cast("int")
        mine = F.col("segment") == i
        offset = F.when(mine, step) if offset is None else offset.when(mine, step)
    numbered = long.select("v", _segment_number(segments).alias("segment")).where("segment IS NOT NULL")
    bins = _bin_counts(numbered.withColumn("bin", offset), ["segment", "bin"])
    for i, s in enumerate(segments):
        _place(bins[i], s.ranks, s.column, s.start, known, pending)


def _resolve_directly(long: DataFrame, segments: list[_Segment], known):
    """The wanted ranks of small segments; each segment has a buffer of its own."""
    shares = {
        (i, r): (r - s.start) / (s.size - 1) for i, s in enumerate(segments) for r in s.ranks
    }
    # One list for all segments: a sorted buffer answers further shares at no cost.
    points = sorted(set(shares.values()))
    found = (
        long.select("v", _segment_number(segments).alias("segment"))
        .where("segment IS NOT NULL")
        .groupBy("segment")
        .agg(F.percentile("v", F.array(*map(F.lit, points))).alias("values"))
        .collect()
    )
    values = {r["segment"]: dict(zip(points, r["values"])) for r in found}
    for (i, r), share in shares.items():
        known[segments[i].column, r] = values[i][share]


def exact_quantiles(
    df: DataFrame, wanted: dict[str, list[float]], direct_values: int = DIRECT_VALUES
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles, per column in the order asked for.

    Missing values are left out; a column without values gives ``None``.
    """
    wanted = {c: list(p) for c, p in wanted.items() if p}
    if not wanted:
        return {}
    columns = list(wanted)
    wide = df.select(*[col(c).cast("double").alias(c) for c in columns])
    long = _long_form(wide)

    bins = _bin_counts(long.select("column", "v", _coarse_bin(F.col("v")).alias("bin")),
                       ["column", "bin"])
    known: dict[tuple[int, int], float] = {}
    pending: dict = {}
    sizes = {i: sum(n for _, _, n in bins.get(i, [])) for i in range(len(columns))}
    for i, c in enumerate(columns):
        ranks = set()
        for p in wanted[c] if sizes[i] else []:
            position = (sizes[i] - 1) * p
            ranks |= {math.floor(position), math.ceil(position)}
        _place(bins.get(i, []), ranks, i, 0, known, pending)

    while pending:
        segments = list(pending.values())
        pending = {}
        small = [s for s in segments if s.size <= direct_values or s.high - s.low < 1e-300]
        large = [s for s in segments if s not in small]
        if small:
            _resolve_directly(long, small, known)
        if large:
            _refine(long, large, known, pending)

    results: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        values = []
        for p in wanted[c]:
            if not sizes[i]:
                values.append(None)
                continue
            position = (sizes[i] - 1) * p
            lower, upper = math.floor(position), math.ceil(position)
            low, high = known[i, lower], known[i, upper]
            values.append(low + (high - low) * (position - lower))
        results[c] = values
    return results


def approximate_quantiles(
    df: DataFrame, wanted: dict[str, list[float]], accuracy: int = 10_000
) -> dict[str, list[float | None]]:
    """One-pass quantiles within a rank error of ``1 / accuracy``."""
    columns = [c for c, p in wanted.items() if p]
    if not columns:
        return {}
    aggs = [
        F.percentile_approx(col(c).cast("double"), list(wanted[c]), accuracy).alias(f"q{i}")
        for i, c in enumerate(columns)
    ]
    row = df.agg(*aggs).first()
    return {
        c: list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(wanted[c])
        for i, c in enumerate(columns)
    }


def quantiles(df: DataFrame, wanted, approx: bool = False):
    return approximate_quantiles(df, wanted) if approx else exact_quantiles(df, wanted)
