"""Exact and key-based duplicates: counts, sample groups, resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.columns import col, distinct_key, plain_columns, quoted, require

STRATEGIES = ("keep_first", "keep_last", "drop_all")


def _group_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*map(quoted, keys)).agg(F.count("*").alias("_size"))


def _narrow(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key columns with long texts replaced by their hash, for counting only."""
    return df.select(*[distinct_key(df, c).alias(c) for c in keys])


def _keys(df: DataFrame, keys) -> list[str]:
    if keys is None:
        return list(df.columns)
    if not keys:
        raise ValueError("keys must name at least one column")
    return require(df, keys)


def duplicate_stats(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows in groups of equal keys, number of such groups, rows to remove.

    ``keys=None`` compares whole rows. Missing keys are equal to each other.
    """
    names = _keys(df, keys)
    repeated = _group_sizes(_narrow(df, names), names).where("_size > 1")
    total = F.coalesce(F.sum("_size"), F.lit(0)).cast("bigint")
    return repeated.agg(
        total.alias("total_duplicates"),
        F.count("*").alias("unique_groups"),
        (total - F.count("*")).alias("rows_to_remove"),
    )


def sample_duplicate_groups(
    df: DataFrame,
    keys: list[str] | None = None,
    order_by: list[str] | None = None,
    groups: int = 5,
    rows: int = 3,
) -> DataFrame:
    """The first rows of the largest duplicate groups, with group and row rank.

    Spark cuts each group to ``rows`` rows before the shuffle, so a huge group
    does not end up in one task.
    """
    from pyspark.sql import Window

    names = _keys(df, keys)
    key_columns = [quoted(k) for k in names]
    largest = (
        _group_sizes(df, names)
        .where("_size > 1")
        .orderBy(F.col("_size").desc(), *[F.col(k).asc_nulls_first() for k in key_columns])
        .limit(groups)
    )
    rank = Window.orderBy(F.col("_size").desc(), *[F.col(k).asc_nulls_first() for k in key_columns])
    # At most ``groups`` rows.
    ranked = largest.withColumn("group_rank", F.row_number().over(rank).cast("bigint"))
    ranked = F.broadcast(
        ranked.select(
            *[col(k).alias(f"_k{i}") for i, k in enumerate(names)],
            F.col("_size").alias("group_size"),
            "group_rank",
        )
    )
    same: Column | None = None
    for i, k in enumerate(names):
        equal = col(k).eqNullSafe(F.col(f"_k{i}"))
        same = equal if same is None else same & equal
    order = [col(c).asc_nulls_first() for c in (order_by or plain_columns(df))]
    inside = Window.partitionBy("group_rank").orderBy(*order)
    return (
        df.join(ranked, same)
        .withColumn("row_rank", F.row_number().over(inside).cast("bigint"))
        .where(F.col("row_rank") <= rows)
        .select("group_rank", "group_size", "row_rank", *map(quoted, df.columns))
    )


def resolve_duplicates(
    df: DataFrame,
    strategy: str = "keep_first",
    subset: list[str] | None = None,
    order_by: list[str] | None = None,
) -> DataFrame:
    """Keep the first or the last row per key, or none of a repeated key.

    First and last follow ``order_by``; rows that tie are told apart by their
    other columns. One aggregation that starts before the shuffle, so a key
    with very many rows is reduced where it is read.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, not {strategy!r}")
    if subset is None:
        if strategy == "drop_all":
            return _group_sizes(df, df.columns).where("_size = 1").drop("_size")
        return df.dropDuplicates()
    keys = _keys(df, subset)
    if strategy == "drop_all":
        kept = (
            df.groupBy(*map(quoted, keys))
            .agg(F.count("*").alias("_size"), F.any_value(F.struct("*")).alias("_row"))
            .where("_size = 1")
        )
        return kept.select("_row.*")
    first = list(order_by or [])
    rest = [c for c in plain_columns(df) if c not in first]
    order = F.struct(*[col(c) for c in first + rest])
    pick = F.min_by if strategy == "keep_first" else F.max_by
    if set(first + rest) == set(df.columns):
        # The order already holds the whole row.
        chosen = F.min(order) if strategy == "keep_first" else F.max(order)
    else:
        chosen = pick(F.struct("*"), order)
    kept = df.groupBy(*map(quoted, keys)).agg(chosen.alias("_row"))
    return kept.select(*[F.col(f"_row.{quoted(c)}") for c in df.columns])


def resolution_stats(
    df: DataFrame, strategy: str = "keep_first", subset: list[str] | None = None
) -> DataFrame:
    """Rows before, after and removed, from the group sizes alone."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, not {strategy!r}")
    names = _keys(df, subset)
    sizes = _group_sizes(_narrow(df, names), names)
    before = F.coalesce(F.sum("_size"), F.lit(0)).cast("bigint")
    after = F.count_if(F.col("_size") == 1) if strategy == "drop_all" else F.count("*")
    return sizes.agg(
        before.alias("original_rows"),
        after.alias("remaining_rows"),
        (before - after).alias("removed_rows"),
    ).select(
        "*",
        F.lit(strategy).alias("strategy"),
        F.lit(",".join(subset) if subset else None).cast("string").alias("subset"),
    )
