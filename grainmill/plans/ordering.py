"""Work over one global row order without sending all rows to one task.

Rows are split into blocks by the value of the order key. The split points
come from a sample and enter the plan as constants, so every part of a query
puts a row in the same block. Each split point is the key of a real row, the
first one of its block.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.functions.columns import col, quoted

ROWS_PER_BLOCK = 1_000_000
MAX_BLOCKS = 16_384
SAMPLES_PER_BLOCK = 30
BLOCK = "_block"


def _sort_key(values):
    return tuple((v is not None, v) for v in values)


def _is_regular(value) -> bool:
    """Not NaN or infinite, which neither sort here nor fit into JSON."""
    return not isinstance(value, float) or math.isfinite(value)


def _comparable(df: DataFrame, name: str) -> Column:
    """The key in a form that is the same on the driver and in the plan.

    Times would pass through time zones on their way.
    """
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(col(name))
    if isinstance(dtype, (T.TimestampNTZType, T.DateType)):
        return col(name).cast("string")
    if isinstance(dtype, T.BinaryType):
        return F.hex(col(name))
    return col(name)


def _keys_only(df: DataFrame, order_by: list[str]) -> DataFrame:
    return df.select(*[_comparable(df, c).alias(f"k{i}") for i, c in enumerate(order_by)])


def split_points(
    df: DataFrame, order_by: list[str], rows_per_block: int, rows: int | None = None
) -> list[tuple]:
    """Order keys that cut the rows into blocks of about the given size."""
    rows = df.count() if rows is None else rows
    blocks = min(MAX_BLOCKS, math.ceil(rows / rows_per_block))
    if blocks <= 1:
        return []
    share = min(1.0, blocks * SAMPLES_PER_BLOCK / rows)
    sample = _keys_only(df, order_by).sample(fraction=share, seed=7).collect()
    usable = {tuple(r) for r in sample if any(v is not None for v in r)}
    keys = sorted((k for k in usable if all(map(_is_regular, k))), key=_sort_key)
    step = len(keys) / blocks
    return sorted({keys[int(step * i)] for i in range(1, blocks) if keys}, key=_sort_key)


def _constant_array(df: DataFrame, order_by: list[str], points: list[tuple]) -> Column:
    """The points as one constant, written as JSON so that the plan stays small."""
    types = [f.dataType.simpleString() for f in _keys_only(df, order_by).schema.fields]
    if len(order_by) == 1:
        values, schema = [p[0] for p in points], f"array<{types[0]}>"
    else:
        names = [f"k{i}" for i in range(len(types))]
        values = [dict(zip(names, p)) for p in points]
        schema = f"array<struct<{','.join(f'{n}:{t}' for n, t in zip(names, types))}>>"
    return F.from_json(F.lit(json.dumps(values, default=str)), schema)


def block_number(
    df: DataFrame, order_by: list[str], points: list[tuple], mark_first: bool = False
) -> Column:
    """Block of a row: how many points are not above its key, by binary search.

    With ``mark_first`` the number is negative for a row whose key is the split
    point that starts its block.
    """
    if not points:
        return F.lit(0)
    parts = [_comparable(df, c).alias(f"k{i}") for i, c in enumerate(order_by)]
    key = parts[0] if len(parts) == 1 else F.struct(*parts)
    array = _constant_array(df, order_by, points)
    steps = [1 << i for i in reversed(range(len(points).bit_length()))]

    def step(found: Column, size: Column) -> Column:
        # Beyond the end there is no point, and the test is not true.
        return F.when(key >= F.get(array, found + size - 1), found + size).otherwise(found)

    number = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)
    if not mark_first:
        return number
    return F.when(key == F.get(array, number - 1), -number).otherwise(number)


def with_blocks(
    df: DataFrame,
    order_by: list[str],
    rows_per_block: int = ROWS_PER_BLOCK,
    rows: int | None = None,
) -> DataFrame:
    points = split_points(df, order_by, rows_per_block, rows)
    return df.withColumn(BLOCK, block_number(df, order_by, points))


def _in_order(order_by: list[str]):
    return [col(c).asc_nulls_first() for c in order_by]


def with_running_total(
    df: DataFrame,
    order_by: list[str],
    weight: str,
    output: str,
    within: list[str] | None = None,
) -> DataFrame:
    """Sum of ``weight`` over the rows that come earlier in the order.

    ``df`` needs a ``_block`` column; with ``within`` a separate total runs in
    each group. The blocks of one group are summed up from a small table.
    """
    groups = within or []
    ordered = Window.partitionBy(*map(quoted, groups), BLOCK).orderBy(*_in_order(order_by))
    earlier_rows = ordered.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(col(weight)).over(earlier_rows), F.lit(0))

    totals = df.groupBy(*map(quoted, groups), BLOCK).agg(F.sum(col(weight)).alias("_total"))
    blocks = Window.partitionBy(*(map(quoted, groups) if groups else [F.lit(0)])).orderBy(BLOCK)
    offsets = totals.select(
        *map(quoted, groups),
        BLOCK,
        F.coalesce(
            F.sum("_total").over(blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_offset"),
    )
    if not groups:
        # At most MAX_BLOCKS rows.
        offsets = F.broadcast(offsets)
    return (
        df.withColumn(output, inside)
        .join(offsets, [*groups, BLOCK])
        .withColumn(output, (F.col(output) + F.col("_offset")).cast("bigint"))
        .drop("_offset")
    )


def with_previous(
    df: DataFrame,
    order_by: list[str],
    carried: list[str],
    output: str,
    points: list[tuple],
) -> DataFrame:
    """Add the ``carried`` columns of the previous row as a struct.

    The first row of each block is also put at the end of the block before it,
    where it meets its neighbour; in its own block it is left out. So rows are
    shuffled once and nothing is computed twice.
    """
    rest = [c for c in carried if c not in order_by]
    if points:
        number = block_number(df, order_by, points, mark_first=True)
        own = F.struct(F.abs("_number").alias("_blk"), F.lit(False).alias("_tail"))
        before = F.struct((-F.col("_number") - 1).alias("_blk"), F.lit(True).alias("_tail"))
        places = F.when(F.col("_number") < 0, F.array(before, own)).otherwise(F.array(own))
        placed = df.withColumn("_number", number).withColumn("_place", F.explode(places))
        placed = placed.select("*", "_place._blk", "_place._tail").drop("_number", "_place")
    else:
        placed = df.withColumns({"_blk": F.lit(0), "_tail": F.lit(False)})
    # Rows with equal keys are told apart by what they carry.
    ordered = Window.partitionBy("_blk").orderBy(*_in_order([*order_by, *rest]))
    payload = F.struct(*[col(c) for c in carried], "_tail")
    return (
        placed.withColumn(output, F.lag(payload).over(ordered))
        .where(~F.col("_tail") | ~F.coalesce(F.col(output)["_tail"], F.lit(False)))
        .where(F.col("_tail") | F.col(output).isNotNull() | (F.col("_blk") == 0))
        .drop("_blk", "_tail")
    )
