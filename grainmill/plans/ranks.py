"""Rank correlations without pairs of rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.functions.columns import col
from grainmill.plans.lookup import balanced_lookup
from grainmill.plans.ordering import ROWS_PER_BLOCK, with_blocks, with_running_total
from grainmill.session import Scratch

# Values of all columns whose ranks are sent to every task, 16 bytes each.
SENT_VALUES = 1 << 20
# Rows of a block of one column, of which a task holds one at a time, and blocks of a column.
ROWS_PER_GROUP = 200_000
MAX_BLOCKS = 1024
SAMPLES_PER_BLOCK = 100
# Cells of pairs of blocks that a task adds up before it hands them on.
CELLS_HELD = 1 << 20


def _values(df: DataFrame, columns: list[str]) -> DataFrame:
    # Adding 0.0 turns a negative zero into zero.
    return df.select(*[(col(c).cast("double") + F.lit(0.0)).alias(f"v{i}") for i, c in enumerate(columns)])


def _numpy(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch[name].to_numpy()


def spearman_matrix(
    df: DataFrame, columns: list[str], rows_per_block: int = ROWS_PER_BLOCK
) -> dict[tuple[str, str], float | None]:
    """Correlation of average ranks; ``df`` has no missing value in ``columns``.

    The values of all columns are counted in one pass over the rows. Ranks of
    columns with few values, SENT_VALUES in all, are sent to every task and
    looked up there; each other column costs one join. Ranks are measured from
    their mean.
    """
    k = len(columns)
    with Scratch(df.sparkSession) as scratch:
        rows = scratch.settle(_values(df, columns))
        cells = rows.select(F.posexplode(F.array(*rows.columns)).alias("i", "value"))
        counts = scratch.settle(cells.groupBy("i", "value").agg(F.count("*").alias("n")))
        told = {
            r["i"]: r for r in counts.groupBy("i").agg(F.count("*").alias("values"), F.sum("n").alias("total")).collect()
        }
        total = told[0]["total"] if told else 0
        if total < 2:
            return {}
        sizes = [told[i]["values"] for i in range(k)]
        left, sent, large = SENT_VALUES, [], []
        for i in sorted(range(k), key=sizes.__getitem__):
            (sent if sizes[i] <= left else large).append(i)
            left -= sizes[i]
        known = counts.where(F.col("i").isin(sent)).toArrow() if sent else None
        tables = {}
        for i in sent:
            own = _numpy(known, "i") == i
            value, n = _numpy(known, "value")[own], _numpy(known, "n")[own]
            order = np.argsort(value)
            value, n = value[order], n[order]
            tables[i] = value, np.cumsum(n) - n + (n + 1) / 2 - (total + 1) / 2
        if large:
            counts = counts.where(F.col("i").isin(large))
            blocked = scratch.settle(with_blocks(counts, ["value"], rows_per_block, sum(sizes[i] for i in large)))
            ranked = with_running_total(blocked, ["value"], "n", "_before", within=["i"])
            rank = F.col("_before") + (F.col("n") + 1) / 2.0 - (total + 1) / 2.0
            ranked = scratch.settle(ranked.select("i", "value", "n", rank.alias("r")))
            # Equal rows are told apart where rows of a frequent value are spread.
            rows = rows.withColumn("row", F.monotonically_increasing_id())
        for i in large:
            own = ranked.where(F.col("i") == i).withColumnRenamed("value", f"v{i}")
            table, own = own.select(f"v{i}", F.col("r").alias(f"r{i}")), own.select(f"v{i}", "n")
            rows = balanced_lookup(rows, table, own, f"v{i}", total, sizes[i]).drop(f"v{i}")
        spread = df.sparkSession.sparkContext.broadcast(tables)

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables, sums = spread.value, np.zeros((k, k))
            for batch in batches:
                ranks = np.empty((k, batch.num_rows))
                for i in range(k):
                    if i in tables:
                        value, rank = tables[i]
                        ranks[i] = rank[np.searchsorted(value, _numpy(batch, f"v{i}"))]
                    else:
                        ranks[i] = _numpy(batch, f"r{i}")
                sums += ranks @ ranks.T
            yield pa.RecordBatch.from_pydict({"sums": pa.array([sums.ravel()], pa.list_(pa.float64()))})

        wanted = rows.select([f"v{i}" if i in tables else f"r{i}" for i in range(k)])
        parts = wanted.mapInArrow(products, "sums array<double>").select(F.posexplode("sums").alias("at", "part"))
        sums = {r["at"]: r["s"] for r in parts.groupBy("at").agg(F.sum("part").alias("s")).collect()}
    result = {}
    for i in range(k):
        for j in range(i + 1, k):
            spread = math.sqrt(sums[i * k + i]) * math.sqrt(sums[j * k + j])
            result[columns[i], columns[j]] = sums[i * k + j] / spread if spread else None
    return result


def _exact_dot(left: np.ndarray, right: np.ndarray) -> int:
    """The sum of products, also beyond 64 bits."""
    return (int(left @ (right >> 20)) << 20) + int(left @ (right & (1 << 20) - 1))


def signed_pairs(x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> int:
    """Pairs that agree in the order of x and of y less those that do not.

    A pair of different x differs first in one binary digit of their numbers,
    counted from the top. For each digit, places that agree in the digits above
    stand together in the order of y, and a running total tells how many with
    digit 0 have a smaller or a larger y. ``n`` says how often each place counts.
    """
    x, y = (np.unique(v, return_inverse=True)[1] for v in (x, y))
    n = np.ones(len(x), np.int64) if n is None else n
    if not x.any() or not y.any():
        return 0
    if y.max() < x.max():
        x, y = y, x
    order = np.argsort(y, kind="stable")
    x, y, n = x[order], y[order], n[order]
    place = np.arange(len(x))
    total = 0
    for digit in reversed(range(int(x.max()).bit_length())):
        upper, one = x >> (digit + 1), (x >> digit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(np.where(one, 0, n))])
        opens = np.concatenate([[True], upper[1:] != upper[:-1]])
        starts = np.flatnonzero(opens)
        which = np.cumsum(opens) - 1
        stops = np.append(starts[1:], len(x))
        ties = opens | np.concatenate([[True], y[1:] != y[:-1]])
        tie_starts = np.flatnonzero(ties)
        tie = np.cumsum(ties) - 1
        tie_stops = np.append(tie_starts[1:], len(x))
        smaller = (zeros[tie_starts[tie]] - zeros[starts[which]])[one]
        larger = (zeros[stops[which]] - zeros[tie_stops[tie]])[one]
        total += _exact_dot(n[one], smaller - larger)
        if digit:
            # Each group is parted by the digit and stays in the order of y.
            count = np.concatenate([[0], np.cumsum(~one)])
            before = count[place] - count[starts[which]]
            ones_from = starts[which] + count[stops[which]] - count[starts[which]]
            to = np.where(one, ones_from + (place - starts[which]) - before, starts[which] + before)
            moved = [np.empty_like(v) for v in (x, y, n)]
            for new, v in zip(moved, (x, y, n), strict=True):
                new[to] = v
            x, y, n = moved
    return total


def _tied(counts: np.ndarray) -> int:
    return (_exact_dot(counts, counts) - int(counts.sum())) // 2


def _split_values(rows: DataFrame, total: int, rows_per_block: int) -> list[np.ndarray]:
    """For each column, sampled values that cut its rows into blocks of about the given size."""
    blocks = min(MAX_BLOCKS, math.ceil(total / rows_per_block))
    if blocks <= 1:
        return [np.zeros(0) for _ in rows.columns]
    share = min(1.0, blocks * SAMPLES_PER_BLOCK / total)
    sample = rows.sample(fraction=share, seed=7).toArrow()
    points = []
    for c in rows.columns:
        values = np.sort(_numpy(sample, c))
        values = values[~np.isnan(values)]
        at = (len(values) / blocks * np.arange(1, blocks)).astype(np.int64)
        points.append(np.unique(values[at]) if len(values) else np.zeros(0))
    return points


def _blocks(values: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Even numbers between the points; a point, and NaN, has an odd one of its own."""
    at = np.searchsorted(points, values)
    own = np.append(points, np.nan)[at] == values
    return 2 * at + (own | np.isnan(values))


def kendall_matrix(
    df: DataFrame, columns: list[str], rows_per_block: int = ROWS_PER_GROUP
) -> dict[tuple[str, str], float | None]:
    """Tau-b of all pairs of columns, in one chain of jobs and without pairs of rows.

    ``df`` has no missing value in ``columns``. Sampled values cut each column
    into blocks; a split value is a block of its own, so a value with many rows
    is one. For columns x and y, a pair of rows is counted once: if the blocks
    of both differ, by the table of counts of pairs of blocks; if the block of
    x is the same, in the group of this block; else in the group of the block
    of y, where blocks of x stand for its values. In the block of one value no
    pair differs, so its rows are not moved. Each row goes to at most one group
    per column, with its other columns, and a group takes n log n.
    """
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    number = {p: at for at, p in enumerate(pairs)}
    if not pairs:
        return {}
    with Scratch(df.sparkSession) as scratch:
        rows = scratch.settle(_values(df, columns))
        total = rows.count()
        if total < 2:
            return {}
        spread = df.sparkSession.sparkContext.broadcast(_split_values(rows, total, rows_per_block))
        width = 2 * MAX_BLOCKS + 2

        def columns_of(batch: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray]]:
            values = [_numpy(batch, f"v{i}") for i in range(k)]
            return values, [_blocks(v, p) for v, p in zip(values, spread.value, strict=True)]

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
            new: list[tuple] = []

            def merged() -> tuple[np.ndarray, np.ndarray]:
                every, inverse = np.unique(np.concatenate([codes, *[c for c, _ in new]]), return_inverse=True)
                sums = np.zeros(len(every), np.int64)
                np.add.at(sums, inverse, np.concatenate([counts, *[n for _, n in new]]))
                return every, sums

            def frame() -> pa.RecordBatch:
                return pa.RecordBatch.from_pydict({"code": codes, "n": counts})

            for batch in batches:
                _, blocks = columns_of(batch)
                placed = [(p * width + blocks[i]) * width + blocks[j] for p, (i, j) in enumerate(pairs)]
                new.append(np.unique(np.concatenate(placed), return_counts=True))
                if sum(len(c) for c, _ in new) >= CELLS_HELD:
                    codes, counts = merged()
                    new = []
                    if len(codes) >= CELLS_HELD:
                        yield frame()
                        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
            codes, counts = merged()
            yield frame()

        def between(key: tuple, table: pa.Table) -> pa.Table:
            """One pair of columns: pairs of rows in different blocks, and ties of values with a block."""
            p = key[0].as_py()
            code, n = _numpy(table, "code") % (width * width), _numpy(table, "n")
            found = [("pairs", p, signed_pairs(code // width, code % width, n))]
            # The pairs with the first column cover each column once.
            for i, blocks in ((0, code // width), (p + 1, code % width)):
                if p < k - 1 and (i or not p):
                    sizes = np.zeros(width, np.int64)
                    np.add.at(sizes, blocks, n)
                    found.append(("ties", i, _tied(sizes[1::2])))
            return result(found)

        names = ["v", *[f"o{i}" for i in range(k - 1)]]

        def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values, blocks = columns_of(batch)
                for i in range(k):
                    rest = blocks[i] % 2 == 0
                    if rest.any():
                        # In the group of the later column of a pair, blocks stand for values.
                        others = [blocks[o].astype(float) if o < i else values[o] for o in range(k) if o != i]
                        parts = [v[rest] for v in (values[i], *others)]
                        keys = {"i": np.full(len(parts[0]), i, np.int32), "block": blocks[i][rest].astype(np.int32)}
                        yield pa.RecordBatch.from_pydict(keys | dict(zip(names, parts, strict=True)))

        def within(key: tuple, table: pa.Table) -> pa.Table:
            """One block of a column: pairs of its rows, and ties."""
            i = key[0].as_py()
            value = _numpy(table, "v")
            found = [("ties", i, _tied(np.unique(value, return_counts=True)[1]))]
            for name, o in zip(names[1:], [o for o in range(k) if o != i], strict=True):
                found.append(("pairs", number[min(i, o), max(i, o)], signed_pairs(value, _numpy(table, name))))
            return result(found)

        def result(found: list[tuple]) -> pa.Table:
            what, at, s = zip(*found, strict=True)
            return pa.table({"what": list(what), "at": pa.array(at, pa.int32()), "s": [str(v) for v in s]})

        kind = "what string, at int, s string"
        counted = rows.mapInArrow(cells, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
        counted = counted.withColumn("p", F.expr(f"int(code DIV {width * width})"))
        moved = rows.mapInArrow(members, "i int, block int, " + ", ".join(f"{c} double" for c in names))
        parts = counted.groupBy("p").applyInArrow(between, kind)
        parts = parts.unionAll(moved.groupBy("i", "block").applyInArrow(within, kind))
        sums = {(r["what"], r["at"]): int(r["s"]) for r in parts.groupBy("what", "at").agg(
            F.sum(F.col("s").cast("decimal(38,0)")).alias("s")
        ).collect()}
    all_pairs = total * (total - 1) // 2
    result_of = {}
    for p, (i, j) in enumerate(pairs):
        untied = [all_pairs - sums.get(("ties", c), 0) for c in (i, j)]
        size = math.sqrt(untied[0]) * math.sqrt(untied[1])
        result_of[columns[i], columns[j]] = sums.get(("pairs", p), 0) / size if size else None
    return result_of


def kendall_tau(
    df: DataFrame, x: str, y: str, rows_per_block: int = ROWS_PER_GROUP
) -> float | None:
    """Tau-b of two columns over the rows in which both are present."""
    present = df.select(col(x).alias("x"), col(y).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    return kendall_matrix(present, ["x", "y"], rows_per_block).get(("x", "y"))
