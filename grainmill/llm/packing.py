"""Best-fit packing by a histogram of lengths.

Documents are tokenised, ended by an end id and cut into pieces of at most
``capacity`` ids (a shorter piece comes first). Best-fit decreasing then runs
over the counts per length, not over pieces: whole runs of equal bins are
filled at once, so the plan depends on the lengths and not on the number of
documents. A piece takes its planned slot by its rank within its length.

A missing text counts as empty and gives a piece with the end id alone.
Repeated rows are separate documents. An empty table gives no piece. Only
``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import functools
import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.session import settle

CAPACITY = 1024
END_ID = 2
PER_CELL = 50_000

# Pre-tokens of the byte-level vocabulary (fixed by its publisher).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def encoder(path: str) -> tiktoken.Encoding:
    """An encoder with the vocabulary in a byte-level BPE file of ``tokenizers``.

    In such a file the order of the ids is the order of the merges. The ids equal
    those of the ``tokenizers`` library, which needs four times as long.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown}
    byte_of |= {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {
        bytes(byte_of[c] for c in token): number
        for token, number in spec["model"]["vocab"].items()
        if token not in special
    }
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(text: str | None, path: str) -> np.ndarray:
    """Ids as unsigned 32-bit numbers, without an end id."""
    if not text:
        return np.zeros(0, "<u4")
    return encoder(path).encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


def pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if wanted, the ids of each piece."""
    end = np.array([end_id], "<u4")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.concatenate([token_ids(text, path), end])
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for number, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    row = (doc_id, number, a, b - a, zlib.crc32(ids[a:b].tobytes()))
                    rows.append((*row, ids[a:b].astype("int32").tolist()) if keep_ids else row)
            yield pd.DataFrame(rows, columns=columns).astype({"doc_id": batch["doc_id"].dtype})

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    schema += ", ids array<int>" if keep_ids else ""
    columns = [c.split()[0] for c in schema.split(", ")]
    return docs.select("doc_id", "text").mapInPandas(cut, schema)


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Rows (length, first rank, rank after the last, pieces a bin, first bin,
    offset): piece ``rank`` of a length goes to bin ``first_bin + (rank -
    first) // per_bin``. Bins with the same room are handled as runs, so the
    number of rows follows the number of lengths.
    """
    rooms: list[int] = []
    runs: dict[int, list[tuple[int, int]]] = {}
    opened = 0
    plan = []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, bins = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
            else:
                room, first, bins = capacity, opened, -1
            each = room // length
            full = left // each if bins < 0 else min(bins, left // each)
            if not full:  # the last ones do not fill a bin
                each, full = left, 1
            if bins < 0:
                opened += full
            elif full < bins:
                _add(rooms, runs, room, first + full, bins - full)
            plan.append((length, rank, rank + full * each, each, first, capacity - room))
            rank += full * each
            left -= full * each
            if room > each * length:
                _add(rooms, runs, room - each * length, first, full)
    return plan


def _add(rooms: list[int], runs: dict[int, list[tuple[int, int]]], room: int, first: int, bins: int) -> None:
    if room not in runs:
        runs[room] = []
        insort(rooms, room)
    runs[room].append((first, bins))


def _ranked(rows: DataFrame, total: int) -> DataFrame:
    """With ``rank``, from 0 within each length; a common length is ranked in cells."""
    cells = max(1, total // PER_CELL)
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(cells)))
    order = Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("length", "cell").agg(F.count("*").alias("n"))
    starts = sizes.select("length", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = rows.withColumn("within", F.row_number().over(order) - 1)
    return ranked.join(starts, ["length", "cell"]).withColumn("rank", F.col("before") + F.col("within"))


def pack(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False
) -> DataFrame:
    """One row per piece with its sequence_id and offset there."""
    spark = docs.sparkSession
    rows = settle(pieces(docs, path, capacity, end_id, keep_ids))
    columns = rows.columns
    # A row per length, capacity rows at most.
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    plan = best_fit_plan(counts, capacity)
    slots = spark.createDataFrame(
        plan, "length long, low long, high long, each long, first long, at long"
    )
    rank, low = F.col("rank"), F.col("low")
    placed = _ranked(rows, sum(counts.values())).join(
        F.broadcast(slots), ["length"]  # its rows follow the lengths, not the documents
    ).where((rank >= low) & (rank < F.col("high")))
    nth = rank - low
    return placed.select(
        *columns,
        (F.col("first") + F.floor(nth / F.col("each"))).alias("sequence_id"),
        (F.col("at") + nth % F.col("each") * F.col("length")).alias("offset"),
    )
