"""Exact top-k by inner product with vector-approximation files.

Every component is cut into CELLS cells by the range of its dimension; the
approximation of a vector is its cell numbers. For a block of queries and a
block of vectors, the cells give bounds on all scores. For each query, vectors
whose upper bound reaches the k-th best lower bound are read exactly, highest
bound first, until the k-th score found is above every bound that is left.
The best of the blocks are merged. Blocks are of fixed size and dealt by the
hash of the id, so equal vectors spread over them.

Vectors that are NULL, empty or hold NULL or non-finite components take no part,
nor do such of another length than most (the longest of the most frequent
lengths counts). A query's own id is no candidate. Rows that repeat an id and a
vector count once; different vectors of one id are all candidates, and as
queries each gives rows of its own. Ties go to the smaller id. Only ``vec_id``
and ``embedding`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm.common import map_batches
from grainmill.session import Scratch, settle

CELLS = 16
BLOCK = 8192
SCALE = 64


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component, of usable vectors only."""
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", doubles.alias("x"))
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where((F.size("x") > 0) & ~F.coalesce(bad, F.lit(False)))
    rows = rows.select("vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("v"))
    return rows.dropDuplicates(["vec_id", "v"])


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(b, np.int64) for b in column]).astype(np.float64)


def _packed(rows: DataFrame) -> DataFrame:
    """The vectors as bytes, which cogrouping moves faster than arrays."""

    def pack(batch: pd.DataFrame) -> pd.DataFrame:
        vectors = [np.asarray(v, np.int64).tobytes() for v in batch["v"]]
        return pd.DataFrame({"vec_id": batch["vec_id"], "v": vectors})

    return map_batches(rows, pack, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, v binary")


def best_in_block(
    queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray,
    lows: np.ndarray, widths: np.ndarray, k: int,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its place, and ids and scores of its k best vectors of the block.

    Components are whole numbers, so sums of products below 2^53 are exact.
    """
    cells = np.clip((vectors - lows) // widths, 0, CELLS - 1)
    below = lows + cells * widths
    above = below + widths - 1
    for part in range(0, len(queries), 256):
        q = queries[part : part + 256]
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        upper = plus @ above.T + minus @ below.T
        lower = plus @ below.T + minus @ above.T
        for row in range(len(q)):
            own = ids == query_ids[part + row]
            bound, floor = upper[row], lower[row]
            bound[own] = floor[own] = -np.inf
            free = len(ids) - int(own.sum())
            if not free:
                continue
            top = min(k, free)
            least = np.partition(floor, len(ids) - top)[len(ids) - top]
            left = np.flatnonzero((bound >= least) & ~own)
            left = left[np.argsort(-bound[left], kind="stable")]
            read = np.zeros(0, np.int64)
            score = np.zeros(0)
            step = max(2 * top, 64)
            for at in range(0, len(left), step):
                if len(score) >= top:
                    sure = np.partition(score, len(score) - top)[len(score) - top]
                    if bound[left[at]] < sure:  # an equal bound may hide a tie with a smaller id
                        break
                more = left[at : at + step]
                read = np.concatenate([read, more])
                score = np.concatenate([score, vectors[more] @ q[row]])
            order = np.lexsort((ids[read], -score))[:top]
            yield part + row, ids[read[order]], score[order]


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, scale: int = SCALE, block: int = BLOCK
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best candidates of each query."""
    spark = vectors.sparkSession
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    with Scratch(spark) as scratch:
        rows = scratch.settle(scaled(vectors, scale))
        lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
        schema = f"query_id {id_type}, query long, vec_id {id_type}, score long"
        if lengths is None:
            empty = spark.createDataFrame([], schema)
            return empty.select("query_id", F.lit(0).alias("rank"), "vec_id", "score")
        dims, total = lengths["n"], lengths["count"]
        rows = rows.where(F.size("v") == dims)
        ranges = rows.agg(
            *[F.min(F.get("v", F.lit(j))).alias(f"a{j}") for j in range(dims)],
            *[F.max(F.get("v", F.lit(j))).alias(f"b{j}") for j in range(dims)],
        ).first()
        lows = np.array([ranges[f"a{j}"] for j in range(dims)], np.float64)
        highs = np.array([ranges[f"b{j}"] for j in range(dims)], np.float64)
        if dims * float(np.maximum(abs(lows), abs(highs)).max()) ** 2 >= 2.0**53:
            raise ValueError("scores beyond 2^53 are not exact")
        widths = np.maximum(1, np.ceil((highs - lows + 1) / CELLS))
        packed = scratch.settle(_packed(rows))
        queries = packed.where(is_query)
        vector_blocks = -(-total // block)
        query_blocks = max(1, -(-queries.count() // block))

        def dealt(blocks: int) -> Column:
            return F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")

        def every(blocks: int) -> Column:
            return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

        # Each block of vectors meets each block of the stated queries once.
        left = queries.withColumn("qb", dealt(query_blocks)).withColumn("vb", every(vector_blocks))
        right = packed.withColumn("vb", dealt(vector_blocks)).withColumn("qb", every(query_blocks))

        def search(key: tuple, asked: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
            if not len(asked) or not len(given):
                return pd.DataFrame({"query_id": [], "query": [], "vec_id": [], "score": []})
            asked_ids, ids = asked["vec_id"].to_numpy(), given["vec_id"].to_numpy()
            marks = [hash_of(b) for b in asked["v"]]
            found = list(best_in_block(_matrix(asked["v"]), asked_ids, _matrix(given["v"]), ids, lows, widths, k))
            sizes = [len(f[1]) for f in found]
            places = np.repeat(np.array([f[0] for f in found], np.int64), sizes)
            return pd.DataFrame(
                {
                    "query_id": asked_ids[places],
                    "query": np.array(marks, np.int64)[places],
                    "vec_id": np.concatenate([f[1] for f in found]) if found else [],
                    "score": (np.concatenate([f[2] for f in found]) if found else np.zeros(0)).astype(np.int64),
                }
            )

        near = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInPandas(search, schema)
        near = settle(near)
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def hash_of(data: bytes) -> int:
    """Tells different vectors of one id apart."""
    return xxhash.xxh64_intdigest(data) - (1 << 63)
