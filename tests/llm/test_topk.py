import math
import random

import pytest
from grainmill.llm.topk import top_k
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, score string, v int"


def brute(rows, k):
    vectors = {(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows}
    found = set()
    for q, x in vectors:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in vectors if i != q)
            found |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)}
    return found


def _rows(draw, n, dims, spread):
    return [(k, [draw.randint(-spread, spread) / 64 for _ in range(dims)]) for k in range(n)]


@pytest.mark.parametrize("n, dims, spread, block", [(300, 8, 40, 64), (200, 3, 2, 50), (15, 4, 9, 8192), (150, 1, 1, 30)])
def test_equals_brute_force_with_ties(spark, n, dims, spread, block):
    rows = _rows(random.Random(n), n, dims, spread)
    rows += rows[:3]  # repeated rows count once
    frame = spark.createDataFrame([(*r, 0, "s", 1) for r in rows], SCHEMA).repartition(3)
    found = top_k(frame, F.col("vec_id") % 20 == 0, block=block).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found} == brute(rows, 20)


def test_unusable_vectors_take_no_part(spark):
    good = _rows(random.Random(1), 45, 4, 30)
    bad = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0]), (103, [float("nan")] * 4), (104, [float("inf")] * 4),
           (None, [0.1] * 4), (120, [1.0, 2.0])]
    frame = spark.createDataFrame([(*r, 0, "s", 1) for r in good + bad], SCHEMA)
    found = top_k(frame, F.col("vec_id") % 20 == 0).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found} == brute(good, 20)
    assert top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert top_k(frame.where("vec_id > 99"), F.col("vec_id") % 20 == 1).count() == 0
