import numpy as np
import pandas as pd
import pytest

from grainmill.operators.near_duplicates import near_duplicates
from grainmill.plans import lookup
from grainmill.plans.lookup import balanced_lookup
from grainmill.plans.ordering import split_points, with_blocks, with_previous, with_running_total


@pytest.mark.parametrize("rows_per_block", [7, 100, 10_000])
def test_running_total(spark, rows_per_block):
    pdf = pd.DataFrame({"k": np.random.default_rng(1).permutation(500), "w": range(500)})
    df = spark.createDataFrame(pdf)
    found = with_running_total(with_blocks(df, ["k"], rows_per_block), ["k"], "w", "t").toPandas()
    found = found.sort_values("k")
    assert list(found["t"]) == list(found["w"].cumsum() - found["w"])


def test_running_total_in_groups(spark):
    pdf = pd.DataFrame({"g": [i % 3 for i in range(300)], "k": range(300), "w": 1})
    df = with_blocks(spark.createDataFrame(pdf), ["k"], 20)
    found = with_running_total(df, ["k"], "w", "t", within=["g"]).toPandas().sort_values("k")
    assert list(found["t"]) == [i // 3 for i in range(300)]


@pytest.mark.parametrize("rows_per_block", [5, 40, 10_000])
def test_previous_row(spark, rows_per_block):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": rng.permutation(400) * 3, "v": rng.integers(0, 9, 400)})
    df = spark.createDataFrame(pdf)
    points = split_points(df, ["k"], rows_per_block)
    found = with_previous(df, ["k"], ["k", "v"], "p", points).collect()
    ordered = sorted((int(k), int(v)) for k, v in pdf.itertuples(index=False))
    expected = {b: a for a, b in zip([None, *ordered], ordered)}
    assert len(found) == len(ordered)
    for r in found:
        previous = None if r["p"] is None else (r["p"]["k"], r["p"]["v"])
        assert previous == expected[r["k"], r["v"]]


def test_previous_row_with_equal_and_missing_keys(spark):
    rng = np.random.default_rng(4)
    keys = [int(k) for k in rng.integers(0, 12, 300)]
    rows = [(None if k == 0 else k, i) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "k int, v int")
    points = split_points(df, ["k"], 20)
    assert len(points) > 3
    found = with_previous(df, ["k"], ["k", "v"], "p", points).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    expected = {b: a for a, b in zip([None, *ordered], ordered)}
    assert len(found) == len(rows)
    for r in found:
        previous = None if r["p"] is None else (r["p"]["k"], r["p"]["v"])
        assert previous == expected[r["k"], r["v"]]


def test_composite_text_keys(spark):
    rows = [("abcde"[i % 5], i // 5, f"t{i % 7}") for i in range(250)]
    df = spark.createDataFrame(rows, "a string, b int, c string")
    points = split_points(df, ["a", "b"], 15)
    found = with_previous(df, ["a", "b"], ["a", "b", "c"], "p", points).collect()
    ordered = sorted(rows)
    expected = dict(zip(ordered[1:], ordered))
    assert len(found) == 250
    for r in found:
        previous = None if r["p"] is None else (r["p"]["a"], r["p"]["b"], r["p"]["c"])
        assert previous == expected.get((r["a"], r["b"], r["c"]))


@pytest.mark.parametrize("dtype", ["timestamp", "timestamp_ntz", "date", "double", "decimal(20,6)"])
def test_key_types(spark, dtype):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        source = {
            # Spans the night the clock is set back.
            "timestamp": "timestamp_micros(1699160000000000 + id * 60000001)",
            "timestamp_ntz": "cast('2023-11-05 00:00:00' as timestamp_ntz) + make_dt_interval(0, 0, id, id / 7)",
            "date": "date_add(DATE'2023-11-05', cast(id as int))",
            "double": "case when id = 77 then double('NaN') else id / 7.0D end",
            "decimal(20,6)": "cast(id / 7 as decimal(20,6))",
        }[dtype]
        df = spark.range(200).selectExpr(f"{source} AS k", "id")
        points = split_points(df, ["k"], 9)
        assert len(points) > 10
        found = with_previous(df, ["k"], ["id"], "p", points).collect()
        pairs = {r["id"]: r["p"] and r["p"]["id"] for r in found}
        ids = [r["id"] for r in df.orderBy("k").collect()]
        assert len(found) == 200 and pairs == dict(zip(ids, [None, *ids]))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def _similar_text(a, b, t):
    if a is None or b is None:
        return a is None and b is None
    if a == b:
        return True
    x, y = set(a.lower()), set(b.lower())
    return bool(x and y) and len(x & y) / len(x | y) >= t


def _similar_number(a, b, t):
    if a is None or b is None:
        return False
    if a == b:
        return True
    if a == 0 or b == 0:
        return abs(a - b) <= t
    return abs(a - b) / max(abs(a), abs(b)) <= t


@pytest.mark.parametrize("rows_per_block", [9, 10_000])
@pytest.mark.parametrize("block_by", [None, ["g"]])
def test_near_duplicates_against_a_loop(spark, rows_per_block, block_by):
    rng = np.random.default_rng(8)
    words = ["abcdefghij", "ABCDEFGHIJ", "abcdefghik", "", None, "xyz"]
    rows = [
        (i, "uv"[int(rng.integers(2))], words[int(rng.integers(6))],
         [None, 0.0, 0.04, 100.0, 104.0][int(rng.integers(5))])
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "id int, g string, s string, n double")
    found = near_duplicates(
        df, ["id"], ["s"], ["n"], block_by=block_by, rows_per_block=rows_per_block
    )
    ordered = sorted(rows, key=lambda r: (r[1], r[0])) if block_by else rows
    expected = {
        (a[0], b[0])
        for a, b in zip(ordered, ordered[1:])
        if (not block_by or a[1] == b[1])
        and _similar_text(a[2], b[2], 0.9)
        and _similar_number(a[3], b[3], 0.05)
    }
    assert {(r["previous_id"], r["id"]) for r in found.collect()} == expected
    assert expected


def test_near_duplicates_needs_a_column(spark):
    df = spark.range(3)
    with pytest.raises(ValueError):
        near_duplicates(df, ["id"], [], [])


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_lookup_with_a_hot_key(spark, monkeypatch, how, limit):
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", limit)
    rows = [(1 if i % 3 == 0 else i, i) for i in range(3000)] + [(None, -1), (None, -2)]
    df = spark.createDataFrame(rows, "k int, v int")
    counts = df.where("k IS NOT NULL").groupBy("k").count().withColumnRenamed("count", "n")
    table = counts.selectExpr("k", "k * 10 AS label")
    found = balanced_lookup(df, table, counts, "k", 3000, table.count(), how).collect()
    expected = [(k, v, None if k is None else k * 10) for k, v in rows]
    if how == "inner":
        expected = [r for r in expected if r[0] is not None]
    assert sorted((r["v"], r["k"], r["label"]) for r in found) == sorted(
        (v, k, x) for k, v, x in expected
    )


def test_lookup_does_not_broadcast_long_keys(spark, monkeypatch):
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 1 << 20)
    rows = spark.range(300).selectExpr("concat(repeat('k', 10000), id) AS k", "id")
    counts = rows.groupBy("k").count().withColumnRenamed("count", "n")
    table = counts.selectExpr("k", "n AS label")
    found = balanced_lookup(rows, table, counts, "k", 300, 300)
    # Three hundred rows, but three megabytes: joined by a salted shuffle.
    assert "_salt" in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 300 and found.agg({"label": "sum"}).first()[0] == 300
