"""All similar pairs of rows against a comparison of every row with every other."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.operators.near_duplicates import near_duplicate_classes


def _set(text):
    return None if text is None else frozenset(text.lower())


def _like(a, b, threshold):
    if a is None or b is None:
        return a is None and b is None
    if not a or not b:
        return len(a) == len(b)
    return len(a & b) / len(a | b) >= threshold


def _near(x, y, threshold):
    if x is None or y is None or x != x or y != y:
        return False
    if x == y:
        return True
    if x == 0 or y == 0:
        return abs(x - y) <= threshold
    return abs(x - y) / max(abs(x), abs(y)) <= threshold


def _brute(rows, strings, numbers, blocked):
    found = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if (
                (not blocked or a[4] == b[4])
                and (strings is None or _like(_set(a[1]), _set(b[1]), strings) and _like(_set(a[2]), _set(b[2]), strings))
                and (numbers is None or _near(a[3], b[3], numbers))
            ):
                found.add((a[0], b[0]))
    return found


def _rows(n=140):
    draw = random.Random(3)
    words = ["abcdefghij", "abcdefghi", "Abcdefghijk", "xyz", "xy", "", None, "éüß", "the quick brown", "the quick brow", "a"]
    amounts = [0.0, -0.0, 0.01, -0.04, 0.05, 1.0, 1.04, 1.06, 0.96, 100.0, 104.9, 95.2, -100.0, -96.0, None, float("nan"), 1e-300]
    return [
        (k, draw.choice(words), draw.choice([*words[:4], None]), draw.choice(amounts), draw.choice(["p", "q", None]))
        for k in range(n)
    ]


@pytest.mark.parametrize("strings, numbers, blocked", [
    (0.9, None, False), (0.9, 0.05, True), (0.7, 0.05, False), (1.0, 0.0, False), (0.0, 0.3, True), (None, 0.05, False), (0.8, 1.5, False),
])
def test_pairs_and_members_equal_brute_force(spark, strings, numbers, blocked):
    rows = _rows()
    df = spark.createDataFrame(rows, "id long, t string, u string, v double, part string")
    found = near_duplicate_classes(
        df, ["id"], [] if strings is None else ["t", "u"], [] if numbers is None else ["v"],
        0.9 if strings is None else strings, 0.05 if numbers is None else numbers, ["part"] if blocked else None,
    )
    members = {}
    for r in found.members.collect():
        members.setdefault(r["first_id"], []).append(r["id"])
    assert sorted(i for ids in members.values() for i in ids) == list(range(len(rows)))
    assert all(first == min(ids) for first, ids in members.items())
    linked = set()
    for ids in members.values():
        linked |= {(a, b) for a in ids for b in ids if a < b}
    pairs = found.pairs.collect()
    assert len({(r["first_id"], r["second_id"]) for r in pairs}) == len(pairs)
    for r in pairs:
        a, b = members[r["first_id"]], members[r["second_id"]]
        assert (r["n"], r["other_n"]) == (len(a), len(b)) and r["first_id"] < r["second_id"]
        linked |= {(min(i, j), max(i, j)) for i in a for j in b}
    assert linked == _brute(rows, strings, numbers, blocked)
    told = found.summary().first()
    assert (told["candidates_found"], told["class_pairs"]) == (len(linked), len(pairs))
    assert told["classes"] == len(members)


def test_a_large_class_makes_no_pairs(spark):
    """Equal rows meet once as a class, however many there are."""
    df = spark.range(20_000).selectExpr("id", "CASE WHEN id < 19990 THEN 'same text' ELSE 'same text!' END AS t")
    found = near_duplicate_classes(df, ["id"], ["t"], [], 0.8)
    assert found.classes.count() == 2
    assert [tuple(r) for r in found.pairs.collect()] == [(0, 19_990, 19_990, 10)]
    assert found.summary().first()["candidates_found"] == 20_000 * 19_999 // 2


def test_empty_table_and_errors(spark):
    empty = spark.createDataFrame([], "id long, t string, v double")
    found = near_duplicate_classes(empty, ["id"])
    assert found.members.collect() == [] and found.pairs.collect() == []
    assert tuple(found.summary().first()) == (0, 0, 0)
    with pytest.raises(ValueError):
        near_duplicate_classes(empty, ["id", "t", "v"])
    with pytest.raises(ValueError):
        near_duplicate_classes(empty, ["id"], string_threshold=1.2)


def test_names_of_other_columns_do_not_clash(spark):
    rows = [(1, "abc", "x"), (2, "abcd", "y"), (3, "zzz", "x")]
    df = spark.createDataFrame(rows, "first long, digest string, `class` string")
    found = near_duplicate_classes(df, ["first"], ["digest"], [], 0.7)
    assert [tuple(r) for r in found.pairs.collect()] == [(1, 2, 1, 1)]
    assert {tuple(r) for r in found.members.collect()} == {(1, 1), (2, 2), (3, 3)}


def test_sketches_rule_out_most_pairs_and_no_similar_one(spark):
    from grainmill.operators import near_duplicates as module

    rng = np.random.default_rng(5)
    base = [set(rng.choice(60, rng.integers(1, 50), replace=False)) for _ in range(60)]
    sets = base + [b ^ {int(rng.integers(0, 60))} for b in base] + [set()]
    rows = [(i, "".join(chr(0x4E00 + c) for c in sorted(s))) for i, s in enumerate(sets)] + [(900, None), (901, None)]
    df = spark.createDataFrame(rows, "id int, _s0 string")
    df = df.select("id", "_s0", *[c.alias(name) for name, c in module._sketched("_s0").items()])
    other = df.select([F.col(c).alias(f"other_{c}") for c in df.columns])
    pairs = df.crossJoin(other).where("id < other_id").where(module._alike("_s0", 0.9))
    open_ = {(r["id"], r["other_id"]) for r in pairs.select("id", "other_id").collect()}
    similar = {
        (i, j) for i, a in enumerate(sets) for j, b in enumerate(sets)
        if i < j and (a == b or a and b and 10 * len(a & b) >= 9 * len(a | b))
    }
    assert similar and similar | {(900, 901)} <= open_
    assert len(open_) < 5 * len(similar)
