import itertools
import random

import numpy as np
import pytest
from edges import awkward_docs, no_docs
from grainmill.llm.decontaminate import MASKS, benchmark_overlaps

WORDS = [f"w{k}" for k in range(400)]


def _passage(draw, n):
    return [draw.choice(WORDS) for _ in range(n)]


def test_planted_passages_with_replaced_words(spark):
    draw = random.Random(2)
    items = {k: _passage(draw, n) for k, n in enumerate([15, 20, 40, 59, 12])}
    docs, expected, starts = [], set(), {}
    for doc_id in range(120):
        text = _passage(draw, draw.choice([5, 60, 300]))
        if doc_id % 3 == 0:
            item = draw.choice(list(items))
            copy = list(items[item])
            for k in range(6, len(copy) - 1, 13):  # a replaced word in thirteen
                if doc_id % 2:
                    copy[k] = "other"
            at = draw.randrange(len(text) + 1)
            text[at:at] = copy
            expected.add((doc_id, item))
            starts[doc_id, item] = at
        docs.append((doc_id, " ".join(w.upper() if doc_id % 5 == 0 else w for w in text).replace(" ", ",  ", 3)))
    found = benchmark_overlaps(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame([(k, " ".join(t)) for k, t in items.items()], "item_id long, text string"),
    ).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == expected
    for r in found:
        assert r["doc_start"] - r["item_start"] == starts[r["doc_id"], r["item_id"]]
        assert r["n_matches"] <= r["n_words"] <= r["item_words"]


def test_short_items_are_found_whole(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta"), (3, None), (4, ""), (None, "x y z")], "item_id long, text string")
    docs = [(1, "so alpha, beta; GAMMA it is"), (2, "alpha beta delta"), (3, "alpha beta"), (4, None)]
    found = benchmark_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 1), (2, 2)}


def test_awkward_rows(spark):
    items = spark.createDataFrame([(7, "the same text of more than five words"), (8, "x " * 30)], "item_id long, text string")
    found = benchmark_overlaps(awkward_docs(spark), items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(0, 7), (90, 7)}
    assert benchmark_overlaps(no_docs(spark), items).count() == 0
    assert benchmark_overlaps(awkward_docs(spark), items.limit(0)).count() == 0


def _qualifies(equal):
    """The rule itself, over all stretches."""
    for first in range(len(equal)):
        for last in range(first, len(equal)):
            n = sum(equal[first : last + 1])
            if n >= min(10, len(equal)) and 4 * n >= 3 * (last - first + 1):
                return True
    return False


@pytest.mark.parametrize(("size", "replaced"), [(18, 3), (18, 4), (20, 5), (24, 5), (16, 4), (13, 3), (40, 14)])
def test_any_stretch_that_qualifies_is_found(spark, size, replaced):
    draw = random.Random(size * replaced)
    item = _passage(draw, size)
    # First the cases of the review: a short clean run beside, and a stretch that grows too far.
    placements = [(2, 5, 8)] if (size, replaced) == (18, 3) else [(10, 12, 15, 17, 18)] if (size, replaced) == (24, 5) else []
    placements += [tuple(sorted(draw.sample(range(size), replaced))) for _ in range(600)]
    docs, expected = [], set()
    for doc_id, places in enumerate(placements):
        copy = [f"r{doc_id}" if k in places else w for k, w in enumerate(item)]
        docs.append((doc_id, " ".join([f"x{doc_id}"] * (doc_id % 4) + copy + [f"y{doc_id}"] * (doc_id % 3))))
        if _qualifies([k not in places for k in range(size)]):
            expected.add(doc_id)
    found = benchmark_overlaps(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"),
    ).collect()
    assert {r["doc_id"] for r in found} == expected
    for r in found:
        inside = [r["item_start"] + k not in placements[r["doc_id"]] for k in range(r["n_words"])]
        assert sum(inside) == r["n_matches"] >= 10 and 4 * r["n_matches"] >= 3 * r["n_words"]


def test_masks_meet_every_stretch():
    # The hardest of each length: as many replaced words as the share allows.
    for size in range(10, 26):
        replaced = min(size // 4, size - 10)
        places = np.array(list(itertools.combinations(range(size), replaced)), dtype=np.int64)
        equal = (1 << size) - 1 - (np.int64(1) << places).sum(axis=1, dtype=np.int64)
        for mask in MASKS:
            bits = sum(1 << k for k in mask)
            for at in range(size - mask[-1]):
                equal = equal[equal & (bits << at) != bits << at]
        assert len(equal) == 0, size
