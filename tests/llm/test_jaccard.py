import random
import re

import numpy as np
import pytest
from edges import awkward_docs, no_docs
from grainmill.llm import graph, jaccard
from grainmill.llm.graph import components
from grainmill.llm.jaccard import boundary, jaccard_components, shingles
from grainmill.session import Scratch


def brute(rows):
    """doc_id -> (number of shingles, component) by comparing all pairs."""
    sets, parent = {}, {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)] or ([tuple(words)] if words else [])
        sets[doc_id] = set(grams)
        parent[doc_id] = doc_id

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in ids}


def _texts(seed, n=150):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(n):
        if rows and draw.random() < 0.6:
            text = draw.choice(rows)[1].split()
            for _ in range(draw.choice([0, 0, 1, 2, 4])):
                text[draw.randrange(len(text))] = draw.choice(words)
            text = text[: len(text) - draw.randrange(3)] or ["w"]
        else:
            text = [draw.choice(words) for _ in range(draw.choice([1, 3, 4, 6, 9, 12, 30, 80]))]
        rows.append((k, " ".join(text)))
    return rows


@pytest.mark.parametrize("light_to", [1, 25])
def test_equals_all_pairs_for_any_boundary(spark, monkeypatch, light_to):
    monkeypatch.setattr(jaccard, "boundary", lambda counts, percent: light_to)
    rows = _texts(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).collect()}
    assert got == brute(rows)


def test_one_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MAX_SALTED", 8)
    draw = random.Random(9)
    base = [f"v{k}" for k in range(120)]
    rows = []
    for k in range(200):
        text = list(base)
        for _ in range(draw.randrange(4)):
            text[draw.randrange(120)] = f"x{draw.randrange(10_000)}"
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).collect()}
    assert got == brute(rows)


def test_who_is_outside_a_list_meets_its_nearest_neighbours(spark):
    # 30 lists of a class at k bits from class 99, one at 200 bits, and 99, the only one outside component 1.
    def sketch(bits):
        value = (1 << bits) - 1
        words = [value >> 64 * k & (1 << 64) - 1 for k in range(jaccard.SKETCH)]
        return [w - (1 << 64) if w >> 63 else w for w in words]

    postings = [(k, c, 100, 0, 0, 99 if c == 99 else 1) for k in range(1, 31) for c in (k, 50, 99)]
    lists = spark.createDataFrame(postings, "key long, class long, n int, first int, kind byte, root long")
    rows = [(c, 100, *sketch({50: 200, 99: 0}.get(c, c))) for c in [*range(1, 31), 50, 99]]
    sketches = spark.createDataFrame(rows, "class long, n long, " + ", ".join(f"{c} long" for c in jaccard.SKETCH_COLUMNS))
    pairs = [tuple(r) for r in jaccard._nearest_pairs(lists, sketches, 80, 3).collect()]
    assert len(pairs) == 2 and {b for _, b in pairs} == {99}
    # 180 * bits <= 20 * 200 leaves a link open.
    assert min(a for a, _ in pairs) <= 5 and max(a for a, _ in pairs) <= 22


def test_awkward_rows(spark):
    rows = jaccard_components(awkward_docs(spark)).collect()
    assert len(rows) == 11
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"]))
    assert by_id[0] == by_id[90] == {(4, 0)} and by_id[None] == {(4, 0)}
    assert by_id[1] == {(0, 1)} and by_id[2] == {(0, 2)} and by_id[3] == {(0, 3)} and by_id[4] == {(1, 4)}
    assert jaccard_components(no_docs(spark)).count() == 0


def test_shingles_split_on_ascii_blanks_only():
    assert len(shingles("a b c d e f")) == 2
    assert len(shingles("a b c d e f")) == 1
    assert (shingles("A B") == shingles("a b")).all() and len(shingles("É e")) == 1


def test_boundary_grows_with_the_skew_of_the_lists():
    flat = np.full(1 << 10, 5, np.uint64)
    skewed = flat.copy()
    skewed[:4] = 5000
    assert boundary(flat, 80) < boundary(skewed, 80)


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_components_of_long_paths_and_stars(spark, monkeypatch, broadcast):
    monkeypatch.setattr(graph, "BROADCAST_ROWS", broadcast)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    with Scratch(spark) as scratch:
        roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert len(set(roots[k] for k in range(61))) == 1 and len({roots[k] for k in range(100, 130)}) == 1
    assert roots[0] != roots[100]


def test_a_small_graph_needs_no_shuffle(spark, monkeypatch):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long")
    new = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {key: spark.conf.get(key) for key in new}
    tracker = spark.sparkContext.statusTracker()

    def most_tasks(group):
        spark.sparkContext.setJobGroup(group, group)
        with Scratch(spark) as scratch:
            assert {r["root"] for r in components(edges, scratch).collect()} == {0}
        stages = [s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
        return max(info.numTasks for info in map(tracker.getStageInfo, stages) if info)

    try:
        for key, value in new.items():
            spark.conf.set(key, value)
        assert most_tasks("small graph") < 50
        monkeypatch.setattr(graph, "SMALL_ROWS", 10)
        assert most_tasks("large graph") == 50
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_all_lists_are_read_in_one_round_and_at_the_end(spark, monkeypatch):
    draw = random.Random(4)
    base = [f"v{k}" for k in range(100)]
    rows = []
    for k in range(150):
        text = list(base)
        for at in draw.sample(range(100), draw.choice([1, 2, 3, 3, 3, 4])):
            text[at] = f"x{draw.randrange(10_000)}"
        rows.append((k, " ".join(text)))
    calls = []
    linked = jaccard._linked
    monkeypatch.setattr(jaccard, "_linked", lambda *a: calls.append(1) or linked(*a))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).collect()}
    assert got == brute(rows) and len(set(got.values())) > 10
    assert len(calls) == jaccard.ROUNDS + 2
