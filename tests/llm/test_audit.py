import random
import re

import numpy as np
import pytest
from edges import awkward_docs, no_docs
from grainmill.llm import audit
from grainmill.llm.audit import MEASURES, audit_filters, interactions, measure, text_measures
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text)
    capitals = sum("A" <= c <= "Z" for c in text)
    return [len(words), len(set(words)), capitals, sum(c in "#$%&*|" for c in text), len(text)]


def measured(texts, block):
    data = [t.encode() for t in texts]
    edges = np.cumsum([0, *map(len, data)])
    return measure(np.frombuffer(b"".join(data), np.uint8), edges, block).tolist()


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.text(st.sampled_from("aAbZ #|\n\x0b\x0c\t 　é漢🙂"), max_size=60), max_size=6),
    st.sampled_from([4, 17, 1 << 20]),
)
def test_measures_equal_plain_counting(texts, block):
    assert measured(texts, block) == [plain(t) for t in texts]


def test_long_words_with_equal_ends_are_told_apart():
    words = ["12345678" + middle + "abcdefgh" for middle in ("", "x", "y", "xx", "xy", "x" * 40, "x" * 39 + "y")]
    texts = [" ".join(words * 2), " ".join(words[:3]), ""]
    for block in (16, 1 << 20):
        assert measured(texts, block) == [plain(t) for t in texts]


def test_colliding_hashes_are_verified(monkeypatch):
    """Without any mixing, all words share a few slots and only their bytes tell them apart."""
    monkeypatch.setattr(audit, "MIXERS", [np.uint64(0)] * 4)
    texts = [" ".join(f"w{k % 70}" for k in range(300)), "a b a"]
    assert measured(texts, 1 << 20) == [plain(t) for t in texts]


def brute(docs, labels, letters="ABCDE"):
    """Row by row, order by order."""
    import itertools
    from collections import defaultdict

    ids = defaultdict(list)
    for i, t, _ in docs:
        if i is not None:
            ids[t or ""].append(i)
    rows = defaultdict(list)
    for i, t, part in docs:
        w, d, c, s, n = plain(t or "")
        copy = any(i is None or j < i for j in ids[t or ""])
        fails = [w < 200, 100 * d < 50 * w, 100 * c > 3 * n, s > 0, copy]
        good = any(i is not None and j == i and q == 1 for j, q, _ in labels)
        toxic = any(i is not None and j == i and x == 1 for j, _, x in labels)
        rows[part or ""].append((dict(zip("ABCDE", fails, strict=True)), good, toxic))
    found, shapley = {}, defaultdict(int)
    for part, given in rows.items():
        for order in itertools.permutations(letters):
            left = list(given)
            for step, f in enumerate(order, 1):
                before = order[: step - 1]
                gone = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                redundant = sum(r[0][f] and any(r[0][g] for g in before) for r in given)
                alone = sum(r[0][f] and sum(r[0].values()) == 1 for r in given)
                shapley[part, f] += len(gone)
                found[part, "".join(order), step] = (
                    len(left), len(gone), redundant, alone, sum(r[1] for r in gone), sum(r[2] for r in gone), f,
                )
    return {k: (*v[:6], shapley[k[0], v[6]]) for k, v in found.items()}


CONDITIONS = {
    "A": "n_words < 200", "B": "100 * n_distinct < 50 * n_words", "C": "100 * n_capitals > 3 * n_points", "D": "n_symbols > 0", "E": "copy",
}


def found_of(docs, labels):
    rows = audit_filters(docs, labels, {k: F.expr(c) for k, c in CONDITIONS.items()}).collect()
    return {tuple(r)[:3]: tuple(r)[3:] for r in rows}


def test_audit_equals_brute_force(spark):
    draw = random.Random(4)
    texts = [" ".join(draw.choice(["a", "Bc", "x#", "dd", "e", f"w{draw.randrange(400)}"]) for _ in range(draw.choice([3, 190, 260, 700]))) for _ in range(25)]
    docs = [(k, draw.choice([*texts, "", None]), draw.choice(["en", "de", None, ""])) for k in range(120)]
    docs += [docs[3], docs[3], (None, docs[0][1], "en"), (None, "alone", "fr")]
    labels = [(k, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for k in range(0, 120, 2)] + [(4, 1, 1), (None, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert found_of(frame, marks) == brute(docs, labels)


def test_awkward_and_empty_tables(spark):
    marks = spark.createDataFrame([(0, 1, None)], "doc_id long, quality int, toxic int")
    docs = awkward_docs(spark)
    given = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    assert found_of(docs, marks) == brute(given, [(0, 1, None)])
    assert found_of(no_docs(spark), marks) == {}
    assert len(found_of(docs, marks.limit(0))) == 2 * 600


def test_measures_keep_large_ids_and_other_columns(spark):
    rows = spark.createDataFrame([(2**60 + 1, "a b", 5), (None, None, None)], "doc_id long, text string, n_words int")
    found = text_measures(rows).collect()
    assert [tuple(r) for r in found] == [(2**60 + 1, 2, 2, 0, 0, 3), (None, 0, 0, 0, 0, 0)]
    assert found[0].__fields__ == ["doc_id", *MEASURES]


def test_number_of_filters_is_bounded(spark):
    rows = spark.createDataFrame([("p", 1, 0, 0, 3)], "part string, mask int, good int, toxic int, n long")
    assert interactions(rows, "AB").count() == 4
    for letters in ("", "AA", "ABCDEFGH"):
        with pytest.raises(ValueError, match="filters"):
            interactions(rows, letters)
