import hashlib
import random
import re
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from edges import awkward_docs, no_docs
from grainmill.llm import secrets
from grainmill.llm.secrets import (
    GROUPS,
    KINDS,
    Field,
    Tokens,
    base_spans,
    find_spans,
    fit_secrets,
    joined,
    redacted,
    scan_secrets,
    tokens_of,
)
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def brute(text):
    found = []
    for m in re.finditer(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


PARTS = ["password", "Token", "api_key", "APIKEY", "=", ":", " ", '"', "AKIA", "ABCDEF0123456789XYZ", "deadbeef", "0a1b2c3d" * 3, "é", "🙂", "x", "\n", "secret", "abc.def-g"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_base_spans_equal_brute_force(text):
    assert [(k, a, b) for a, k, b, _ in base_spans(text)] == brute(text)


def _best_path(model, codes):
    """Viterbi of one chain, the plain way."""
    score, moves = model.scores(codes), model.barred()
    best = [score[0] + np.array([0, -1e9, 0])]
    for row in score[1:]:
        best.append((best[-1][:, None] + moves).max(0) + row)
    return max(best[-1])


@pytest.mark.parametrize("part", [1, 3, 256])
def test_decoding_and_gradient_of_chains(monkeypatch, part):
    """Lines are decoded as one chain, also across the parts of long ones."""
    monkeypatch.setattr(secrets, "PART", part)
    draw = np.random.default_rng(3)
    sizes = [1, 5, 3, 8]
    codes = np.stack([draw.integers(0, n, sum(sizes)) for n in GROUPS.values()], 1).astype(np.int32)
    chains = np.concatenate([[0], np.cumsum(sizes)])
    nothing = np.zeros(sum(sizes), np.int64)
    tokens = Tokens(nothing, nothing, chains, codes)
    model = Field([draw.normal(size=(n, 3)) for n in GROUPS.values()], draw.normal(size=(3, 3)), True)
    tags = model.decode(tokens)
    for a, b in zip(chains, chains[1:], strict=False):
        path, score, moves = tags[a:b], model.scores(codes[a:b]), model.barred()
        value = sum(score[k, t] for k, t in enumerate(path)) + sum(moves[x, y] for x, y in zip(path, path[1:], strict=False))
        assert abs(value - _best_path(model, codes[a:b])) < 1e-9
    # The gradient is zero in sum over the tags of each code, and training finds separable tags.
    gold = np.where(codes[:, 0] > 5, 0, 2)
    grads, _ = model.gradient(tokens, gold)
    assert all(np.allclose(g.sum(1), 0, atol=1e-8) for g in grads)
    fresh = Field()
    fresh.train(tokens, gold)
    assert (fresh.decode(tokens) == gold).all()


def _docs(spark, n=300):
    draw = random.Random(8)
    rows = []
    for k in range(n):
        words = ["".join(draw.choice("abcdefgiou") for _ in range(draw.randrange(2, 9))) for _ in range(30)]
        value = "".join(draw.choice("0123456789abcdef") for _ in range(draw.choice([18, 30, 40])))
        if k % 3 == 0:
            words[draw.randrange(30)] = draw.choice([f"password={value}", f'token = "{value}"', f"AKIA{value.upper()[:16]}", value])
        rows.append((k, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_the_field_finds_secrets_without_a_known_form(spark):
    model = fit_secrets(_docs(spark))
    assert model.trained
    texts = ['bearer: "7f3a99c01e5b42d8a6e1" end', "plain words without anything to hide", "access = 9c1e7f0a2b3d4c5e6f7a8b9"]
    spans = [s for _, s in find_spans(texts, model)]
    assert any(k == "model" for k, _, _ in spans[0]) and spans[1] == []
    for text, (base, found) in zip(texts, find_spans(texts, model), strict=True):
        assert set(base) <= set(found) and all(0 <= a < b <= len(text) for _, a, b in found)


def test_scan_gives_the_digest_columns(spark):
    docs = _docs(spark, 60)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = scan_secrets(docs, fit_secrets(docs)).select("doc_id", joined("base").alias("base"), F.sha2(joined("base"), 256).alias("sha"))
    for r in found.collect():
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(texts[r["doc_id"]]))
        assert r["base"] == text and r["sha"] == hashlib.sha256(text.encode()).hexdigest()


def test_redaction_masks_whole_spans():
    out = redacted(pd.Series(["é password=abcdef123 z", None, "", "clean"]), Field())
    assert list(out) == ["é [SECRET] z", None, "", "clean"]


def test_awkward_rows(spark):
    docs = awkward_docs(spark)
    model = fit_secrets(docs)
    assert not model.trained
    assert scan_secrets(docs, model).where("size(spans) > 0").count() == 0
    assert scan_secrets(docs, model).count() == docs.count()
    assert scan_secrets(no_docs(spark), fit_secrets(no_docs(spark))).count() == 0
    tokens, places = tokens_of([b"", b"a\xc3\xa9 b", b""])
    assert len(tokens.starts) == 2 and list(places) == [0, 1, 7, 8]


def test_a_span_across_parts_is_one_span(monkeypatch):
    """A model that only knows digits finds the same span wherever a long line is cut."""
    text = "plain words " * 200 + "k = a1b2c3d4e5f6g7h8 + i9j0k1l2m3n4 " + "more words " * 50
    lines = [f"value = {'x' * k}a1b2c3d4e5f6g7h8 end" for k in range(9)] + ["plain words and more of them"] * 9
    tokens, places = tokens_of([t.encode() for t in lines])
    gold = np.full(len(tokens.starts), 2, np.int8)
    for k, a in enumerate(tokens.starts):
        row = int(np.searchsorted(places, a, "right")) - 1
        if any(c.isdigit() for c in lines[row][a - places[row] : tokens.ends[k] - places[row]]):
            gold[k] = 0
    model = Field()
    model.train(tokens, gold.astype(np.int64))
    found = []
    for part in (1, 2, 7, 401, 402, 403, 10_000):
        monkeypatch.setattr(secrets, "PART", part)
        found.append(find_spans([text], model)[0][1])
    assert found[0] and all(f == found[0] for f in found)


def _peak(work):
    """The most bytes that are held at a time during the work, and its result."""
    tracemalloc.start()
    try:
        result = work()
        return tracemalloc.get_traced_memory()[1], result
    finally:
        tracemalloc.stop()


def test_a_scan_holds_the_tokens_of_few_texts_at_a_time():
    model = Field(trained=True)
    model.weights[0][:, 2] = 1.0  # all tokens are outside
    texts = ["plain words, and more of them. " * 30 + f"token = abcdef{k}" for k in range(4000)]
    peak, found = _peak(lambda: find_spans(texts, model))
    assert peak < 40e6 and all(base == spans and len(base) == 1 for base, spans in found)


def test_a_gradient_holds_few_numbers_a_token():
    draw = np.random.default_rng(5)
    n = 200_000
    codes = np.stack([draw.integers(0, k, n) for k in GROUPS.values()], 1).astype(np.int32)
    nothing = np.zeros(0, np.int64)
    tokens = Tokens(nothing, nothing, np.arange(0, n + 1, 100), codes)
    gold = np.where(codes[:, 0] > 5, 0, 2).astype(np.int64)
    peak, (grads, _) = _peak(lambda: Field().gradient(tokens, gold))
    assert peak < 150 * n and all(np.allclose(g.sum(1), 0, atol=1e-6) for g in grads)


@pytest.mark.parametrize("distinct", [1, 7, 20_000])
def test_few_lines_are_sent_to_choose_the_lowest(spark, distinct):
    lines = spark.range(0, 20_000, 1, 16).selectExpr(f"cast(cast(id % {distinct} as string) as binary) codes", "id gold")
    wanted = lines.orderBy(F.xxhash64("codes"), "gold").limit(100).collect()
    low = secrets._lowest(lines, 100)
    assert low.orderBy("place", "gold").limit(100).select("codes", "gold").collect() == wanted
    assert distinct < 20_000 or 100 <= low.count() < 300
    assert secrets._lowest(lines, 20_000).count() == 20_000
