import random

from edges import awkward_docs, no_docs
from grainmill.llm.toxicity import FEATURES, features, fit_toxicity, plain_word

LABELS = "doc_id long, toxic int"


def test_plain_word_undoes_obfuscation():
    assert plain_word("Id1ot!!") == "idiot"
    assert plain_word("i.d.i.o.t") == "idiot"
    assert plain_word("(Stuuuupid),") == "stupid"
    assert plain_word("***") == ""


def test_features_have_fixed_length_and_count_proximity():
    weights = {"idiot": 3.0, "lowe-": 2.0}
    assert len(features(None, weights)) == len(FEATURES) == len(features("x " * 50_000, weights))
    near = dict(zip(FEATURES, features("you are such an idiot", weights), strict=True))
    far = dict(zip(FEATURES, features("you " + "word " * 20 + "idiot", weights), strict=True))
    assert near["near"] > 0 and far["near"] == 0
    assert dict(zip(FEATURES, features("ein loweihr", weights), strict=True))["heaviest"] == 2.0


def _corpus(spark, n=600):
    draw = random.Random(5)
    words = [f"w{a}{b}" for a in "abcdefgh" for b in "klmnop"]
    rows, labels = [], []
    for k in range(n):
        text = [draw.choice(words) for _ in range(40)]
        toxic = k % 6 == 0
        if toxic:
            for _ in range(3):
                text[draw.randrange(40)] = draw.choice(["scumbag", "moronic", "idiot"])
        rows.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)


def test_held_out_accuracy_and_determinism(spark):
    docs, labels = _corpus(spark)
    model = fit_toxicity(docs, labels, trees=8)
    rows = model.apply(docs).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    right = sum(r["predicted"] == (r["doc_id"] % 6 == 0) for r in rows)
    assert right > 0.97 * len(rows)
    again = {r["doc_id"]: r["score"] for r in model.apply(docs).collect()}
    assert again == {r["doc_id"]: r["score"] for r in rows}


def test_awkward_rows_and_labels(spark):
    docs, labels = _corpus(spark)
    labels = labels.union(spark.createDataFrame([(None, 1), (3, None), (6, 0), (99999, 1)], LABELS))
    model = fit_toxicity(docs, labels, trees=3)
    odd = awkward_docs(spark)
    scored = model.apply(odd)
    assert scored.columns == [c for c in odd.columns if c != "score"] + ["score", "predicted"]
    rows = scored.collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert model.apply(no_docs(spark)).count() == 0


def test_without_labels_or_with_one_class(spark):
    docs, labels = _corpus(spark, 30)
    assert {r["score"] for r in fit_toxicity(docs, labels.limit(0)).apply(docs).collect()} == {0.0}
    ones = labels.selectExpr("doc_id", "1 AS toxic")
    assert {r["predicted"] for r in fit_toxicity(docs, ones).apply(docs).collect()} == {1}
    assert fit_toxicity(no_docs(spark), labels).apply(docs).count() == 30
