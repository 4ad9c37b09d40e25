import random

from edges import awkward_docs, no_docs
from grainmill.llm.quality import content_features, fit_quality, metadata_features

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _corpus(spark, n=500):
    draw = random.Random(4)
    words = [f"w{a}{b}" for a in "abcdefgh" for b in "klmnop"]
    rows, labels = [], []
    for k in range(n):
        text = " ".join(draw.choice(words) for _ in range(60)) + "."
        good = k % 5 != 0
        if not good:
            text = text.upper().replace(" ", "!! ") if k % 2 else (draw.choice(words) + " ") * 60
        rows.append((k, text, draw.choice(["en", "de"]), f"s{draw.randrange(5)}", len(text)))
        if k % 2 or k % 5 == 0:
            labels.append((k, int(good)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy_and_awkward_rows(spark):
    docs, labels = _corpus(spark)
    odd_labels = labels.union(spark.createDataFrame([(None, 1), (1, None), (99999, 0), (3, 1)], "doc_id long, quality int"))
    model = fit_quality(docs, odd_labels)
    rows = model.apply(docs).collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum((r["score"] >= 0.5) == (r["doc_id"] % 5 != 0) for r in rows) > 0.97 * len(rows)
    odd = awkward_docs(spark)
    scored = model.apply(odd)
    assert scored.columns == [c for c in odd.columns if c != "score"] + ["score"]
    assert len([r for r in scored.collect() if 0 <= r["score"] <= 1]) == odd.count()
    assert model.apply(no_docs(spark)).count() == 0


def test_one_class_and_no_labels(spark):
    docs, labels = _corpus(spark, 40)
    assert {r["score"] for r in fit_quality(docs, labels.limit(0)).apply(docs).collect()} == {0.0}
    assert {r["score"] for r in fit_quality(docs, labels.selectExpr("doc_id", "1 AS quality")).apply(docs).collect()} == {1.0}


def test_features_take_missing_values():
    assert len(content_features(None)) == len(content_features("A b! | | x\nx\nx"))
    assert len(metadata_features(None, None, None)) == len(metadata_features("en", "s", 5.0))
