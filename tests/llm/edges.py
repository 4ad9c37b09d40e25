"""Awkward input that every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, class string, n int, score string, id int, row string"
LONG = "lorem ipsum dolor sit amet " * 8000


def awkward_docs(spark):
    """Missing values in every column, empty and long texts, repeated rows, clashing names."""
    texts = ["the same text of more than five words", "", None, "   \n\t ", "one", LONG, "Ünï çødé ✓ 𝔘 words here"]
    rows = [(k, t, "en", "src", len(t or ""), "c", k, "s", k, "r") for k, t in enumerate(texts)]
    rows += [rows[0], rows[0], (90, texts[0], None, None, None, None, None, None, None, None), (None, texts[0], *[None] * 8)]
    return spark.createDataFrame(rows, DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)
