"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned first: words and stems that are far more frequent in toxic
than in other labelled texts, after undoing simple obfuscation. Features are densities
of lexicon words and their weight, hits near second-person words, capitals,
punctuation and obfuscation rates. Trees are fitted on two of three folds of
the labelled rows and calibrated on the third.

Missing texts count as empty; an empty text gets a score like any other.
Repeated label rows of a document count once (toxic if any says so), labels
without a document or of NULL do not count. With labels of one class only, or
none, every score is that class (0 without labels). The input may have any
columns besides ``doc_id`` and ``text``; results are named as documented.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from grainmill.llm.common import remainder
from grainmill.session import Scratch

MAX_LABELLED = 40_000
LEXICON_SIZE = 400
THRESHOLD = 0.3
NEAR = 5
STEMS = (4, 5, 6)

SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer sie "
    "tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
)
LEET = str.maketrans("013457@$!|+", "oieastasiit")
EDGES = ".,;:?\"'()[]{}<>*#%&~`-_=/\\"
REPEATS = re.compile(r"(.)\1{2,}")
INNER = re.compile(r"[^\w]|_")
MARKS = re.compile(r"[!?.]{2,}")


def plain_word(word: str) -> str:
    """A word as the lexicon has it: lower case, leet letters and marks inside undone."""
    word = word.lower().strip(EDGES)
    if not word.isalpha():
        bare = word.rstrip("!")
        word = bare if bare.isalpha() else INNER.sub("", bare.translate(LEET))
    return REPEATS.sub(r"\1", word) if len(word) > 2 else word


def keys_of(word: str) -> list[str]:
    """What the lexicon may know a word by: itself, or a stem, written with a hyphen."""
    return [word, *(f"{word[:k]}-" for k in STEMS if len(word) > k)]


def distinct_keys(text: str | None) -> list[str]:
    words = {plain_word(raw) for raw in (text or "").split()} - {""}
    return list({key for word in words for key in keys_of(word)})


FEATURES = [
    "length", "density", "weight", "heaviest", "distinct", "near", "second", "capitals",
    "shouting", "exclamations", "questions", "punctuation", "runs", "odd", "hidden", "stretched",
]


def features(text: str | None, weights: dict[str, float]) -> list[float]:
    """The dense features of one whole text."""
    text = text or ""
    raw = text.split()
    n = max(1, len(raw))
    chars = max(1, len(text))
    shortest = [w.lower().strip(EDGES) for w in raw]
    unusual = [i for i, w in enumerate(shortest) if w and not w.isalpha()]
    plain = shortest
    for i in unusual:
        plain[i] = plain_word(raw[i])
    present = set(plain)
    stretched = [w for w in present if len(w) > 2 and REPEATS.search(w)]
    if stretched:
        undone = {w: REPEATS.sub(r"\1", w) for w in stretched}
        plain = [undone.get(w, w) for w in plain]
        present = set(plain)
    found = {}
    for word in present:
        known = [weights[k] for k in keys_of(word) if k in weights]
        if known:
            found[word] = max(known)
    hits = [i for i, w in enumerate(plain) if w in found] if found else []
    people = [i for i, w in enumerate(plain) if w in SECOND_PERSON] if present & SECOND_PERSON else []
    near = 0
    if hits and people:
        at = np.searchsorted(people, hits)
        sides = np.concatenate([[-10 * NEAR - n], people, [10 * NEAR + 2 * n]])
        gaps = np.minimum(np.array(hits) - sides[at], sides[at + 1] - np.array(hits))
        near = int((gaps <= NEAR).sum())
    odd = set(unusual)
    values = [found[plain[i]] for i in hits]
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    marks = {c: text.count(c) for c in "!?.,;:*#%$&@|"}
    return [
        math.log1p(len(raw)),
        len(hits) / n,
        sum(values) / n,
        max(values, default=0.0),
        float(len(found)),
        near / n,
        len(people) / n,
        upper / chars,
        sum(w.isupper() for w in raw) / n,
        marks["!"] / n,
        marks["?"] / n,
        sum(marks.values()) / chars,
        len(MARKS.findall(text)) / n,
        len(unusual) / n,
        sum(i in odd for i in hits) / n,
        len(stretched) / n,
    ]


def _features_column(weights: dict[str, float]):
    @pandas_udf("array<double>")
    def dense(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t, weights) for t in texts])

    return dense


@dataclass
class ToxicityModel:
    """What scoring needs; all of it has a size that the labelled rows do not change."""

    weights: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    constant: float
    threshold: float

    def apply(self, docs: DataFrame, score: str = "score", predicted: str = "predicted") -> DataFrame:
        """The rows with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on)."""
        kept = [F.col(f"`{c}`") for c in docs.columns if c not in (score, predicted)]
        if self.trees is None:
            value = F.lit(self.constant)
            return docs.select(*kept, value.alias(score), (value >= self.threshold).cast("int").alias(predicted))
        dense = array_to_vector(_features_column(self.weights)(F.col("text")))
        rows = docs.select(F.struct(*kept).alias("row"), dense.alias("features"))
        rows = self.trees.transform(rows).select(
            "row", vector_to_array("probability")[1].alias("margin")
        )
        if self.calibration is None:
            rows = rows.withColumn("calibrated", F.col("margin"))
        else:
            rows = self.calibration.transform(rows)
        value = F.least(F.greatest(F.col("calibrated"), F.lit(0.0)), F.lit(1.0))
        rows = rows.select("row", value.alias("value"))
        return rows.select(
            "row.*", F.col("value").alias(score),
            (F.col("value") >= self.threshold).cast("int").alias(predicted),
        )


def _lexicon(rows: DataFrame, positives: int, negatives: int) -> dict[str, float]:
    """Weights (log odds) of the words and stems that set toxic rows apart, LEXICON_SIZE at most."""

    @pandas_udf("array<string>")
    def keys(texts: pd.Series) -> pd.Series:
        return pd.Series([distinct_keys(t) for t in texts])

    toxic = F.sum(F.col("toxic"))
    counts = (
        rows.select("toxic", F.explode(keys("text")).alias("word"))
        .groupBy("word")
        .agg(toxic.alias("a"), (F.count("*") - toxic).alias("b"))
    )
    odds = F.log((F.col("a") + 0.5) / (positives + 1)) - F.log((F.col("b") + 0.5) / (negatives + 1))
    support = max(3, positives // 100)
    best = (
        counts.where(F.col("a") >= support)
        .select("word", odds.alias("odds"), (odds * F.sqrt("a")).alias("rank"))
        .where(F.col("odds") > 2.5)
        .orderBy(F.desc("rank"), "word")
        .limit(LEXICON_SIZE)
    )
    return {r["word"]: r["odds"] for r in best.collect()}


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    max_labelled: int = MAX_LABELLED,
    threshold: float = THRESHOLD,
    trees: int = 20,
    depth: int = 3,
) -> ToxicityModel:
    """Fit on labelled rows that are not held out.

    Above ``max_labelled`` labelled documents, those whose hashed id is lowest
    in proportion are taken, so the model and the broadcast list of labels are
    bounded. Everything is scored, whatever was fitted on.
    """
    spark = docs.sparkSession
    fold = remainder()
    known = (
        labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
        .where(fold != 2)
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    with Scratch(spark) as scratch:
        known = scratch.settle(known)
        size = known.count()
        part = 1_000_000
        if size > max_labelled:
            limit = int(part * max_labelled / size)
            known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(part)) < limit)
        # A small surplus over max_labelled rows at most.
        sample = (
            docs.select("doc_id", "text")
            .join(F.broadcast(known), "doc_id")
            .select("toxic", "text", (fold == 3).alias("calibrate"))
        )
        sample = scratch.settle(sample)
        by = sample.groupBy("toxic").count().collect()
        counts = {r["toxic"]: r["count"] for r in by}
        if len(counts) < 2:
            constant = float(next(iter(counts), 0))
            return ToxicityModel({}, None, None, constant, threshold)
        weights = _lexicon(sample, counts[1], counts[0])
        dense = array_to_vector(_features_column(weights)(F.col("text")))
        rows = scratch.settle(
            sample.select(F.col("toxic").cast("double").alias("label"), "calibrate", dense.alias("features"))
        )
        fitting = rows.where("NOT calibrate")
        checking = rows.where("calibrate")
        if {r["label"] for r in fitting.select("label").distinct().collect()} != {0.0, 1.0}:
            fitting = rows
        model = GBTClassifier(
            maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.2, seed=7,
            minInstancesPerNode=2, cacheNodeIds=False,
        ).fit(fitting)
        margins = model.transform(checking).select(
            "label", vector_to_array("probability")[1].alias("margin")
        )
        calibration = None
        if len(checking.select("label").distinct().collect()) == 2:
            calibration = IsotonicRegression(
                featuresCol="margin", labelCol="label", predictionCol="calibrated"
            ).fit(margins)
    return ToxicityModel(weights, model, calibration, 0.0, threshold)
