"""Quality by co-training of a content view and a metadata view.

The content view sees statistics of the text, the metadata view language, source
and the recorded length. Both are logistic regressions. In each round either one
is fitted on the labelled rows and the pseudo-labels that the other gave with
confidence to rows of an unlabelled pool. Then each view is calibrated on rows
that it was not fitted on (Platt scaling), and a last regression on the same rows
weighs the calibrated log odds; it scores all documents.

Missing texts count as empty, missing metadata as a value of its own. Repeated
label rows count once (good if any says so); labels without a document or of
NULL do not count. With labels of one class, or none, every score is that class
(0 without labels). The input may have any further columns.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from grainmill.llm.common import remainder
from grainmill.session import Scratch

MAX_LABELLED = 20_000
MAX_POOL = 20_000
ROUNDS = 3
CONFIDENT = 0.97
SOURCE_CELLS = 32

SYMBOLS = re.compile(r"[^\w\s.,;:!?'\"()\-]")
MARKS = re.compile(r"[.,;:!?]")
RUNS = re.compile(r"([!?*%$#&@|~^+=<>])\1+")


def content_features(text: str | None) -> list[float]:
    """Statistics of one whole text."""
    text = text or ""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    counts = Counter(words)
    lines = [line for line in text.split("\n") if line.strip()]
    repeated = sum(a == b for a, b in zip(words, words[1:], strict=False))
    letters = sum(map(str.isalpha, text))
    upper = 0 if text.islower() else sum(map(str.isupper, text))
    return [
        math.log1p(len(words)),
        letters / n,
        upper / max(1, letters),
        letters / chars,
        sum(map(str.isdigit, text)) / chars,
        len(SYMBOLS.findall(text)) / n,
        len(MARKS.findall(text)) / n,
        text.count("!") / n,
        text.count("|") / n,
        len(RUNS.findall(text)) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        repeated / n,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(w.isupper() for w in words) / n,
        min(1.0, len(lines) / n),
    ]


def metadata_features(lang, source, size) -> list[float]:
    """Cells of the language and the source, and the recorded length."""
    cells = [0.0] * (2 * SOURCE_CELLS)
    cells[xxhash.xxh64_intdigest(str(lang)) % SOURCE_CELLS] = 1.0
    cells[SOURCE_CELLS + xxhash.xxh64_intdigest(str(source)) % SOURCE_CELLS] = 1.0
    known = size is not None and size == size
    long = math.log1p(max(0.0, float(size))) if known else 0.0
    return [*cells, float(known), long, long * long]


VIEWS = ("content", "metadata")


def _with_views(docs: DataFrame, keep: list[Column]) -> DataFrame:
    @pandas_udf("array<double>")
    def content(texts: pd.Series) -> pd.Series:
        return pd.Series([content_features(t) for t in texts])

    @pandas_udf("array<double>")
    def metadata(langs: pd.Series, sources: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([metadata_features(*row) for row in zip(langs, sources, sizes, strict=True)])

    return docs.select(
        *keep,
        array_to_vector(content("text")).alias("content"),
        array_to_vector(metadata("lang", "source", F.col("n_chars").cast("double"))).alias("metadata"),
    )


def _odds(rows: DataFrame, model: LogisticRegressionModel, view: str) -> DataFrame:
    """With the log odds of a view."""
    rows = model.transform(rows)
    return rows.withColumn(f"{view}_odds", vector_to_array(f"{view}_raw")[1]).drop(f"{view}_raw", f"{view}_p")


def _fit(rows: DataFrame, features: str, strength: float = 0.01) -> LogisticRegressionModel:
    return LogisticRegression(
        featuresCol=features, labelCol="label", weightCol="weight", maxIter=40, regParam=strength,
        rawPredictionCol=f"{features}_raw", probabilityCol=f"{features}_p", predictionCol=f"{features}_label",
    ).fit(rows)


@dataclass
class QualityModel:
    views: dict[str, LogisticRegressionModel] | None
    scales: dict[str, tuple[float, float]]
    blend: tuple[float, float, float]
    constant: float

    def apply(self, docs: DataFrame, score: str = "score") -> DataFrame:
        """The rows with ``score``: 0 to 1, higher for better texts."""
        kept = [F.col(f"`{c}`") for c in docs.columns if c != score]
        if self.views is None:
            return docs.select(*kept, F.lit(self.constant).alias(score))
        rows = _with_views(docs, [F.struct(*kept).alias("row")])
        for view, model in self.views.items():
            rows = _odds(rows, model, view)
        total = F.lit(self.blend[2])
        for weight, view in zip(self.blend, VIEWS, strict=False):
            slope, shift = self.scales[view]
            total = total + weight * (slope * F.col(f"{view}_odds") + shift)
        value = 1 / (1 + F.exp(-total))
        return rows.select("row", value.alias("value")).select("row.*", F.col("value").alias(score))


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    max_labelled: int = MAX_LABELLED,
    max_pool: int = MAX_POOL,
    rounds: int = ROUNDS,
    confident: float = CONFIDENT,
) -> QualityModel:
    """Fit on labelled rows that are not held out, and on a pool of rows without a label.

    At most about ``max_labelled`` and ``max_pool`` rows are taken, by hashed id.
    """
    fold = remainder()
    part = 1_000_000
    known = (
        labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(fold != 2)
        .groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    )
    labelled = labels.select("doc_id").where("doc_id IS NOT NULL").distinct()
    with Scratch(docs.sparkSession) as scratch:
        known = scratch.settle(known)
        hashed = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(part))
        size, total = known.count(), docs.count()
        if size > max_labelled:
            known = known.where(hashed < int(part * max_labelled / size))
        taken = docs.select("doc_id", "text", "lang", "source", "n_chars")
        pool = taken.where("doc_id IS NOT NULL").where(hashed < min(part, int(part * max_pool / max(1, total))))
        pool = pool.join(labelled, "doc_id", "left_anti").withColumn("quality", F.lit(None).cast("int"))
        sample = taken.join(F.broadcast(known), "doc_id").unionByName(pool)
        sample = scratch.settle(
            _with_views(sample, [F.col("quality").cast("double").alias("label"), (fold == 3).alias("checking"), F.col("doc_id")])
        )
        own = sample.where("label IS NOT NULL").withColumn("weight", F.lit(1.0))
        classes = {r["label"] for r in own.select("label").distinct().collect()}
        if len(classes) < 2:
            return QualityModel(None, {}, (0.0, 0.0, 0.0), next(iter(classes), 0.0))
        fitting, checking = own.where("NOT checking"), own.where("checking")
        if fitting.select("label").distinct().count() < 2 or checking.select("label").distinct().count() < 2:
            fitting = checking = own
        columns = ["label", "weight", *VIEWS]
        unknown = sample.where("label IS NULL")
        given = {view: fitting.select(columns) for view in VIEWS}
        for turn in range(rounds):
            models = {view: _fit(given[view], view) for view in VIEWS}
            if turn == rounds - 1:
                break
            judged = unknown
            for view in VIEWS:
                judged = _odds(judged, models[view], view)
            judged = scratch.settle(judged)
            limit = math.log(confident / (1 - confident))
            for view, other in (VIEWS, VIEWS[::-1]):
                odds = F.col(f"{other}_odds")
                sure = judged.where(F.abs(odds) >= limit).select(
                    (odds > 0).cast("double").alias("label"), F.lit(0.5).alias("weight"), *VIEWS
                )
                given[view] = fitting.select(columns).union(sure)
        judged = checking
        for view in VIEWS:
            judged = _odds(judged, models[view], view)
        judged = scratch.settle(judged.select("label", "weight", *[f"{v}_odds" for v in VIEWS]))
        scales = {}
        for view in VIEWS:
            rows = judged.withColumn(view, array_to_vector(F.array(f"{view}_odds")))
            platt = _fit(rows, view, 1e-4)
            scales[view] = (float(platt.coefficients[0]), float(platt.intercept))
        both = [scales[v][0] * F.col(f"{v}_odds") + scales[v][1] for v in VIEWS]
        last = _fit(judged.withColumn("both", array_to_vector(F.array(*both))), "both", 1e-4)
        blend = (float(last.coefficients[0]), float(last.coefficients[1]), float(last.intercept))
    return QualityModel(models, scales, blend, 0.0)
