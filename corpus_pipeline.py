"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from grainmill.llm.common import read
from grainmill.llm.decontaminate import benchmark_overlaps
from grainmill.llm.jaccard import jaccard_components
from grainmill.llm.packing import pack
from grainmill.llm.queries import tokenizer_path
from grainmill.llm.secrets import fit_secrets, redacted
from grainmill.llm.toxicity import fit_toxicity
from grainmill.session import bound_batches, discard, new_folder, settle, trim

BROADCAST_ROWS = 2_000_000


def unused(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    while name in docs.columns:
        name += "_"
    return name


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is not listed; rows without an id stay."""
    ids = settle(ids.select("doc_id").where("doc_id IS NOT NULL").distinct())
    few = ids.count() <= BROADCAST_ROWS  # 16 bytes a row
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti").select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be toxic go."""
    trim(spark)
    bound_batches(spark)
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"))
    score, toxic = unused(docs, "toxic_score"), unused(docs, "toxic")
    return model.apply(docs, score, toxic).where(F.col(toxic) == 0).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the Jaccard join, the document with the smallest id stays.

    Rows that share an id are one document; the least of them stays.
    """
    trim(spark)
    bound_batches(spark)
    found = jaccard_components(docs)
    kept = without(docs, found.where("component_id <> doc_id"))
    repeated = settle(found.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id"))
    if repeated.isEmpty():
        return kept
    columns = [F.col(f"`{c}`") for c in docs.columns]
    few = repeated.count() <= BROADCAST_ROWS
    twice = kept.join(F.broadcast(repeated) if few else repeated, "doc_id", "left_semi").select(columns)
    once = twice.groupBy("doc_id").agg(F.min(F.struct(*columns)).alias("row")).select("row.*")
    return without(kept, repeated).unionByName(once)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a passage with the benchmark go."""
    trim(spark)
    return without(docs, benchmark_overlaps(docs, read(spark, sf_dir, "benchmark")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; the length of a changed text is counted anew."""
    trim(spark)
    bound_batches(spark)
    model = fit_secrets(docs)

    @pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return redacted(texts, model)

    name = unused(docs, "masked")
    rows = docs.withColumn(name, masked("text"))
    size = F.when(F.col(name).eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.char_length(name))
    new = {"text": F.col(name), "n_chars": size.cast(docs.schema["n_chars"].dataType)}
    return rows.select([new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    trim(spark)
    bound_batches(spark)
    return pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("jaccard", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("packing", packing),
]
# Learned models, graph components and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            discard(spark, before)
        before = path
    return docs
