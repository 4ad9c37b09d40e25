"""What the operators share: column access, held-out rows, balanced joins, one-pass writing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
HOT_SHARE = 1000

# Bytes of ASCII punctuation, blanks and controls become blanks, A-Z become a-z.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of letters, digits and non-ASCII characters, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4: 2 marks held-out rows. NULL for a missing id."""
    return F.crc32(F.col(doc_id).cast("string")) % 4


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(remainder(doc_id) == 2, F.lit(False))


def map_batches(
    df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """``mapInPandas`` for a function of one batch."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return df.mapInPandas(each, schema)


def join_unique(
    rows: DataFrame, table: DataFrame, key: str, count: str, by: str, how: str = "inner"
) -> DataFrame:
    """Join with a table that has one row per key, also if a key holds most rows.

    ``count`` is a column of ``table``: the rows that have the key. Keys with
    more than a thousandth of the total (fewer than 1,000 keys can) are spread
    by the hash of column ``by`` of the rows, over as many salts as their count
    needs; the table's row is copied for each. Both column names of the key
    must agree, no other names may.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    share = max(1, total // HOT_SHARE)
    salts = F.ceil(F.col(count) / share).cast("int")
    hot = F.broadcast(  # below HOT_SHARE rows
        table.where(F.col(count) > share).select(F.col(key), salts.alias("_salts"))
    )
    spread = F.pmod(F.xxhash64(by), F.coalesce(F.col("_salts"), F.lit(1))).cast("int")
    salted = rows.join(hot, key, "left").withColumn("_salt", spread).drop("_salts")
    last = F.when(F.col(count) > share, salts - 1).otherwise(0)
    copied = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), last)))
    return salted.join(copied, [key, "_salt"], how).drop("_salt")
