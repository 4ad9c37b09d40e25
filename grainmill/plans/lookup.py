"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.functions.columns import quoted

HOT_KEYS = 1000
BROADCAST_BYTES = 16 << 20
# Of a row besides its key.
ROW_BYTES = 32


def _bytes(table: DataFrame, key: str) -> int:
    """About how much the table takes, keys at their real length."""
    length = F.coalesce(F.octet_length(F.col(quoted(key)).cast("string")), F.lit(0))
    return table.agg(F.coalesce(F.sum(length + ROW_BYTES), F.lit(0)).alias("n")).first()["n"]


def balanced_lookup(
    rows: DataFrame,
    table: DataFrame,
    counts: DataFrame,
    key: str,
    total: int,
    table_rows: int,
    how: str = "inner",
) -> DataFrame:
    """Inner or left join with a table that has one row per key.

    ``counts`` has the key and ``n``, the number of rows with it. A table that
    is small, by measured bytes, is broadcast. Else keys with more than a
    thousandth of all rows, fewer than a thousand of them, are spread by a salt,
    over as many tasks as their count needs, and so are rows without a key.
    """
    if table_rows * ROW_BYTES <= BROADCAST_BYTES and _bytes(table, key) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), key, how)
    share = max(1, total // HOT_KEYS)
    # Fewer than HOT_KEYS rows.
    hot = F.broadcast(
        counts.where(F.col("n") > share).select(
            quoted(key), F.ceil(F.col("n") / share).cast("int").alias("_salts")
        )
    )
    hashed = [quoted(c) for c, t in rows.dtypes if "map<" not in t]
    missing = F.when(F.col(quoted(key)).isNull(), HOT_KEYS).otherwise(1)
    salted = (
        rows.withColumn("_spread", F.xxhash64(*hashed))
        .join(hot, key, "left")
        .withColumn("_salt", F.pmod("_spread", F.coalesce("_salts", missing)).cast("int"))
        .drop("_spread", "_salts")
    )
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    copied = table.join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    return salted.join(copied, [key, "_salt"], how).drop("_salt")
