"""Categorical columns: detection, one-hot and label encoding."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.functions.columns import (
    col,
    integer_columns,
    require,
    string_columns,
    tidy,
)
from grainmill.plans.counts import distinct_counts
from grainmill.plans.lookup import balanced_lookup
from grainmill.plans.ordering import ROWS_PER_BLOCK, with_blocks, with_running_total
from grainmill.session import settle

# Words that suggest an order, the orders that are recognised, and
# the number of values up to which an integer column may be categorical.
ORDINAL_WORDS = ["low", "medium", "high", "small", "large", "poor", "good"]
ORDINAL_SCALES = [
    ["low", "medium", "high"],
    ["small", "medium", "large"],
    ["poor", "fair", "good", "excellent"],
    ["bad", "average", "good", "great"],
    ["never", "rarely", "sometimes", "often", "always"],
]
FEW_INTEGERS = 10
PREVIEW_VALUES = 20
# New columns that one-hot encoding makes unless told otherwise.
MAX_CATEGORIES = 10_000


def detect_categorical(df: DataFrame, samples: int = 0) -> DataFrame:
    """Text columns and integer columns with few values, with an encoding.

    With ``samples`` also ``sample_values``: so many of the values as texts, the
    first ones in the order of texts. They come from the same distinct pairs as
    the counts, cut before the shuffle.
    """
    texts, numbers = string_columns(df), integer_columns(df)
    columns = [c for c in df.columns if c in texts or c in numbers]
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        if c in texts:
            ordinal = F.lower(col(c)).rlike("|".join(ORDINAL_WORDS))
            aggs.append(F.coalesce(F.bool_or(ordinal), F.lit(False)).alias(f"o{i}"))
    found = tidy(
        df.agg(*aggs),
        [
            {
                "column": F.lit(c),
                "dtype": F.lit(df.schema[c].dataType.simpleString()),
                "is_text": F.lit(c in texts),
                "ordinal": F.col(f"o{i}") if c in texts else F.lit(False),
            }
            for i, c in enumerate(columns)
        ],
    )
    # One row per column of the table on either side.
    unique = F.broadcast(distinct_counts(df, columns))
    kind = F.when(F.col("ordinal"), "ordinal").when(F.col("is_text"), "nominal")
    chosen = []
    if samples:
        texts_only = df.select(*[col(c).cast("string").alias(c) for c in columns])
        pairs = texts_only.unpivot([], [col(c) for c in columns], "column", "value").where("value IS NOT NULL").distinct()
        order = Window.partitionBy("column").orderBy("value")
        first = pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= samples)
        shown = first.groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("sample_values"))
        # One row per column here too.
        found = found.join(F.broadcast(shown), "column", "left")
        chosen = [F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values")]
    return (
        found.join(unique, "column")
        .where(F.col("is_text") | (F.col("unique_count") <= FEW_INTEGERS))
        .select(
            "column",
            "dtype",
            "unique_count",
            kind.otherwise("possible_categorical").alias("category_type"),
            F.when(F.col("ordinal"), "label").otherwise("one_hot").alias("suggested_encoding"),
            *chosen,
        )
    )


def _categories(df: DataFrame, column: str) -> DataFrame:
    """Distinct present values; a hot value is reduced before the shuffle."""
    return df.select(col(column).alias("value")).where("value IS NOT NULL").distinct()


def _sorted_categories(df: DataFrame, column: str, limit: int | None) -> list[Any] | None:
    """Sorted values, or ``None`` if there are more than ``limit``."""
    found = _categories(df, column)
    rows = (found if limit is None else found.limit(limit + 1)).collect()
    return sorted(r["value"] for r in rows) if limit is None or len(rows) <= limit else None


@dataclass
class OneHot:
    column: str
    values: list[Any]
    drop_first: bool = False

    @property
    def new_columns(self) -> list[str]:
        kept = self.values[1:] if self.drop_first else self.values
        return [f"{self.column}_{v}" for v in kept]

    def apply(self, df: DataFrame) -> DataFrame:
        """Boolean column per value at the end; a missing value gives all false."""
        kept = self.values[1:] if self.drop_first else self.values
        flags = [
            col(self.column).eqNullSafe(F.lit(v)).alias(name)
            for v, name in zip(kept, self.new_columns)
        ]
        others = [col(c) for c in df.columns if c != self.column]
        return df.select(*others, *flags)


def fit_one_hot(
    df: DataFrame, column: str, drop_first: bool = False, max_values: int | None = MAX_CATEGORIES
) -> OneHot:
    """A column for every value; with more than ``max_values`` it fails before they are collected.

    ``None`` sets no limit.
    """
    require(df, [column])
    values = _sorted_categories(df, column, max_values)
    if values is None:
        raise ValueError(f"{column!r} has more than {max_values} values")
    return OneHot(column, values, drop_first)


@dataclass
class Labels:
    """Fitted label encoding: a table of value, label and n, the rows with that value."""

    column: str
    table: DataFrame
    size: int = 0
    total: int = 0

    def apply(self, df: DataFrame) -> DataFrame:
        """Replace the column; unmapped and missing values become NULL."""
        # Columns are numbered for the join, so that no name can clash.
        rows = df.select(*[col(c).alias(f"_c{i}") for i, c in enumerate(df.columns)])
        key = f"_c{df.columns.index(self.column)}"
        table = self.table.select(F.col("value").alias(key), F.col("label").alias("_label"), "n")
        joined = balanced_lookup(rows, table.drop("n"), table, key, self.total, self.size, "left")
        return joined.select(
            *[
                F.col("_label" if c == self.column else f"_c{i}").alias(c)
                for i, c in enumerate(df.columns)
            ]
        )


def _given_labels(df: DataFrame, column: str, mapping: dict[Any, Any]) -> Labels:
    """Labels as the caller gave them: whole numbers, numbers, booleans or texts."""
    labels = [v for v in mapping.values() if v is not None]
    label: T.DataType = T.StringType()
    if labels and all(isinstance(v, bool) for v in labels):
        label = T.BooleanType()
    elif all(isinstance(v, int) and not isinstance(v, bool) for v in labels):
        label = T.LongType()
    elif all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in labels):
        label = T.DoubleType()
    python = {T.StringType: str, T.BooleanType: bool, T.LongType: int, T.DoubleType: float}[type(label)]
    rows = [(k, None if v is None else python(v), 1) for k, v in mapping.items()]
    schema = T.StructType(
        [
            T.StructField("value", df.schema[column].dataType),
            T.StructField("label", label),
            T.StructField("n", T.LongType()),
        ]
    )
    return Labels(column, df.sparkSession.createDataFrame(rows, schema), len(rows), len(rows))


def fit_labels(
    df: DataFrame,
    column: str,
    mapping: dict[Any, Any] | str = "auto",
    rows_per_block: int = ROWS_PER_BLOCK,
) -> Labels:
    """Labels from a known scale (from 1), else in text order (from 0).

    A mapping given as a dict is used as it is. All values are counted once;
    the labels are a table of them, however many there are.
    """
    require(df, [column])
    if mapping != "auto":
        return _given_labels(df, column, mapping)
    counts = settle(
        df.where(col(column).isNotNull())
        .groupBy(col(column).alias("value"))
        .agg(F.count("*").alias("n"), F.lit(1).alias("one"))
        .withColumn("text", F.col("value").cast("string"))
    )
    aggs = [F.count("*").alias("size"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")]
    text = isinstance(df.schema[column].dataType, T.StringType)
    word = F.lower("text")
    if text:
        aggs += [F.bool_and(word.isin(scale)).alias(f"s{i}") for i, scale in enumerate(ORDINAL_SCALES)]
    seen = counts.agg(*aggs).first().asDict()
    scale = next((s for i, s in enumerate(ORDINAL_SCALES) if seen.get(f"s{i}")), None)
    if scale:
        label = F.array_position(F.array(*map(F.lit, scale)), word).cast("bigint")
        table = counts.select("value", label.alias("label"), "n")
    else:
        numbered = with_running_total(
            with_blocks(counts, ["text"], rows_per_block, seen["size"]), ["text"], "one", "label"
        )
        table = settle(numbered.select("value", "label", "n"))
    return Labels(column, table, seen["size"], seen["total"])


@dataclass
class Encoding:
    """Fitted encoders in the order in which they are applied."""

    steps: list[OneHot | Labels] = field(default_factory=list)
    errors: dict[str, str] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step.apply(df)
        return df

    def stats_frame(self, spark) -> DataFrame:
        rows = []
        for step in self.steps:
            if isinstance(step, OneHot):
                names = ",".join(step.new_columns)
                rows.append((step.column, "one_hot", len(step.new_columns), names, None))
            else:
                rows.append((step.column, "label", step.size, step.column, None))
        rows += [(c, None, None, None, e) for c, e in self.errors.items()]
        return spark.createDataFrame(
            rows, "column string, method string, size bigint, new_columns string, error string"
        )

    def mapping_frame(self, spark) -> DataFrame:
        """The labels of all label-encoded columns: column, value and label as text."""
        found = spark.createDataFrame([], "column string, value string, label string")
        for step in self.steps:
            if isinstance(step, Labels):
                text = [F.col(c).cast("string").alias(c) for c in ("value", "label")]
                found = found.union(step.table.select(F.lit(step.column).alias("column"), *text))
        return found


def fit_encoding(df: DataFrame, config: dict[str, dict[str, Any]]) -> Encoding:
    """Encoders per column; unknown columns are skipped, failures recorded."""
    fitted = Encoding()
    for c, conf in config.items():
        if c not in df.columns:
            continue
        method = conf.get("method", "one_hot")
        try:
            if method == "one_hot":
                fitted.steps.append(fit_one_hot(df, c, conf.get("drop_first", False)))
            elif method == "label":
                fitted.steps.append(fit_labels(df, c, conf.get("mapping", "auto")))
            else:
                fitted.errors[c] = f"no such method: {method}"
        except ValueError as error:
            fitted.errors[c] = str(error)
    return fitted


def encode_categorical(
    df: DataFrame, config: dict[str, dict[str, Any]]
) -> tuple[DataFrame, DataFrame]:
    """Encoded table and one row of statistics per encoded column."""
    fitted = fit_encoding(df, config)
    return fitted.apply(df), fitted.stats_frame(df.sparkSession)


def encoding_preview(df: DataFrame, column: str, method: str = "one_hot") -> DataFrame:
    """The first values with the column or the label they would get."""
    require(df, [column])
    if method not in ("one_hot", "label"):
        raise ValueError(f"method must be one_hot or label, not {method!r}")
    values = _categories(df, column)
    total = values.count()
    if method == "one_hot":
        first = values.orderBy("value").limit(PREVIEW_VALUES)
        return first.select(
            F.col("value").cast("string").alias("value"),
            F.concat(F.lit(column + "_"), F.col("value").cast("string")).alias("result"),
            F.lit(total).cast("bigint").alias("total_values"),
        )
    table = fit_labels(df, column).table.select(
        F.col("value").cast("string").alias("value"), F.col("label").alias("result")
    )
    return table.orderBy("result", "value").limit(PREVIEW_VALUES).select(
        "value", F.col("result").cast("string").alias("result"), F.lit(total).cast("bigint").alias("total_values")
    )
