"""Column type detection and casts that turn bad values into NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.functions import parsing
from grainmill.functions.columns import (
    NESTED_TYPES,
    SEMANTIC_KEY,
    col,
    integer_columns,
    percent,
    plain_columns,
    require,
    string_columns,
    tidy,
)
from grainmill.plans.counts import distinct_counts

# Limits of the low-cardinality and the identifier hint, and the
# ranges that make an integer column look like a zip code or a year.
CATEGORY_MAX_VALUES = 20
CATEGORY_MAX_SHARE = 0.05
IDENTIFIER_SHARE = 0.9
ZIP_RANGE = (10000, 99999)
YEAR_RANGE = (1900, 2100)


def _all_pass(test: Column, c: Column) -> Column:
    return (F.count(c) > 0) & (F.count_if(test) == F.count(c))


def _boolean_flags(c: Column) -> list[Column]:
    """Per word pair, whether all present values belong to it."""
    word = F.lower(c)
    return [F.coalesce(F.bool_and(word.isin(*pair)), F.lit(False)) for pair in parsing.BOOLEAN_PAIRS]


def _any_of(flags: list[Column]) -> Column:
    result = flags[0]
    for f in flags[1:]:
        result = result | f
    return result


def is_datetime_text(c: Column) -> Column:
    """Aggregate: every present text is a date or time."""
    return _all_pass(parsing.to_datetime(c).isNotNull(), c)


def is_number_text(c: Column) -> Column:
    """Aggregate: every present text is a number."""
    return _all_pass(parsing.to_number(c).isNotNull(), c)


def is_boolean_text(c: Column) -> Column:
    """Aggregate: all present texts, in any case, come from one word pair."""
    return _any_of(_boolean_flags(c.cast("string")))


def is_code_integer(c: Column) -> Column:
    """Aggregate: all values are five-digit codes, or all are years."""
    low, high = F.min(c), F.max(c)
    codes = (low >= ZIP_RANGE[0]) & (high <= ZIP_RANGE[1])
    years = (low >= YEAR_RANGE[0]) & (high <= YEAR_RANGE[1])
    return F.coalesce(codes | years, F.lit(False))


def _detection(df: DataFrame, columns: list[str], test) -> DataFrame:
    summary = df.agg(*[test(col(c)).alias(f"t{i}") for i, c in enumerate(columns)])
    return tidy(
        summary,
        [
            {"column": F.lit(c), "detected": F.col(f"t{i}")}
            for i, c in enumerate(columns)
        ],
    )


def detect_datetime_strings(df: DataFrame, columns=None) -> DataFrame:
    return _detection(df, columns or string_columns(df), is_datetime_text)


def detect_numeric_strings(df: DataFrame, columns=None) -> DataFrame:
    return _detection(df, columns or string_columns(df), is_number_text)


def detect_boolean_strings(df: DataFrame, columns=None) -> DataFrame:
    return _detection(df, columns or string_columns(df), is_boolean_text)


def detect_categorical_int(df: DataFrame, columns=None) -> DataFrame:
    return _detection(df, columns or integer_columns(df), is_code_integer)


def _type_name(dtype: T.DataType) -> str:
    return "nested" if isinstance(dtype, NESTED_TYPES) else dtype.simpleString()


def detect_schema(df: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """Per column: type, suggested type, distinct and missing counts, hint.

    Looks at the whole column. Distinct counts are exact unless estimates are
    asked for.
    """
    aggs = [F.count("*").alias("rows")]
    for i, f in enumerate(df.schema.fields):
        c = col(f.name)
        aggs.append(F.count(c).alias(f"n{i}"))
        if isinstance(f.dataType, T.StringType):
            aggs += [
                is_datetime_text(c).alias(f"date{i}"),
                is_number_text(c).alias(f"num{i}"),
                is_boolean_text(c).alias(f"bool{i}"),
            ]
        elif isinstance(f.dataType, T.IntegralType):
            aggs.append(is_code_integer(c).alias(f"code{i}"))
    summary = df.agg(*aggs)

    tests = []
    for i, f in enumerate(df.schema.fields):
        no = F.lit(False)
        text = isinstance(f.dataType, T.StringType)
        whole = isinstance(f.dataType, T.IntegralType)
        tests.append(
            {
                "column": F.lit(f.name),
                "type": F.lit(_type_name(f.dataType)),
                "is_text": F.lit(text),
                "is_whole": F.lit(whole),
                "rows": F.col("rows"),
                "present": F.col(f"n{i}"),
                "dates": F.col(f"date{i}") if text else no,
                "numbers": F.col(f"num{i}") if text else no,
                "booleans": F.col(f"bool{i}") if text else no,
                "codes": F.col(f"code{i}") if whole else no,
            }
        )
    # One row per column of the table on either side.
    unique_counts = F.broadcast(distinct_counts(df, plain_columns(df), approx_distinct))
    profile = tidy(summary, tests).join(unique_counts, "column", "left")

    unique, rows = F.col("unique_count"), F.col("rows")
    few = (unique <= CATEGORY_MAX_VALUES) & (unique < rows * CATEGORY_MAX_SHARE)
    identifier = (unique == rows) | (unique > rows * IDENTIFIER_SHARE)
    unknown = F.col("is_text") & (F.col("present") == 0)
    inferred = (
        F.when(unknown, "unknown")
        .when(F.col("dates"), "datetime")
        .when(F.col("numbers"), "float64")
        .when(F.col("booleans"), "boolean")
        .when(F.col("is_text") & few, "category")
        .otherwise(F.col("type"))
    )
    hint = (
        F.when(unknown, F.lit(None))
        .when(F.col("dates"), "potential datetime")
        .when(F.col("numbers"), "potential numeric")
        .when(F.col("booleans"), "potential boolean")
        .when(F.col("is_text") & few, "low cardinality")
        .when(F.col("is_whole") & identifier, "possible identifier")
        .when(F.col("codes"), "consider category or string")
    )
    missing = rows - F.col("present")
    return profile.select(
        "column",
        F.col("type").alias("original_type"),
        inferred.alias("inferred_type"),
        "unique_count",
        missing.alias("null_count"),
        percent(missing, rows).alias("null_pct"),
        hint.alias("suggestion"),
    )


def _check_targets(df: DataFrame, overrides: dict[str, str]) -> dict[str, str]:
    """Column to error text for overrides that cannot be planned."""
    problems = {}
    for name, target in overrides.items():
        if name not in df.columns:
            problems[name] = "column not found"
            continue
        try:
            source = df.schema[name].dataType
            df.select(parsing.cast_expression(col(name), source, target)).schema  # noqa: B018
        except Exception as error:  # analysis errors only, nothing runs here
            problems[name] = f"cannot convert to {target}: {type(error).__name__}"
    return problems


def apply_schema_overrides(df: DataFrame, overrides: dict[str, str]) -> DataFrame:
    """Cast the named columns; values that do not convert become NULL.

    Unknown columns and impossible targets leave the table as it is;
    ``cast_errors`` lists them.
    """
    bad = _check_targets(df, overrides)
    columns = []
    for f in df.schema.fields:
        target = overrides.get(f.name)
        if target is None or f.name in bad:
            columns.append(col(f.name))
            continue
        cast = parsing.cast_expression(col(f.name), f.dataType, target)
        meta = {**(f.metadata or {})}
        if target == "category":
            meta[SEMANTIC_KEY] = "category"
        columns.append(cast.alias(f.name, metadata=meta))
    return df.select(*columns)


def cast_errors(df: DataFrame, overrides: dict[str, str]) -> DataFrame:
    """Per override: how many present values would become NULL, or the error."""
    bad = _check_targets(df, overrides)
    good = {c: t for c, t in overrides.items() if c not in bad}
    aggs = [F.count("*").alias("rows")]
    for i, (name, target) in enumerate(good.items()):
        cast = parsing.cast_expression(col(name), df.schema[name].dataType, target)
        aggs.append(F.count_if(col(name).isNotNull() & cast.isNull()).alias(f"f{i}"))
    rows = [
        {
            "column": F.lit(name),
            "target": F.lit(target),
            "failed_count": F.col(f"f{i}"),
            "error": F.lit(None).cast("string"),
        }
        for i, (name, target) in enumerate(good.items())
    ]
    rows += [
        {
            "column": F.lit(name),
            "target": F.lit(overrides[name]),
            "failed_count": F.lit(None).cast("bigint"),
            "error": F.lit(text),
        }
        for name, text in bad.items()
    ]
    return tidy(df.agg(*aggs), rows)


def sample_values(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """A few present values of a column, the smallest ones."""
    require(df, [column])
    return (
        df.select(col(column).alias("value"))
        .where("value IS NOT NULL")
        .distinct()
        .orderBy("value")
        .limit(n)
    )


