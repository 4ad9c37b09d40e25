"""Read and write tables as CSV, JSON and Parquet."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions.columns import col, missing_as_null, string_columns, tidy
from grainmill.operators.schema import (
    apply_schema_overrides,
    is_number_text,
)

# Delimiters in order of preference, the texts that mean
# "missing" in a CSV file, the file formats and the size of the sniffed head.
DELIMITERS = [",", ";", "\t", "|"]
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json"}
HEAD_CHARACTERS = 4096
UTF8, FALLBACK = "UTF-8", "ISO-8859-1"
# A JSON array holds so many records and characters at most.
ARRAY_RECORDS, ARRAY_CHARACTERS = 5000, 8_000_000
# All six digits of the seconds are written.
TIME_LAYOUT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
READ_TIME_LAYOUT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]"


def file_format(path: str, fmt: str | None = None) -> str:
    if fmt in FORMATS.values():
        return fmt
    suffix = PurePosixPath(path).suffix.lower()
    if fmt is None and suffix in FORMATS:
        return FORMATS[suffix]
    raise ValueError(f"format must be one of {list(FORMATS.values())}, not {fmt or suffix!r}")


def delimiter_counts(df: DataFrame, column: str) -> DataFrame:
    """How often each delimiter occurs in a text column, and which one wins."""
    text = col(column)
    totals = df.agg(
        *[
            F.coalesce(F.sum(F.length(text) - F.length(F.replace(text, F.lit(d)))), F.lit(0))
            .alias(f"d{i}")
            for i, d in enumerate(DELIMITERS)
        ]
    )
    best = F.greatest(*[F.col(f"d{i}") for i in range(len(DELIMITERS))])
    winner = F.array_position(F.array(*[F.col(f"d{i}") for i in range(len(DELIMITERS))]), best)
    return totals.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(d).alias("delimiter"),
                        F.col(f"d{i}").alias("occurrences"),
                        (winner == i + 1).alias("chosen"),
                    )
                    for i, d in enumerate(DELIMITERS)
                ]
            )
        )
    )


def _head(spark: SparkSession, path: str, size: int) -> str:
    """The first characters of the first non-empty file at the path."""
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    first = files.select("path").orderBy("path").first()
    if first is None:
        return ""
    lines = spark.read.text(first["path"])
    rows = lines.select(F.substring("value", 1, size)).limit(size).collect()
    return "\n".join(r[0] for r in rows)[:size]


def detect_delimiter(spark: SparkSession, path: str, head_characters: int = HEAD_CHARACTERS) -> str:
    """Delimiter with most occurrences in the head; a comma if there is none.

    The head is the first ``head_characters`` of the first file that is not
    empty, also of a folder of files: all are taken to have one layout.
    """
    return max(DELIMITERS, key=_head(spark, path, head_characters).count)


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 if every line is valid UTF-8, else Latin-1."""
    # Line breaks are the same bytes in both encodings.
    broken = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count()
    return FALLBACK if broken else UTF8


def _tokens_to_null(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.when(~col(c).isin(MISSING_TOKENS), col(c)).alias(c)
            if c in set(string_columns(df))
            else col(c)
            for c in df.columns
        ]
    )


def infer_types(df: DataFrame) -> DataFrame:
    """Cast text columns that hold only numbers, or only true and false.

    Dates and other words stay text; ``detect_schema`` suggests types for them.
    """
    found = {
        r["column"]: r["inferred_type"]
        for r in _type_tests(df).collect()
        if r["inferred_type"] is not None
    }
    return apply_schema_overrides(df, found)


def _type_tests(df: DataFrame) -> DataFrame:
    texts = string_columns(df)
    aggs = []
    for i, c in enumerate(texts):
        whole = col(c).rlike(r"^\s*[+-]?\d+\s*$") & F.trim(col(c)).try_cast("bigint").isNotNull()
        aggs += [
            ((F.count(col(c)) > 0) & (F.count_if(whole) == F.count(col(c)))).alias(f"int{i}"),
            is_number_text(col(c)).alias(f"num{i}"),
            F.bool_and(F.lower(col(c)).isin("true", "false")).alias(f"bool{i}"),
        ]
    return tidy(
        df.agg(*aggs),
        [
            {
                "column": F.lit(c),
                "inferred_type": F.when(F.col(f"int{i}"), "int64")
                .when(F.col(f"num{i}"), "float64")
                .when(F.col(f"bool{i}"), "boolean"),
            }
            for i, c in enumerate(texts)
        ],
    )


def read_csv(
    spark: SparkSession,
    path: str,
    delimiter: str | None = None,
    encoding: str | None = None,
    types: dict[str, str] | None = None,
    infer: bool = True,
    multiline: bool = False,
) -> DataFrame:
    """CSV with a header line; delimiter and encoding are detected if not given.

    Files are split. If values contain line breaks, pass ``multiline=True``;
    each file is then read by one task. ``types`` saves the pass that infers
    them, ``delimiter`` and ``encoding`` those that detect them.
    """
    delimiter = delimiter or detect_delimiter(spark, path)
    encoding = encoding or detect_encoding(spark, path)
    raw = (
        spark.read.option("header", True)
        .option("sep", delimiter)
        .option("encoding", encoding)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
        .csv(path)
    )
    clean = _tokens_to_null(raw)
    if types is not None:
        return apply_schema_overrides(clean, types)
    return infer_types(clean) if infer else clean


def read_json(spark: SparkSession, path: str, lines: bool = False, schema=None) -> DataFrame:
    """One array of records (or one record) per file, or one record per line.

    A file without ``lines`` is read by one task and must hold one root: Spark
    takes the first array or object of a file and passes over others.
    ``write_json_arrays`` writes such files, of bounded size. For large data use
    JSON lines, which are split.
    """
    reader = spark.read.option("multiLine", not lines)
    reader = reader.option("timestampNTZFormat", READ_TIME_LAYOUT)
    if schema is not None:
        reader = reader.schema(schema)
    return missing_as_null(reader.json(path))


def read_parquet(spark: SparkSession, path: str, nan_to_null: bool = True) -> DataFrame:
    """Parquet table; without NaN in it, pass ``nan_to_null=False``.

    Filters on float columns then reach the scan.
    """
    table = spark.read.parquet(path)
    return missing_as_null(table) if nan_to_null else table


def read_table(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Read a file or folder in the format given or told by its suffix."""
    reader = {"csv": read_csv, "json": read_json, "parquet": read_parquet}
    return reader[file_format(path, fmt)](spark, path, **options)


def ingest_metadata(
    spark: SparkSession, path: str, fmt: str | None = None, **options
) -> DataFrame:
    """One row: format, encoding, delimiter, number of rows and columns."""
    kind = file_format(path, fmt)
    encoding = delimiter = None
    if kind == "csv":
        delimiter = options.pop("delimiter", None) or detect_delimiter(spark, path)
        encoding = options.pop("encoding", None) or detect_encoding(spark, path)
        options = {"infer": False, **options, "delimiter": delimiter, "encoding": encoding}
    table = read_table(spark, path, kind, **options)
    return table.agg(F.count("*").alias("row_count")).select(
        F.lit(PurePosixPath(path).name).alias("source_file"),
        F.lit(kind).alias("format"),
        F.lit(encoding).cast("string").alias("encoding"),
        F.lit(delimiter).cast("string").alias("delimiter"),
        "row_count",
        F.lit(len(table.columns)).cast("bigint").alias("col_count"),
    )


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.option("header", True).option("escape", '"').option("quote", '"')
    # The empty text stays apart from a missing value only in quotes.
    writer = writer.option("emptyValue", '""').option("nullValue", "")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """One record per line, missing values included."""
    writer = df.write.option("ignoreNullFields", False)
    writer.option("timestampNTZFormat", TIME_LAYOUT).json(path)


def write_json_arrays(df: DataFrame, path: str) -> None:
    """One array of records a file, missing values included.

    Arrays are bounded, so that files and tasks grow with the rows.
    """
    options = {"ignoreNullFields": "false", "timestampNTZFormat": TIME_LAYOUT}
    records = df.select(F.to_json(F.struct(*[col(c) for c in df.columns]), options).alias("record"))
    arrays = records.mapInPandas(_arrays, "value string")
    arrays.write.option("maxRecordsPerFile", 1).text(path)


def _arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for batch in batches:
        for record in batch["record"]:
            if held and (len(held) == ARRAY_RECORDS or size + len(record) > ARRAY_CHARACTERS):
                yield pd.DataFrame({"value": [f"[{','.join(held)}]"]})
                held, size = [], 0
            held.append(record)
            size += len(record)
    if held:
        yield pd.DataFrame({"value": [f"[{','.join(held)}]"]})


def write_table(df: DataFrame, path: str, fmt: str | None = None, **options) -> None:
    """Write a folder in the format given or told by the suffix of its name."""
    writer = {"csv": write_csv, "json": write_json, "parquet": write_parquet}
    writer[file_format(path, fmt)](df, path, **options)
