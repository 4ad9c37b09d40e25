"""Registration of queries and the input tables they are derived from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.sources.files import read_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# SQL that both engines run; {name} stands for a base table.
DERIVED = {
    # Missing values at known rates, two columns that go missing together.
    "dirty_events": """
        SELECT event_id, ts, user_id,
               CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS event_type,
               CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value,
               CASE WHEN event_id % 22 = 0 THEN NULL ELSE value * 2 + user_id END AS value2,
               CASE WHEN event_id % 5 < 3 THEN NULL ELSE value END AS mostly_missing,
               CAST(NULL AS DOUBLE) AS all_missing,
               1 AS const_col
        FROM {events}""",
    # Every 10th part twice, every 100th three times; one nullable key.
    "dup_part": """
        SELECT p_partkey, CASE WHEN p_partkey % 20 = 0 THEN NULL ELSE p_brand END AS p_brand,
               p_type, p_size, 0 AS copy_no FROM {part}
        UNION ALL
        SELECT p_partkey, CASE WHEN p_partkey % 20 = 0 THEN NULL ELSE p_brand END AS p_brand,
               p_type, p_size, 1 AS copy_no FROM {part} WHERE p_partkey % 10 = 0
        UNION ALL
        SELECT p_partkey, CASE WHEN p_partkey % 20 = 0 THEN NULL ELSE p_brand END AS p_brand,
               p_type, p_size, 2 AS copy_no FROM {part} WHERE p_partkey % 100 = 0""",
    # All text: input of type detection and casts.
    "text_typed": """
        SELECT o_orderkey,
               CAST(o_totalprice AS VARCHAR(40)) AS num_text,
               CASE WHEN o_orderkey % 50 = 0 THEN 'n/a'
                    ELSE CAST(o_totalprice AS VARCHAR(40)) END AS num_text_bad,
               CAST(CAST(o_orderdate AS DATE) AS VARCHAR(40)) AS date_text,
               CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'no' END AS bool_text,
               CASE WHEN o_orderkey % 3 = 0 THEN 'maybe' ELSE 'YES' END AS bool_text_bad,
               CAST(10000 + o_custkey AS BIGINT) AS zip_like,
               CAST(1990 + o_orderkey % 30 AS BIGINT) AS year_like,
               o_orderpriority
        FROM {orders}""",
    # Known linear structure, no missing value.
    "collinear": """
        SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
               l_extendedprice * (1 - l_discount) AS net_price,
               l_extendedprice * 2 + 10 AS exact_copy,
               CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS binary_col
        FROM {lineitem}""",
    # All values inside one ordinal scale, in different cases.
    "ordinal_part": """
        SELECT p_partkey,
               CASE WHEN p_partkey % 40 = 0 THEN NULL WHEN p_size < 10 THEN 'SMALL' WHEN p_size < 20 THEN 'Small'
                    WHEN p_size < 35 THEN 'medium' ELSE 'LARGE' END AS size_label
        FROM {part}""",
    # Violations, missing operands, a rule between columns.
    "rule_lineitem": """
        SELECT l_orderkey, l_linenumber,
               CASE WHEN l_quantity = 13 THEN NULL WHEN l_quantity = 17 THEN -1.0
                    ELSE l_quantity END AS l_quantity,
               l_discount, l_tax, l_returnflag
        FROM {lineitem}""",
    # More numeric columns than any screen shows.
    "wide_lines": "SELECT "
    + ", ".join(f"l_quantity * {k} + l_discount * {29 - k} + l_tax * {k * k % 7} AS w{k}" for k in range(1, 28))
    + " FROM {lineitem}",
    # Two versions of one table.
    "state_before": "SELECT event_id, event_type, value FROM {events}",
    "state_after": """
        SELECT event_id, event_type, CASE WHEN value > 150 THEN 150.0 ELSE value END AS value
        FROM {events} WHERE event_type <> 'error'""",
    # Whole texts; near duplicates follow doc_id.
    "adjacent_docs": "SELECT doc_id, text, n_chars FROM {documents}",
}

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def query(name: str, sql: str | None = None):
    """Register a query and, if there is one, the SQL with the same result."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql.strip()
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # The given tables hold no NaN.
    return read_parquet(spark, f"{sf_dir}/{name}.parquet", nan_to_null=False)


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = DERIVED[name]
    used = {t: table(spark, sf_dir, t) for t in BASE_TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def cte(*names: str) -> str:
    """WITH clause that defines derived tables on the base tables."""
    plain = {t: t for t in BASE_TABLES}
    return "WITH " + ",\n".join(f"{n} AS ({DERIVED[n].format(**plain)})" for n in names)


def rounded(df: DataFrame, digits: int = 6, only: list[str] | None = None) -> DataFrame:
    """Round floating point results, so that the last bits do not matter."""
    return df.select(
        *[
            F.round(f"`{c}`", digits).alias(c)
            if t in ("double", "float") and (only is None or c in only)
            else F.col(f"`{c}`")
            for c, t in df.dtypes
        ]
    )
