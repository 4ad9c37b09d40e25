"""Type detection and cast queries."""

from catalogue.registry import cte, derived, query, rounded, table
from grainmill.operators import profile, schema

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
TEXTS = ["num_text", "num_text_bad", "date_text", "bool_text", "bool_text_bad", "o_orderpriority"]


def _tests(c: str) -> dict[str, str]:
    words = ["('true','false')", "('yes','no')", "('y','n')", "('1','0')", "('t','f')"]
    boolean = " OR ".join(f"coalesce(bool_and(lower({c}) IN {w}), false)" for w in words)
    return {
        "date": f"(count({c}) > 0 AND count(try_cast({c} AS TIMESTAMP)) = count({c}))",
        "num": f"(count({c}) > 0 AND count(*) FILTER (regexp_matches({c}, '{NUMBER}')) = count({c}))",
        "bool": f"({boolean})",
    }


def _schema_row(c: str, dtype: str, rel: str) -> str:
    hint, inferred = "CAST(NULL AS VARCHAR)", f"'{dtype}'"
    if dtype == "string":
        t = _tests(c)
        few = f"(count(DISTINCT {c}) <= 20 AND count(DISTINCT {c}) < 0.05 * count(*))"
        inferred = f"""CASE WHEN count({c}) = 0 THEN 'unknown' WHEN {t['date']} THEN 'datetime'
            WHEN {t['num']} THEN 'float64' WHEN {t['bool']} THEN 'boolean'
            WHEN {few} THEN 'category' ELSE 'string' END"""
        hint = f"""CASE WHEN count({c}) = 0 THEN NULL WHEN {t['date']} THEN 'potential datetime'
            WHEN {t['num']} THEN 'potential numeric' WHEN {t['bool']} THEN 'potential boolean'
            WHEN {few} THEN 'low cardinality' END"""
    elif dtype in ("bigint", "int"):
        hint = f"""CASE WHEN count(DISTINCT {c}) = count(*) OR count(DISTINCT {c}) > 0.9 * count(*)
            THEN 'possible identifier'
            WHEN (min({c}) >= 10000 AND max({c}) <= 99999) OR (min({c}) >= 1900 AND max({c}) <= 2100)
            THEN 'consider category or string' END"""
    return f"""SELECT '{c}' AS "column", '{dtype}' AS original_type, {inferred} AS inferred_type,
        CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count,
        CAST(count(*) - count({c}) AS BIGINT) AS null_count,
        round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct,
        {hint} AS suggestion FROM {rel}"""


_TYPED = [("o_orderkey", "bigint"), *[(c, "string") for c in TEXTS[:-1]],
          ("zip_like", "bigint"), ("year_like", "bigint"), ("o_orderpriority", "string")]


@query(
    "detect_schema",
    cte("text_typed") + "\n" + " UNION ALL ".join(_schema_row(c, t, "text_typed") for c, t in _TYPED),
)
def detect_schema(spark, sf_dir):
    return schema.detect_schema(derived(spark, sf_dir, "text_typed"))


def _register_detection(name: str, test: str, function):
    sql = cte("text_typed") + "\n" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {_tests(c)[test]} AS detected FROM text_typed" for c in TEXTS
    )

    @query(name, sql)
    def detect(spark, sf_dir):
        return function(derived(spark, sf_dir, "text_typed"))


_register_detection("detect_datetime_strings", "date", schema.detect_datetime_strings)
_register_detection("detect_numeric_strings", "num", schema.detect_numeric_strings)
_register_detection("detect_boolean_strings", "bool", schema.detect_boolean_strings)


@query(
    "detect_categorical_int",
    cte("text_typed")
    + "\n"
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", (min({c}) >= 10000 AND max({c}) <= 99999)
        OR (min({c}) >= 1900 AND max({c}) <= 2100) AS detected FROM text_typed"""
        for c in ("o_orderkey", "zip_like", "year_like")
    ),
)
def detect_categorical_int(spark, sf_dir):
    return schema.detect_categorical_int(derived(spark, sf_dir, "text_typed"))


OVERRIDES = {
    "num_text": "float64",
    "num_text_bad": "float64",
    "date_text": "datetime64[ns]",
    "bool_text_bad": "boolean",
    "o_orderpriority": "int64",
    "no_such_column": "string",
}
_BAD = f"NOT regexp_matches({{c}}, '{NUMBER}')"


@query(
    "cast_errors",
    cte("text_typed")
    + f"""
SELECT 'num_text' AS "column", 'float64' AS target,
       CAST(count(*) FILTER ({_BAD.format(c='num_text')}) AS BIGINT) AS failed_count,
       CAST(NULL AS VARCHAR) AS error FROM text_typed
UNION ALL SELECT 'num_text_bad', 'float64', count(*) FILTER ({_BAD.format(c='num_text_bad')}), NULL FROM text_typed
UNION ALL SELECT 'date_text', 'datetime64[ns]', count(*) FILTER (try_cast(date_text AS TIMESTAMP) IS NULL), NULL FROM text_typed
UNION ALL SELECT 'bool_text_bad', 'boolean', count(*) FILTER (lower(bool_text_bad) <> 'yes'), NULL FROM text_typed
UNION ALL SELECT 'o_orderpriority', 'int64', count(*) FILTER ({_BAD.format(c='o_orderpriority')}), NULL FROM text_typed
UNION ALL SELECT 'no_such_column', 'string', NULL, 'column not found'""",
)
def cast_errors(spark, sf_dir):
    return schema.cast_errors(derived(spark, sf_dir, "text_typed"), OVERRIDES)


def _register_cast(name: str, column: str, target: str, expression: str):
    sql = cte("text_typed") + f"\nSELECT o_orderkey, {expression} AS {column} FROM text_typed"

    @query(name, sql)
    def cast(spark, sf_dir):
        rows = derived(spark, sf_dir, "text_typed").select("o_orderkey", column)
        return schema.apply_schema_overrides(rows, {column: target})


_register_cast("cast_datetime", "date_text", "datetime64[ns]", "try_cast(date_text AS TIMESTAMP)")
_register_cast("cast_string", "zip_like", "string", "CAST(zip_like AS VARCHAR)")
_register_cast(
    "cast_boolean", "bool_text_bad", "boolean",
    "CASE lower(bool_text_bad) WHEN 'yes' THEN true WHEN 'no' THEN false END",
)
_register_cast(
    "cast_int", "num_text_bad", "int64",
    "CASE WHEN try_cast(num_text_bad AS DOUBLE) = floor(try_cast(num_text_bad AS DOUBLE))"
    " THEN CAST(try_cast(num_text_bad AS DOUBLE) AS BIGINT) END",
)
_register_cast("cast_category", "bool_text", "category", "bool_text")
_register_cast("cast_free_type", "zip_like", "double", "CAST(zip_like AS DOUBLE)")
_register_cast("cast_float", "num_text_bad", "float64", "try_cast(num_text_bad AS DOUBLE)")


@query(
    "initial_profile",
    """
SELECT 'summary' AS section, 'rows' AS name, CAST(count(*) AS VARCHAR) AS value FROM orders
UNION ALL SELECT * FROM (VALUES ('summary', 'columns', '6'), ('types', 'DateTime', '1'),
  ('types', 'Float', '1'), ('types', 'Integer', '2'), ('types', 'String/Object', '2'),
  ('column', '0000', 'o_orderkey'), ('column', '0001', 'o_custkey'), ('column', '0002', 'o_orderstatus'),
  ('column', '0003', 'o_totalprice'), ('column', '0004', 'o_orderdate'), ('column', '0005', 'o_orderpriority'))""",
)
def initial_profile(spark, sf_dir):
    return profile.initial_profile(table(spark, sf_dir, "orders"))


@query(
    "sample_rows",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5",
)
def sample_rows(spark, sf_dir):
    from pyspark.sql import functions as F

    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    dearest = orders.withColumn("down", -F.col("o_totalprice"))
    return profile.sample_rows(dearest, 5, ["down", "o_orderkey"]).drop("down")


@query(
    "type_distribution",
    """SELECT family, CAST(count(*) AS BIGINT) AS n_columns FROM (
  SELECT CASE WHEN data_type IN ('INTEGER', 'BIGINT') THEN 'Integer'
              WHEN data_type IN ('DOUBLE', 'FLOAT') THEN 'Float'
              WHEN data_type = 'VARCHAR' THEN 'String/Object'
              WHEN data_type LIKE 'TIMESTAMP%' THEN 'DateTime' ELSE data_type END AS family
  FROM (SELECT unnest([typeof(l_orderkey), typeof(l_partkey), typeof(l_suppkey), typeof(l_linenumber),
        typeof(l_quantity), typeof(l_extendedprice), typeof(l_discount), typeof(l_tax),
        typeof(l_returnflag), typeof(l_linestatus), typeof(l_shipdate)]) AS data_type
        FROM (SELECT * FROM lineitem LIMIT 1))) GROUP BY family""",
)
def type_distribution(spark, sf_dir):
    return profile.type_distribution(table(spark, sf_dir, "lineitem"))


@query(
    "sample_values",
    "SELECT DISTINCT user_id AS value FROM events ORDER BY value LIMIT 5",
)
def sample_values(spark, sf_dir):
    return rounded(schema.sample_values(table(spark, sf_dir, "events"), "user_id"))


_LAYOUTS = [
    "dd.MM.yyyy", "MMM d, yyyy", "d MMMM yyyy", "dd-MMM-yyyy", "yyyyMMdd", "MM/dd/yyyy hh:mm a", "MMMM d, yyyy HH:mm",
    "yyyy/MM/dd",
]


@query(
    "cast_datetime_layouts",
    "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS day FROM orders",
)
def cast_datetime_layouts(spark, sf_dir):
    texts = [f"WHEN {k} THEN date_format(day, '{layout}')" for k, layout in enumerate(_LAYOUTS)]
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CAST(o_orderdate AS DATE) AS day")
    rows = orders.selectExpr("o_orderkey", f"CASE o_orderkey % {len(_LAYOUTS)} {' '.join(texts)} END AS day")
    return schema.apply_schema_overrides(rows, {"day": "datetime"})
