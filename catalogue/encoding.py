"""Encoding and scaling queries."""

from pyspark.sql import functions as F

from catalogue.registry import cte, derived, query, rounded, table
from grainmill.operators import encoding, scaling

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
LINES = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]


def _categorical(c: str, dtype: str) -> str:
    words = "low|medium|high|small|large|poor|good"
    if dtype == "string":
        ordinal = f"coalesce(bool_or(regexp_matches(lower({c}), '{words}')), false)"
        return f"""SELECT '{c}' AS "column", 'string' AS dtype, CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count,
            CASE WHEN {ordinal} THEN 'ordinal' ELSE 'nominal' END AS category_type,
            CASE WHEN {ordinal} THEN 'label' ELSE 'one_hot' END AS suggested_encoding FROM part"""
    return f"""SELECT '{c}', '{dtype}', CAST(count(DISTINCT {c}) AS BIGINT), 'possible_categorical', 'one_hot'
        FROM part HAVING count(DISTINCT {c}) <= 10"""


@query(
    "detect_categorical",
    " UNION ALL ".join(
        _categorical(c, t)
        for c, t in [("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
                     ("p_partkey", "bigint"), ("p_size", "int")]
    ),
)
def detect_categorical(spark, sf_dir):
    return encoding.detect_categorical(table(spark, sf_dir, "part"))


_SAMPLED = [("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int")]


@query(
    "detect_categorical_samples",
    "SELECT d.\"column\", category_type, sample_values FROM ("
    + " UNION ALL ".join(_categorical(c, t) for c, t in _SAMPLED)
    + ") d JOIN ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", array_to_string(list_sort(list(DISTINCT CAST({c} AS VARCHAR)))[1:5], ', ') AS sample_values
        FROM part WHERE {c} IS NOT NULL"""
        for c, _ in _SAMPLED
    )
    + ") s ON d.\"column\" = s.\"column\"",
)
def detect_categorical_samples(spark, sf_dir):
    found = encoding.detect_categorical(table(spark, sf_dir, "part"), samples=5)
    return found.select("column", "category_type", F.array_join("sample_values", ", ").alias("sample_values"))


@query(
    "encode_stats",
    """
SELECT 'o_orderstatus' AS "column", 'one_hot' AS method, CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS size,
       string_agg(DISTINCT 'o_orderstatus_' || o_orderstatus, ',' ORDER BY 'o_orderstatus_' || o_orderstatus) AS new_columns,
       CAST(NULL AS VARCHAR) AS error FROM orders
UNION ALL SELECT 'o_orderpriority', 'label', CAST(count(DISTINCT o_orderpriority) AS BIGINT), 'o_orderpriority', NULL
FROM orders
UNION ALL SELECT 'o_custkey', NULL, NULL, NULL, 'no such method: hash'""",
)
def encode_stats(spark, sf_dir):
    config = {
        "o_orderstatus": {"method": "one_hot"},
        "o_orderpriority": {"method": "label"},
        "o_custkey": {"method": "hash"},
        "unknown": {"method": "label"},
    }
    _, stats = encoding.encode_categorical(table(spark, sf_dir, "orders"), config)
    return stats


@query(
    "encode_mapping",
    """
SELECT 'o_orderpriority' AS "column", o_orderpriority AS value,
       CAST(row_number() OVER (ORDER BY o_orderpriority) - 1 AS VARCHAR) AS label
FROM (SELECT DISTINCT o_orderpriority FROM orders)
UNION ALL SELECT 'o_orderstatus', 'F', '0.5' UNION ALL SELECT 'o_orderstatus', 'O', '2.75'""",
)
def encode_mapping(spark, sf_dir):
    config = {
        "o_orderpriority": {"method": "label"},
        "o_orderstatus": {"method": "label", "mapping": {"F": 0.5, "O": 2.75}},
    }
    return encoding.fit_encoding(table(spark, sf_dir, "orders"), config).mapping_frame(spark)


@query(
    "label_mapping_float",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0.5::DOUBLE WHEN 'O' THEN 2.75::DOUBLE END AS o_orderstatus
FROM orders""",
)
def label_mapping_float(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return encoding.fit_labels(orders, "o_orderstatus", {"F": 0.5, "O": 2.75}).apply(orders)


@query(
    "label_name_clash",
    """
SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS BIGINT) AS label, p_size AS n, p_name AS value FROM part""",
)
def label_name_clash(spark, sf_dir):
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_type AS label", "p_size AS n", "p_name AS value")
    return encoding.fit_labels(parts, "label").apply(parts)


def _register_one_hot(name: str, drop_first: bool):
    values = PRIORITIES[1:] if drop_first else PRIORITIES
    flags = ", ".join(f"o_orderpriority = '{v}' AS \"o_orderpriority_{v}\"" for v in values)

    @query(name, f"SELECT o_orderkey, {flags} FROM orders")
    def one_hot(spark, sf_dir):
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
        return encoding.fit_one_hot(orders, "o_orderpriority", drop_first).apply(orders)


_register_one_hot("one_hot", False)
_register_one_hot("one_hot_drop_first", True)


@query(
    "label_ordinal",
    cte("ordinal_part")
    + """
SELECT p_partkey, CAST(CASE lower(size_label) WHEN 'small' THEN 1 WHEN 'medium' THEN 2 WHEN 'large' THEN 3 END
       AS BIGINT) AS size_label FROM ordinal_part""",
)
def label_ordinal(spark, sf_dir):
    parts = derived(spark, sf_dir, "ordinal_part")
    return encoding.fit_labels(parts, "size_label").apply(parts)


@query(
    "label_alphabetical",
    """
SELECT c_custkey, CAST(l AS BIGINT) AS c_nationkey, CAST(n AS BIGINT) AS c_name FROM customer
JOIN (SELECT c_nationkey AS k, dense_rank() OVER (ORDER BY CAST(c_nationkey AS VARCHAR)) - 1 AS l
      FROM customer GROUP BY c_nationkey) ON c_nationkey = k
JOIN (SELECT c_name AS m, row_number() OVER (ORDER BY c_name) - 1 AS n FROM customer GROUP BY c_name)
  ON c_name = m""",
)
def label_alphabetical(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name")
    few = encoding.fit_labels(customers, "c_nationkey")
    many = encoding.fit_labels(customers, "c_name")
    return many.apply(few.apply(customers))


@query(
    "label_mapping",
    """SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'F' THEN 10 WHEN 'O' THEN 20 END AS BIGINT) AS o_orderstatus
FROM orders""",
)
def label_mapping(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return encoding.fit_labels(orders, "o_orderstatus", {"F": 10, "O": 20}).apply(orders)


@query(
    "encoding_preview",
    """
SELECT * FROM (SELECT p_brand AS value, 'p_brand_' || p_brand AS result,
       CAST((SELECT count(DISTINCT p_brand) FROM part) AS BIGINT) AS total_values
FROM part GROUP BY p_brand ORDER BY p_brand LIMIT 20)
UNION ALL
SELECT p_type, CAST(row_number() OVER (ORDER BY p_type) - 1 AS VARCHAR),
       CAST((SELECT count(DISTINCT p_type) FROM part) AS BIGINT) FROM part GROUP BY p_type""",
)
def encoding_preview(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return encoding.encoding_preview(parts, "p_brand", "one_hot").unionByName(
        encoding.encoding_preview(parts, "p_type", "label")
    )


@query(
    "scaling_params",
    cte("dirty_events")
    + "\nSELECT * FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{p}' AS parameter, round({e}({c}), 4) AS value FROM dirty_events"""
        for c in ("event_id", "user_id", "value", "value2", "mostly_missing")
        for p, e in (("mean", "avg"), ("std", "stddev_samp"))
    )
    + ")",
)
def scaling_params(spark, sf_dir):
    # Constant and empty columns have no parameters.
    fitted = scaling.fit_scaling(derived(spark, sf_dir, "dirty_events"))
    return rounded(fitted.params_frame(spark), 4)


_SCALE_SQL = {
    "standard": "({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_samp({c}) FROM lineitem)",
    "minmax": "({c} - (SELECT min({c}) FROM lineitem)) / (SELECT max({c}) - min({c}) FROM lineitem)",
    "robust": "({c} - (SELECT median({c}) FROM lineitem)) / "
    "(SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM lineitem)",
}


def _register_scale(method: str):
    columns = ", ".join(
        f"round({_SCALE_SQL[method].format(c=c)}, 6) AS {c}" for c in LINES[2:]
    )

    @query(f"scale_{method}", f"SELECT l_orderkey, l_linenumber, {columns} FROM lineitem")
    def scale(spark, sf_dir):
        lines = table(spark, sf_dir, "lineitem").select(*LINES)
        scaled, _ = scaling.apply_scaling(lines, method, LINES[2:])
        return rounded(scaled)


for _method in scaling.METHODS:
    _register_scale(_method)


@query(
    "scaling_preview",
    """
WITH m AS (SELECT median(value) AS m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS s FROM events),
x AS (SELECT 'before' AS stage, value AS v FROM events UNION ALL SELECT 'after', (value - m) / s FROM events, m)
SELECT stage, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean,
       round(stddev_samp(v), 6) AS std FROM x GROUP BY stage""",
)
def scaling_preview(spark, sf_dir):
    return rounded(scaling.scaling_preview(table(spark, sf_dir, "events"), "value", "robust"))
