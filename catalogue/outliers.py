"""Outlier queries."""

from catalogue.registry import cte, derived, query, rounded, table
from grainmill.operators import distribution, outliers

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_totalprice"]


def _bounds_sql(method: str) -> str:
    """Bounds and outlier test over a relation x(column, v)."""
    if method == "iqr":
        return """SELECT "column", q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi,
                         q1 - 1.5 * (q3 - q1) AS mlo, q3 + 1.5 * (q3 - q1) AS mhi
                  FROM (SELECT "column", quantile_cont(v, 0.25) AS q1,
                               quantile_cont(v, 0.75) AS q3 FROM x GROUP BY "column")"""
    if method == "zscore":
        return """SELECT "column", avg(v) - 3 * stddev_samp(v) AS lo,
                         avg(v) + 3 * stddev_samp(v) AS hi,
                         avg(v) - 3 * stddev_pop(v) AS mlo, avg(v) + 3 * stddev_pop(v) AS mhi
                  FROM x GROUP BY "column" """
    if method == "modified_zscore":
        return """SELECT "column", m - 3.5 * d / 0.6745 AS lo, m + 3.5 * d / 0.6745 AS hi,
                         m - 3.5 * d / 0.6745 AS mlo, m + 3.5 * d / 0.6745 AS mhi
                  FROM (SELECT "column", median(v) AS m, mad(v) AS d FROM x GROUP BY "column")"""
    return """SELECT "column", quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi,
                     quantile_cont(v, 0.01) AS mlo, quantile_cont(v, 0.99) AS mhi
              FROM x GROUP BY "column" """


def _long(table_name: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS v FROM {table_name}" for c in columns
    )


def _report_sql(table_name: str, columns: list[str], method: str) -> str:
    return f"""
WITH x AS ({_long(table_name, columns)}),
b AS ({_bounds_sql(method)})
SELECT x."column" AS "column",
       CAST(count(*) FILTER (v < mlo OR v > mhi) AS BIGINT) AS outlier_count,
       round(count(*) FILTER (v < mlo OR v > mhi) * 100.0 / count(v), 2) AS outlier_pct,
       round(any_value(lo), 4) AS lower_bound, round(any_value(hi), 4) AS upper_bound,
       round(avg(v), 4) AS mean, round(median(v), 4) AS median,
       round(stddev_samp(v), 4) AS std, round(min(v), 4) AS min, round(max(v), 4) AS max,
       round(skewness(v), 4) AS skewness, round(kurtosis(v), 4) AS kurtosis
FROM x JOIN b ON x."column" = b."column" GROUP BY x."column" """


def _register_report(name: str, method: str):
    @query(f"outlier_report_{name}", _report_sql("orders", ORDER_COLUMNS, method))
    def report(spark, sf_dir):
        found = outliers.detect_outliers(table(spark, sf_dir, "orders"), method=method)
        return rounded(found, 4)


def _register_rows(name: str, method: str):
    sql = f"""
WITH x AS (SELECT 'value' AS "column", value AS v FROM events), b AS ({_bounds_sql(method)})
SELECT event_id, user_id, value FROM events, b WHERE value < mlo OR value > mhi"""

    @query(f"outliers_{name}", sql)
    def rows(spark, sf_dir):
        events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
        return outliers.outlier_rows(events, "value", method)


for _name, _method in [
    ("iqr", "iqr"),
    ("zscore", "zscore"),
    ("modified_z", "modified_zscore"),
    ("percentile", "percentile"),
]:
    _register_report(_name, _method)
    _register_rows(_name, _method)


LINE_CONFIG = {
    "l_extendedprice": {"action": "drop"},
    "l_quantity": {"action": "drop"},
    "l_discount": {"action": "keep"},
}


@query(
    "outliers_drop",
    """
WITH b AS (SELECT quantile_cont(l_extendedprice, 0.05) AS plo, quantile_cont(l_extendedprice, 0.95) AS phi,
                  quantile_cont(l_quantity, 0.05) AS qlo, quantile_cont(l_quantity, 0.95) AS qhi
           FROM lineitem)
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount FROM lineitem, b
WHERE l_extendedprice BETWEEN plo AND phi AND l_quantity BETWEEN qlo AND qhi""",
)
def outliers_drop(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"
    )
    fitted = outliers.fit_outlier_treatment(lines, LINE_CONFIG, "percentile", 5)
    return fitted.apply(lines)


@query(
    "outliers_winsorize",
    cte("dirty_events")
    + """
SELECT event_id, round(least(greatest(value, lo), hi), 6) AS value
FROM dirty_events, (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi
                    FROM dirty_events)
WHERE value IS NOT NULL
UNION ALL SELECT event_id, value FROM dirty_events WHERE value IS NULL""",
)
def outliers_winsorize(spark, sf_dir):
    events = derived(spark, sf_dir, "dirty_events").select("event_id", "value")
    clipped, _ = outliers.resolve_outliers(events, {"value": {"action": "winsorize"}})
    return rounded(clipped)


@query(
    "outlier_resolution_stats",
    """
WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3,
                  quantile_cont(value, 0.05) AS clo, quantile_cont(value, 0.95) AS chi,
                  quantile_cont(user_id, 0.25) AS u1, quantile_cont(user_id, 0.75) AS u3 FROM events),
m AS (SELECT value, (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS o,
             (user_id < u1 - 1.5 * (u3 - u1) OR user_id > u3 + 1.5 * (u3 - u1)) AS uo, clo, chi
      FROM events, b)
SELECT 'value' AS "column", 'winsorize' AS action, CAST(count(*) FILTER (o) AS BIGINT) AS outliers_found,
       CAST(count(*) FILTER (value < clo OR value > chi) AS BIGINT) AS cells_clipped,
       round(any_value(clo), 6) AS lower_bound, round(any_value(chi), 6) AS upper_bound,
       CAST(count(*) FILTER (NOT uo) AS BIGINT) AS rows_after FROM m
UNION ALL
SELECT 'user_id', 'drop', CAST(count(*) FILTER (uo) AS BIGINT), 0, NULL, NULL,
       CAST(count(*) FILTER (NOT uo) AS BIGINT) FROM m
UNION ALL
SELECT 'event_id', 'keep', 0, 0, NULL, NULL, CAST(count(*) FILTER (NOT uo) AS BIGINT) FROM m""",
)
def outlier_resolution_stats(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    config = {
        "value": {"action": "winsorize", "lower_pct": 5, "upper_pct": 95},
        "user_id": {"action": "drop"},
        "event_id": {"action": "keep"},
    }
    _, stats = outliers.resolve_outliers(events, config)
    return rounded(stats)


@query(
    "outlier_summary",
    "SELECT * FROM ("
    + _report_sql("events", ["event_id", "user_id", "value"], "iqr")
    + ") WHERE outlier_count > 0",
)
def outlier_summary(spark, sf_dir):
    return rounded(outliers.outlier_summary(table(spark, sf_dir, "events")), 4)


PERCENTILE_ROWS = "\n".join(
    f"UNION ALL SELECT '{p}%', quantile_cont(v, {p / 100}) FROM x"
    for p in distribution.PERCENTILES
)
MOMENT_ROWS = """
SELECT 'mean' AS metric, avg(v) AS value FROM x
UNION ALL SELECT 'median', median(v) FROM x UNION ALL SELECT 'std', stddev_samp(v) FROM x
UNION ALL SELECT 'min', min(v) FROM x UNION ALL SELECT 'max', max(v) FROM x
UNION ALL SELECT 'skewness', skewness(v) FROM x UNION ALL SELECT 'kurtosis', kurtosis(v) FROM x
"""


@query(
    "distribution_stats",
    f"""
WITH x AS (SELECT l_extendedprice AS v FROM lineitem)
SELECT metric, round(value, 4) AS value FROM (
{MOMENT_ROWS} UNION ALL SELECT 'count', count(v) FROM x {PERCENTILE_ROWS})""",
)
def distribution_stats(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return rounded(distribution.distribution_stats(lines, "l_extendedprice"), 4)


def _top_values_sql(relation: str, column: str, limit: int, prefix: str = "") -> str:
    return f"""{prefix}
SELECT rank, CAST(value AS VARCHAR) AS value, n, rank = 1 AS is_mode, unique_count, missing_count FROM (
  SELECT {column} AS value, CAST(count(*) AS BIGINT) AS n,
         CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({column} AS VARCHAR)) AS BIGINT) AS rank
  FROM {relation} WHERE {column} IS NOT NULL GROUP BY {column}),
  (SELECT CAST(count(DISTINCT {column}) AS BIGINT) AS unique_count,
          CAST(count(*) - count({column}) AS BIGINT) AS missing_count FROM {relation})
WHERE rank <= {limit}"""


@query("categorical_stats", _top_values_sql("part", "p_brand", 10))
def categorical_stats(spark, sf_dir):
    return distribution.categorical_stats(table(spark, sf_dir, "part"), "p_brand")


@query(
    "outlier_totals",
    "SELECT CAST(count(*) AS BIGINT) AS columns_analyzed,"
    " CAST(count(*) FILTER (outlier_count > 0) AS BIGINT) AS columns_with_outliers,"
    " CAST(sum(outlier_count) AS BIGINT) AS total_outliers FROM ("
    + _report_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "modified_zscore")
    + ")",
)
def outlier_totals(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    )
    return outliers.outlier_totals(lines, "modified_zscore")


@query(
    "outlier_samples",
    """
WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, value FROM events, b
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) ORDER BY event_id LIMIT 20""",
)
def outlier_samples(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "value")
    return outliers.outlier_samples(events, "value", ["event_id"])
