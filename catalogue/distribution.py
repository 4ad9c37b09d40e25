"""Distribution and chart data queries."""

from catalogue.outliers import MOMENT_ROWS, PERCENTILE_ROWS, _top_values_sql
from catalogue.registry import cte, derived, query, rounded, table
from grainmill.operators import distribution

COLLINEAR = ["l_quantity", "l_extendedprice", "l_discount", "net_price", "exact_copy"]


def _histogram_sql(relation: str, column: str, bins: int, label: str = "") -> str:
    return f"""
SELECT {label} CAST(s.b AS BIGINT) AS bin, round(lo + s.b * w, 6) AS bin_start,
       round(lo + (s.b + 1) * w, 6) AS bin_end, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM range({bins}) s(b)
CROSS JOIN (SELECT min({column}) AS lo, (max({column}) - min({column})) / {float(bins)} AS w
            FROM {relation}) r
LEFT JOIN (SELECT least(CAST(floor(({column} - lo) / w) AS INT), {bins - 1}) AS b, count(*) AS n
           FROM {relation}, (SELECT min({column}) AS lo,
                (max({column}) - min({column})) / {float(bins)} AS w FROM {relation})
           WHERE {column} IS NOT NULL GROUP BY 1) c ON c.b = s.b"""


@query(
    "inspect_numeric",
    cte("dirty_events")
    + f""", x AS (SELECT value AS v FROM dirty_events)
SELECT metric, round(value, 6) AS value FROM (
{MOMENT_ROWS} UNION ALL SELECT 'missing', count(*) - count(v) FROM x {PERCENTILE_ROWS})""",
)
def inspect_numeric(spark, sf_dir):
    return rounded(distribution.inspect_numeric(derived(spark, sf_dir, "dirty_events"), "value"))


@query(
    "inspect_categorical",
    _top_values_sql("dirty_events", "event_type", 20, cte("dirty_events")),
)
def inspect_categorical(spark, sf_dir):
    events = derived(spark, sf_dir, "dirty_events")
    return distribution.inspect_categorical(events, "event_type")


@query("histogram", _histogram_sql("events", "value", 30))
def histogram(spark, sf_dir):
    return rounded(distribution.histogram(table(spark, sf_dir, "events"), "value"))


@query(
    "histogram_multi",
    " UNION ALL ".join(
        _histogram_sql("orders", c, 30, f"'{c}' AS \"column\",")
        for c in ("o_orderkey", "o_custkey", "o_totalprice")
    ),
)
def histogram_multi(spark, sf_dir):
    return rounded(distribution.histogram_multi(table(spark, sf_dir, "orders")))


@query(
    "histogram_compare",
    cte("state_before", "state_after")
    + """,
r AS (SELECT min(value) AS lo, (max(value) - min(value)) / 30.0 AS w FROM
      (SELECT value FROM state_before UNION ALL SELECT value FROM state_after)),
c AS (SELECT 'before' AS state, least(CAST(floor((value - lo) / w) AS INT), 29) AS b, count(*) AS n
      FROM state_before, r GROUP BY 1, 2
      UNION ALL
      SELECT 'after', least(CAST(floor((value - lo) / w) AS INT), 29), count(*)
      FROM state_after, r GROUP BY 1, 2)
SELECT t.state, CAST(s.b AS BIGINT) AS bin, round(lo + s.b * w, 6) AS bin_start,
       round(lo + (s.b + 1) * w, 6) AS bin_end, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM range(30) s(b) CROSS JOIN (VALUES ('before'), ('after')) t(state) CROSS JOIN r
LEFT JOIN c ON c.b = s.b AND c.state = t.state""",
)
def histogram_compare(spark, sf_dir):
    before = derived(spark, sf_dir, "state_before")
    after = derived(spark, sf_dir, "state_after")
    return rounded(distribution.histogram_compare(before, after, "value"))


@query(
    "kde",
    """
WITH m AS (SELECT min(value) AS lo, (max(value) - min(value)) / 99.0 AS step, count(value) AS n,
                  power(count(value), -0.2) * stddev_samp(value) AS h,
                  (max(value) - min(value)) / 30.0 AS w FROM events),
v AS (SELECT value AS v, count(*) AS c FROM events GROUP BY value),
d AS (SELECT s.i AS point, lo + s.i * step AS x,
             sum(c * exp(-0.5 * power((lo + s.i * step - v.v) / h, 2))) / any_value(n * h * sqrt(2 * pi()))
               AS density
      FROM range(100) s(i), v, m GROUP BY s.i, lo, step),
t AS (SELECT max(n) AS tallest FROM (SELECT count(*) AS n FROM events, m
      GROUP BY least(CAST(floor((value - lo) / w) AS INT), 29)))
SELECT CAST(point AS BIGINT) AS point, round(x, 6) AS x, round(density, 9) AS density,
       round(density * tallest / (SELECT max(density) FROM d), 4) AS scaled FROM d, t""",
)
def kde(spark, sf_dir):
    found = distribution.kernel_density(table(spark, sf_dir, "events"), "value")
    return rounded(rounded(rounded(found, 6, ["x"]), 9, ["density"]), 4, ["scaled"])


_BOX = """
b AS (SELECT quantile_cont(value, 0.25) AS q1, median(value) AS median,
             quantile_cont(value, 0.75) AS q3 FROM events),
f AS (SELECT value, q1, median, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
      FROM events, b),
box AS (SELECT any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
       min(value) FILTER (value BETWEEN lo AND hi) AS lower_whisker,
       max(value) FILTER (value BETWEEN lo AND hi) AS upper_whisker,
       CAST(count(*) FILTER (value < lo OR value > hi) AS BIGINT) AS outlier_count FROM f)"""


@query(
    "boxplot",
    f"""WITH {_BOX}
SELECT round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       lower_whisker, upper_whisker, outlier_count FROM box""",
)
def boxplot(spark, sf_dir):
    return rounded(distribution.boxplot(table(spark, sf_dir, "events"), "value"))


@query(
    "boxplot_bounds",
    f"""WITH {_BOX}
SELECT round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       lower_whisker, upper_whisker, outlier_count,
       round((SELECT avg(value) - 3 * stddev_samp(value) FROM events), 6) AS lower_bound,
       round((SELECT avg(value) + 3 * stddev_samp(value) FROM events), 6) AS upper_bound
FROM box""",
)
def boxplot_bounds(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return rounded(distribution.boxplot_bounds(events, "value", "zscore"))


_METRICS = {
    "mean": "avg({c})",
    "median": "median({c})",
    "std": "stddev_samp({c})",
    "min": "min({c})",
    "max": "max({c})",
    "skewness": "skewness({c})",
    "kurtosis": "kurtosis({c})",
}


def _compare_sql() -> str:
    rows = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{m}' AS metric,
        (SELECT CAST({e.format(c=c)} AS DOUBLE) FROM state_before) AS a,
        (SELECT CAST({e.format(c=c)} AS DOUBLE) FROM state_after) AS b"""
        for c in ("event_id", "value")
        for m, e in _METRICS.items()
    )
    return (
        cte("state_before", "state_after")
        + f"""
SELECT "column", metric, round(a, 4) AS before, round(b, 4) AS after,
       round(CASE WHEN metric = 'skewness' AND "column" = 'event_id' THEN NULL
                  WHEN a = 0 THEN 0 ELSE (b - a) / abs(a) * 100 END, 4) AS change_pct
FROM ({rows})"""
    )


@query("compare_distributions", _compare_sql())
def compare_distributions(spark, sf_dir):
    from pyspark.sql import functions as F

    found = distribution.compare_distributions(
        derived(spark, sf_dir, "state_before"), derived(spark, sf_dir, "state_after")
    )
    # The skewness of 0..n-1 is zero but for rounding; its change means nothing.
    noise = (F.col("metric") == "skewness") & (F.col("column") == "event_id")
    return rounded(found.withColumn("change_pct", F.when(~noise, F.col("change_pct"))), 4)


@query(
    "numeric_summary",
    cte("dirty_events")
    + "\nSELECT * FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(avg({c}), 4) AS mean, round(median({c}), 4) AS median,
        round(stddev_samp({c}), 4) AS std, round(CASE WHEN min({c}) < max({c}) THEN skewness({c}) END, 4) AS skewness,
        CAST(count(*) - count({c}) AS BIGINT) AS missing FROM dirty_events"""
        for c in (
            "event_id", "user_id", "value", "value2", "mostly_missing", "all_missing", "const_col"
        )
    )
    + ")",
)
def numeric_summary(spark, sf_dir):
    return rounded(distribution.numeric_summary(derived(spark, sf_dir, "dirty_events")), 4)


WIDE = [f"w{k}" for k in range(1, 28)]


@query(
    "histogram_multi_wide",
    cte("wide_lines") + "\n" + " UNION ALL ".join(_histogram_sql("wide_lines", c, 30, f"'{c}' AS \"column\",") for c in WIDE),
)
def histogram_multi_wide(spark, sf_dir):
    return rounded(distribution.histogram_multi(derived(spark, sf_dir, "wide_lines")))


@query(
    "boxplot_points",
    """
WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
SELECT event_id, value FROM events, q WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)""",
)
def boxplot_points(spark, sf_dir):
    return distribution.boxplot_points(table(spark, sf_dir, "events"), "value").select("event_id", "value")


@query(
    "category_bars",
    """
SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'o_orderpriority', o_orderpriority, CAST(count(*) AS BIGINT) FROM orders GROUP BY 2""",
)
def category_bars(spark, sf_dir):
    bars = distribution.category_bars(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])
    return bars.select("column", "value", "n")
