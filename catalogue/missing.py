"""Missing value queries."""

from catalogue.registry import cte, derived, query, rounded, table
from grainmill.operators import missing

COLUMNS = [
    "event_id", "ts", "user_id", "event_type", "value", "value2", "mostly_missing",
    "all_missing", "const_col",
]
NUMERIC = {
    "event_id": "bigint", "user_id": "bigint", "value": "double", "value2": "double",
    "mostly_missing": "double", "all_missing": "double", "const_col": "int",
}


def _summary_row(c: str) -> str:
    dtype = NUMERIC.get(c, "timestamp_ntz" if c == "ts" else "string")
    if c in NUMERIC:
        advice = f"CASE WHEN abs(skewness({c})) > 1 THEN 'median' ELSE 'mean' END"
        reason = f"CASE WHEN abs(skewness({c})) > 1 THEN 'skewed' ELSE 'not skewed' END"
    else:
        advice, reason = "'mode'", "'categorical'"
    return f"""SELECT '{c}' AS "column", '{dtype}' AS dtype,
        CAST(count(*) - count({c}) AS BIGINT) AS missing_count,
        round((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_pct,
        {advice} AS suggested_strategy, {reason} AS reason FROM dirty_events"""


@query(
    "missing_summary",
    cte("dirty_events")
    + "\nSELECT * FROM ("
    + " UNION ALL ".join(map(_summary_row, COLUMNS))
    + ") WHERE missing_count > 0",
)
def missing_summary(spark, sf_dir):
    return missing.missing_summary(derived(spark, sf_dir, "dirty_events"))


_MISSING = [f"(count(*) - count({c}))" for c in COLUMNS]


@query(
    "missing_totals",
    cte("dirty_events")
    + f"""
SELECT CAST({len(COLUMNS)} AS BIGINT) AS total_columns,
       CAST({" + ".join(f"CAST({m} > 0 AS INT)" for m in _MISSING)} AS BIGINT) AS columns_with_missing,
       CAST({" + ".join(_MISSING)} AS BIGINT) AS total_missing_cells,
       CAST(count(*) * {len(COLUMNS)} AS BIGINT) AS total_cells,
       round(({" + ".join(_MISSING)}) * 100.0 / (count(*) * {len(COLUMNS)}), 2) AS overall_missing_pct
FROM dirty_events""",
)
def missing_totals(spark, sf_dir):
    return missing.missing_totals(derived(spark, sf_dir, "dirty_events"))


STRATEGIES = {
    "event_type": {"method": "mode"},
    "value": {"method": "drop"},
    "value2": {"method": "median"},
    "mostly_missing": {"method": "constant", "value": 7},
    "const_col": {"method": "mean"},
}


@query(
    "impute_stats",
    cte("dirty_events")
    + """, kept AS (SELECT * FROM dirty_events WHERE value IS NOT NULL),
mode_type AS (SELECT event_type AS v FROM dirty_events WHERE event_type IS NOT NULL
              GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)
SELECT s.*, (SELECT CAST(count(*) AS BIGINT) FROM kept) AS rows_after_imputation FROM (
SELECT 'event_type' AS "column", 'mode' AS method, (SELECT v FROM mode_type) AS fill_value,
       CAST(count(*) - count(event_type) AS BIGINT) AS values_imputed FROM dirty_events
UNION ALL SELECT 'value', 'drop', NULL, count(*) - count(value) FROM dirty_events
UNION ALL SELECT 'mostly_missing', 'constant', '7', count(*) - count(mostly_missing) FROM kept) s""",
)
def impute_stats(spark, sf_dir):
    fitted = missing.fit_imputation(derived(spark, sf_dir, "dirty_events"), STRATEGIES)
    return fitted.stats_frame(spark).drop("error")


def _fill_sql(column: str, fill: str, digits: int | None = 6) -> str:
    filled = f"coalesce({column}, {fill})"
    shown = f"round({filled}, {digits})" if digits is not None else filled
    return cte("dirty_events") + f"\nSELECT event_id, {shown} AS {column} FROM dirty_events"


def _register_fill(name: str, column: str, strategy: dict, fill: str, digits: int | None = 6):
    @query(name, _fill_sql(column, fill, digits))
    def impute(spark, sf_dir):
        events = derived(spark, sf_dir, "dirty_events").select("event_id", column)
        filled, _ = missing.impute_missing_values(events, {column: strategy})
        return rounded(filled)


_register_fill("impute_mean", "value2", {"method": "mean"}, "(SELECT avg(value2) FROM dirty_events)")
_register_fill("impute_median", "value", {"method": "median"}, "(SELECT median(value) FROM dirty_events)")
_register_fill(
    "impute_mode", "event_type", {"method": "mode"},
    "(SELECT event_type FROM dirty_events WHERE event_type IS NOT NULL GROUP BY event_type"
    " ORDER BY count(*) DESC, event_type LIMIT 1)", None,
)
_register_fill("impute_constant", "mostly_missing", {"method": "constant", "value": 0}, "0")
_register_fill("impute_unknown", "event_type", {"method": "unknown_tag"}, "'Unknown'", None)


@query(
    "impute_constant_types",
    """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN DATE '1999-12-31' ELSE CAST(o_orderdate AS DATE) END AS day,
       CASE WHEN o_orderkey % 5 = 0 THEN false ELSE o_totalprice > 100000 END AS dear
FROM orders""",
)
def impute_constant_types(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "IF(o_orderkey % 3 = 0, NULL, CAST(o_orderdate AS DATE)) AS day",
        "IF(o_orderkey % 5 = 0, NULL, o_totalprice > 100000) AS dear",
    )
    chosen = {"day": {"method": "constant", "value": "1999-12-31"}, "dear": {"method": "constant", "value": "false"}}
    filled, _ = missing.impute_missing_values(orders, chosen)
    return filled


@query(
    "impute_drop",
    cte("dirty_events") + "\nSELECT event_id, value FROM dirty_events WHERE value IS NOT NULL",
)
def impute_drop(spark, sf_dir):
    events = derived(spark, sf_dir, "dirty_events").select("event_id", "value")
    kept, _ = missing.impute_missing_values(events, {"value": {"method": "drop"}})
    return kept


_PAIRS = [(a, b) for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1 :]]


@query(
    "missing_cooccurrence",
    cte("dirty_events")
    + "\nSELECT column1, column2, round(share, 3) AS co_occurrence_rate FROM ("
    + " UNION ALL ".join(
        f"""SELECT {k} AS k, '{a}' AS column1, '{b}' AS column2,
        count(*) FILTER ({a} IS NULL AND {b} IS NULL) / nullif(CAST(count(*) FILTER ({a} IS NULL) AS DOUBLE), 0)
        AS share FROM dirty_events"""
        for k, (a, b) in enumerate(_PAIRS)
    )
    + ") WHERE share > 0.5 ORDER BY k LIMIT 10",
)
def missing_cooccurrence(spark, sf_dir):
    return missing.missing_cooccurrence(derived(spark, sf_dir, "dirty_events"))


@query(
    "missing_matrix",
    cte("dirty_events")
    + "\nSELECT "
    + ", ".join(f"CAST({c} IS NULL AS INTEGER) AS {c}" for c in COLUMNS)
    + " FROM dirty_events ORDER BY md5('42|' || event_id), event_id LIMIT 100",
)
def missing_matrix(spark, sf_dir):
    return missing.missing_matrix(derived(spark, sf_dir, "dirty_events"), ["event_id"])


@query(
    "null_pattern_counts",
    cte("dirty_events")
    + "\nSELECT "
    + " || ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in COLUMNS)
    + " AS pattern, CAST(count(*) AS BIGINT) AS n FROM dirty_events GROUP BY 1",
)
def null_pattern_counts(spark, sf_dir):
    return missing.null_pattern_counts(derived(spark, sf_dir, "dirty_events"))
