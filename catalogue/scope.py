"""Column scope queries."""

from catalogue.registry import cte, derived, query, rounded
from grainmill.operators import scope

TYPES = {
    "event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string",
    "value": "double", "value2": "double", "mostly_missing": "double", "all_missing": "double",
    "const_col": "int",
}


def _recommendation(c: str) -> str:
    mode = "0"
    if TYPES[c] == "string":
        mode = f"(SELECT max(n) FROM (SELECT count(*) AS n FROM dirty_events WHERE {c} IS NOT NULL GROUP BY {c}))"
    return f"""SELECT '{c}' AS "column", '{TYPES[c]}' AS dtype, count(DISTINCT {c}) AS u,
        count(*) - count({c}) AS m, count(*) AS r, {mode} AS top FROM dirty_events"""


@query(
    "column_recommendations",
    cte("dirty_events")
    + ",\np AS ("
    + " UNION ALL ".join(map(_recommendation, TYPES))
    + """),
f AS (SELECT *, u <= 1 AS zero, u > 1 AND u = r AS ident, u > 1 AND u <> r AND top * 100.0 / r > 95 AS near,
             m * 100.0 / r > 50 AS sparse FROM p)
SELECT "column", dtype, CAST(u AS BIGINT) AS unique_count, CAST(m AS BIGINT) AS null_count,
       round(m * 100.0 / r, 2) AS null_pct,
       concat_ws(',', CASE WHEN zero THEN 'zero_variance' END, CASE WHEN ident THEN 'high_cardinality' END,
                 CASE WHEN near THEN 'near_zero_variance' END, CASE WHEN sparse THEN 'high_missing' END) AS flags,
       CASE WHEN sparse OR ident OR near THEN 'review' WHEN zero THEN 'drop' ELSE 'keep' END AS recommendation
FROM f""",
)
def column_recommendations(spark, sf_dir):
    return scope.column_recommendations(derived(spark, sf_dir, "dirty_events"))


@query(
    "scope_select",
    cte("dirty_events")
    + ",\np AS ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS u, count(*) AS r FROM dirty_events"""
        for c in TYPES
    )
    + """)
SELECT "column", u > 1 AND u <> r AND "column" <> 'value2' AS kept,
       CASE WHEN "column" = 'value2' THEN 'not_selected' WHEN u <= 1 THEN 'zero_variance'
            WHEN u = r THEN 'high_cardinality' END AS reason FROM p""",
)
def scope_select(spark, sf_dir):
    chosen = [c for c in TYPES if c != "value2"]
    _, stats = scope.apply_scope_selection(
        derived(spark, sf_dir, "dirty_events"), chosen, drop_high_cardinality=True
    )
    return stats


@query(
    "scope_apply",
    cte("dirty_events")
    + "\nSELECT event_id, user_id, event_type, value FROM dirty_events",
)
def scope_apply(spark, sf_dir):
    chosen = ["event_id", "user_id", "event_type", "value", "all_missing", "const_col", "unknown"]
    kept, _ = scope.apply_scope_selection(derived(spark, sf_dir, "dirty_events"), chosen)
    return kept


def _summary(c: str) -> str:
    numeric = TYPES[c] in ("bigint", "int", "double")
    stats = ["CAST(NULL AS DOUBLE)"] * 3
    if numeric:
        stats = [f"round(CAST({f}({c}) AS DOUBLE), 4)" for f in ("min", "max", "avg")]
    return f"""SELECT '{c}' AS "column", '{TYPES[c]}' AS dtype,
        CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count, CAST(count(*) - count({c}) AS BIGINT) AS null_count,
        round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct,
        {stats[0]} AS min, {stats[1]} AS max, {stats[2]} AS mean FROM dirty_events"""


@query("column_summary", cte("dirty_events") + "\n" + " UNION ALL ".join(map(_summary, TYPES)))
def column_summary(spark, sf_dir):
    return rounded(scope.column_summary(derived(spark, sf_dir, "dirty_events")), 4)


@query(
    "column_top_values",
    cte("text_typed")
    + "\nSELECT \"column\", CAST(rank AS BIGINT) AS rank, value, CAST(n AS BIGINT) AS n FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS n,
        row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS rank
        FROM text_typed WHERE {c} IS NOT NULL GROUP BY {c}"""
        for c in ("num_text", "num_text_bad", "date_text", "bool_text", "bool_text_bad", "o_orderpriority")
    )
    + ") WHERE rank <= 5",
)
def column_top_values(spark, sf_dir):
    return scope.column_top_values(derived(spark, sf_dir, "text_typed"))
