"""Data rule queries."""

from pyspark.sql import functions as F

from catalogue.registry import cte, derived, query, table
from grainmill.operators import rules
from grainmill.operators.rules import Rule

KEY = "l_orderkey, l_linenumber"


def _lines(spark, sf_dir):
    return derived(spark, sf_dir, "rule_lineitem")


def _register_violations(name: str, rule: Rule, broken: str):
    """Rows that break one rule."""
    sql = cte("rule_lineitem") + f"\nSELECT {KEY}, l_quantity, l_discount, l_tax FROM rule_lineitem WHERE {broken}"

    @query(name, sql)
    def violations(spark, sf_dir):
        lines = _lines(spark, sf_dir)
        return lines.where(rules.violation(lines, rule)).select(
            "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"
        )


_register_violations(
    "constraint_numeric", Rule("l_quantity", ">", 0), "NOT coalesce(l_quantity > 0, false)"
)
_register_violations(
    "constraint_columns", Rule("l_discount", ">=", other="l_tax"), "NOT (l_discount >= l_tax)"
)
_register_violations(
    "constraint_in", Rule("l_quantity", "in", ["1", 2, 3.0]),
    "NOT coalesce(l_quantity IN (1, 2, 3), false)",
)
_register_violations(
    "constraint_nulls", Rule("l_quantity", "!=", 20), "NOT coalesce(l_quantity <> 20, true)"
)

RULES = [
    Rule("l_quantity", ">", 0),
    Rule("l_quantity", "!=", 20),
    Rule("l_discount", ">=", other="l_tax"),
    Rule("l_returnflag", "in", ["A", "N"]),
    Rule("l_tax", predicate="l_tax * 2 <= l_discount + 0.1"),
]
BAD_RULES = [
    Rule("l_quantity", "=>", 3),
    Rule("nope", ">", 0),
    Rule("l_quantity", ">", "many"),
    Rule("l_quantity", "<", other="nope"),
    Rule("l_tax", predicate="l_tax <"),
]


@query(
    "validate_constraints",
    cte("rule_lineitem")
    + """
SELECT CAST(rule_no AS BIGINT) AS rule_no, "column", rule, CAST(violation_count AS BIGINT) AS violation_count,
       CAST(NULL AS VARCHAR) AS error FROM (
SELECT 1 AS rule_no, 'l_quantity' AS "column", 'l_quantity > 0' AS rule,
       count(*) FILTER (NOT coalesce(l_quantity > 0, false)) AS violation_count FROM rule_lineitem
UNION ALL SELECT 2, 'l_quantity', 'l_quantity != 20', count(*) FILTER (l_quantity = 20) FROM rule_lineitem
UNION ALL SELECT 3, 'l_discount', 'l_discount >= l_tax', count(*) FILTER (l_discount < l_tax) FROM rule_lineitem
UNION ALL SELECT 4, 'l_returnflag', 'l_returnflag in [''A'', ''N'']',
       count(*) FILTER (l_returnflag NOT IN ('A', 'N')) FROM rule_lineitem
UNION ALL SELECT 5, 'l_tax', 'l_tax * 2 <= l_discount + 0.1',
       count(*) FILTER (NOT (l_tax * 2 <= l_discount + 0.1)) FROM rule_lineitem)""",
)
def validate_constraints(spark, sf_dir):
    return rules.validate_constraints(_lines(spark, sf_dir), RULES)


@query(
    "constraint_totals",
    cte("rule_lineitem")
    + """
SELECT CAST(a + b + c + d AS BIGINT) AS total_violations,
       CAST((a + b > 0)::INT + (c > 0)::INT + (d > 0)::INT AS BIGINT) AS columns_with_violations,
       CAST(5 AS BIGINT) AS rule_errors FROM (
SELECT count(*) FILTER (NOT coalesce(l_quantity > 0, false)) AS a, count(*) FILTER (l_quantity = 20) AS b,
       count(*) FILTER (l_discount < l_tax) AS c, count(*) FILTER (l_returnflag NOT IN ('A', 'N')) AS d
FROM rule_lineitem)""",
)
def constraint_totals(spark, sf_dir):
    return rules.constraint_totals(_lines(spark, sf_dir), RULES[:4] + BAD_RULES)


@query(
    "rule_errors",
    """
SELECT CAST(rule_no AS BIGINT) AS rule_no, "column", rule, CAST(NULL AS BIGINT) AS violation_count, error
FROM (VALUES (2, 'l_quantity', 'l_quantity => 3', 'no such operator: =>'),
  (3, 'nope', 'nope > 0', 'no such column: nope'),
  (4, 'l_quantity', 'l_quantity > many', 'not a number: ''many'''),
  (5, 'l_quantity', 'l_quantity < nope', 'no such column: nope'),
  (6, 'l_tax', 'l_tax <', 'cannot apply rule: PARSE_SYNTAX_ERROR')) t(rule_no, "column", rule, error)""",
)
def rule_errors(spark, sf_dir):
    checked = rules.validate_constraints(_lines(spark, sf_dir), RULES[:1] + BAD_RULES)
    return checked.where(F.col("error").isNotNull())


@query(
    "constraint_samples",
    cte("rule_lineitem")
    + f"""
SELECT {KEY}, l_quantity, l_discount, l_tax, l_returnflag FROM rule_lineitem
WHERE NOT coalesce(l_quantity > 0, false)
ORDER BY l_orderkey, l_linenumber, l_quantity NULLS FIRST, l_discount, l_tax, l_returnflag LIMIT 10""",
)
def constraint_samples(spark, sf_dir):
    return rules.constraint_samples(
        _lines(spark, sf_dir), RULES[0], ["l_orderkey", "l_linenumber"]
    )


@query(
    "constraint_drop_row",
    cte("rule_lineitem")
    + "\nSELECT * FROM rule_lineitem WHERE l_quantity > 0 AND l_discount >= l_tax",
)
def constraint_drop_row(spark, sf_dir):
    actions = {"l_quantity": "drop_row", "l_discount": "drop_row"}
    return rules.apply_constraint_resolution(
        _lines(spark, sf_dir), [RULES[0], RULES[2]], actions
    )


# The second rule sees the values that the first one has blanked.
_BLANK_TAX = "CASE WHEN l_tax > 0.05 THEN NULL ELSE l_tax END"


@query(
    "constraint_nullify",
    cte("rule_lineitem")
    + f"""
SELECT {KEY}, CASE WHEN l_quantity > 0 THEN l_quantity END AS l_quantity,
       CASE WHEN l_discount >= {_BLANK_TAX} THEN l_discount END AS l_discount,
       {_BLANK_TAX} AS l_tax, l_returnflag FROM rule_lineitem""",
)
def constraint_nullify(spark, sf_dir):
    chosen = [RULES[0], Rule("l_tax", "<=", 0.05), RULES[2]]
    actions = {r.column: "convert_nan" for r in chosen}
    return rules.apply_constraint_resolution(_lines(spark, sf_dir), chosen, actions)


@query(
    "constraint_flag",
    cte("rule_lineitem")
    + """
SELECT *, NOT coalesce(l_quantity > 0, false) AS l_quantity_constraint_violation,
       l_discount < l_tax AS l_discount_constraint_violation FROM rule_lineitem""",
)
def constraint_flag(spark, sf_dir):
    return rules.apply_constraint_resolution(_lines(spark, sf_dir), [RULES[0], RULES[2]], {})


@query(
    "constraint_resolution_stats",
    cte("rule_lineitem")
    + """, m AS (SELECT l_quantity, NOT coalesce(l_quantity > 0, false) AS q, l_discount < l_tax AS d FROM rule_lineitem)
SELECT CAST(rule_no AS BIGINT) AS rule_no, "column", action, CAST(affected AS BIGINT) AS affected,
       (SELECT CAST(count(*) FILTER (d) AS BIGINT) FROM m) AS total_rows_dropped, CAST(NULL AS VARCHAR) AS error FROM (
SELECT 1 AS rule_no, 'l_quantity' AS "column", 'convert_nan' AS action, count(*) FILTER (q) AS affected FROM m
UNION ALL SELECT 2, 'l_discount', 'drop_row', count(*) FILTER (d) FROM m
UNION ALL SELECT 3, 'l_returnflag', 'flag_retain',
       (SELECT count(*) FILTER (l_returnflag NOT IN ('A', 'N')) FROM rule_lineitem) )""",
)
def constraint_resolution_stats(spark, sf_dir):
    actions = {"l_quantity": "convert_nan", "l_discount": "drop_row"}
    return rules.constraint_resolution_stats(
        _lines(spark, sf_dir), [RULES[0], RULES[2], RULES[3]], actions
    )


@query(
    "constraint_big_text",
    """
SELECT CAST(1 AS BIGINT) AS rule_no, CAST(count(*) FILTER (NOT key = 9007199254740993) AS BIGINT) AS violation_count
FROM (SELECT CAST(9007199254740992 + l_orderkey % 3 AS BIGINT) AS key FROM lineitem)""",
)
def constraint_big_text(spark, sf_dir):
    # A constant beyond the whole numbers of a double, given as text.
    keys = table(spark, sf_dir, "lineitem").selectExpr("9007199254740992 + l_orderkey % 3 AS key")
    checked = rules.validate_constraints(keys, [rules.Rule("key", "==", "9007199254740993")])
    return checked.select("rule_no", "violation_count")
