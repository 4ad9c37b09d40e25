"""Correlation and multicollinearity queries."""

from catalogue.registry import cte, derived, query, rounded, table
from grainmill.operators import correlation

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "net_price", "exact_copy"]
PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]
THREE = ["l_quantity", "l_extendedprice", "net_price"]


def _corr_rows(relation: str, pairs, name: str = "r") -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS column1, '{b}' AS column2, corr({a}, {b}) AS {name} FROM {relation}"
        for a, b in pairs
    )


@query(
    "corr_pearson",
    cte("dirty_events")
    + """, c AS (SELECT event_id, user_id, value, value2 FROM dirty_events
         WHERE event_id IS NOT NULL AND user_id IS NOT NULL AND value IS NOT NULL AND value2 IS NOT NULL)
SELECT column1, column2, round(r, 4) AS r FROM ("""
    + _corr_rows(
        "c",
        [("event_id", "user_id"), ("event_id", "value"), ("event_id", "value2"),
         ("user_id", "value"), ("user_id", "value2"), ("value", "value2")],
    )
    + ")",
)
def corr_pearson(spark, sf_dir):
    events = derived(spark, sf_dir, "dirty_events")
    return correlation.correlation_matrix(events, ["event_id", "user_id", "value", "value2"])


def _rank_cte(column: str, alias: str) -> str:
    """Average rank from the running count of the rows per value."""
    return f"""{alias} AS (SELECT {column}, sum(n) OVER (ORDER BY {column}) - n + (n + 1) / 2.0 AS r
      FROM (SELECT {column}, count(*) AS n FROM lineitem GROUP BY {column}))"""


@query(
    "corr_spearman",
    f"""
WITH {_rank_cte('l_quantity', 'q')}, {_rank_cte('l_extendedprice', 'e')}, {_rank_cte('l_discount', 'd')},
r AS (SELECT CAST(q.r AS DOUBLE) AS q, CAST(e.r AS DOUBLE) AS e, CAST(d.r AS DOUBLE) AS d FROM lineitem
      JOIN q USING (l_quantity) JOIN e USING (l_extendedprice) JOIN d USING (l_discount))
SELECT 'l_quantity' AS column1, 'l_extendedprice' AS column2, round(corr(q, e), 4) AS r FROM r
UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(q, d), 4) FROM r
UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(e, d), 4) FROM r""",
)
def corr_spearman(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    return correlation.correlation_matrix(lines, columns, "spearman")


@query(
    "corr_kendall",
    """
WITH c AS (SELECT l_quantity AS x, l_discount AS y, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2),
s AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y) * a.n * b.n) / 2 AS s FROM c a, c b),
t AS (SELECT (SELECT sum(n) * (sum(n) - 1) / 2 FROM c) AS n0,
             (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY x)) AS tx,
             (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY y)) AS ty)
SELECT 'l_quantity' AS column1, 'l_discount' AS column2,
       round(s / (sqrt(n0 - tx) * sqrt(n0 - ty)), 4) AS r FROM s, t""",
)
def corr_kendall(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return correlation.correlation_matrix(lines, ["l_quantity", "l_discount"], "kendall")


RANKED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey"]
RANKED_PAIRS = [(a, b) for i, a in enumerate(RANKED) for b in RANKED[i + 1 :]]


@query(
    "corr_spearman_five",
    "WITH "
    + ", ".join(_rank_cte(c, f"rank{i}") for i, c in enumerate(RANKED))
    + ", r AS (SELECT "
    + ", ".join(f"CAST(rank{i}.r AS DOUBLE) AS {c}" for i, c in enumerate(RANKED))
    + " FROM lineitem "
    + " ".join(f"JOIN rank{i} ON lineitem.{c} = rank{i}.{c}" for i, c in enumerate(RANKED))
    + ") SELECT column1, column2, round(r, 4) AS r FROM ("
    + _corr_rows("r", RANKED_PAIRS)
    + ")",
)
def corr_spearman_five(spark, sf_dir):
    return correlation.correlation_matrix(table(spark, sf_dir, "lineitem"), RANKED, "spearman")


def _cells(pairs) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS column1, '{b}' AS column2, x, y, count(*) AS n FROM (
        SELECT dense_rank() OVER (ORDER BY {a}) AS x, dense_rank() OVER (ORDER BY {b}) AS y FROM lineitem) GROUP BY x, y"""
        for a, b in pairs
    )


# Numbers that differ first in one binary digit, counted from the top, form a group of two sides.
@query(
    "corr_kendall_five",
    f"""
WITH cells AS ({_cells(RANKED_PAIRS)}),
sides AS (SELECT column1, column2, digit, x >> (digit + 1) AS above, y,
                 sum(CASE WHEN (x >> digit) & 1 = 0 THEN n ELSE 0 END) AS zeros,
                 sum(CASE WHEN (x >> digit) & 1 = 1 THEN n ELSE 0 END) AS ones
          FROM cells, range(0, 24) digits(digit) GROUP BY ALL),
running AS (SELECT column1, column2, ones, zeros,
                   sum(zeros) OVER (w ROWS UNBOUNDED PRECEDING) - zeros AS smaller,
                   sum(zeros) OVER (PARTITION BY column1, column2, digit, above) AS total
            FROM sides WINDOW w AS (PARTITION BY column1, column2, digit, above ORDER BY y)),
s AS (SELECT column1, column2, sum(CAST(ones AS DOUBLE) * (2 * smaller + zeros - total)) AS s
      FROM running GROUP BY column1, column2),
t AS (SELECT column1, column2, sum(n) * (sum(n) - 1) / 2.0 AS n0 FROM cells GROUP BY column1, column2),
tx AS (SELECT column1, column2, sum(n * (n - 1) / 2.0) AS tx FROM
       (SELECT column1, column2, sum(n) AS n FROM cells GROUP BY column1, column2, x) GROUP BY column1, column2),
ty AS (SELECT column1, column2, sum(n * (n - 1) / 2.0) AS ty FROM
       (SELECT column1, column2, sum(n) AS n FROM cells GROUP BY column1, column2, y) GROUP BY column1, column2)
SELECT column1, column2, round(s / (sqrt(n0 - tx) * sqrt(n0 - ty)), 4) AS r
FROM s JOIN t USING (column1, column2) JOIN tx USING (column1, column2) JOIN ty USING (column1, column2)""",
)
def corr_kendall_five(spark, sf_dir):
    return correlation.correlation_matrix(table(spark, sf_dir, "lineitem"), RANKED, "kendall")


@query(
    "corr_high_pairs",
    cte("collinear")
    + f""", p AS ({_corr_rows('collinear', PAIRS)}), s AS (SELECT * FROM p WHERE abs(r) > 0.7)
SELECT CAST(row_number() OVER (ORDER BY abs(round(r, 4)) DESC, column1, column2) AS BIGINT) AS rank, column1, column2,
       round(r, 4) AS correlation, CASE WHEN abs(r) > 0.9 THEN 'high' ELSE 'moderate' END AS strength,
       CAST((SELECT count(*) FROM s) AS BIGINT) AS total_high_correlations
FROM s ORDER BY rank LIMIT 20""",
)
def corr_high_pairs(spark, sf_dir):
    return correlation.high_correlation_pairs(derived(spark, sf_dir, "collinear"), NUMBERS)


_VIF3 = """c AS (SELECT corr(l_quantity, l_extendedprice) AS r12, corr(l_quantity, net_price) AS r13,
             corr(l_extendedprice, net_price) AS r23 FROM collinear),
d AS (SELECT *, 1 + 2 * r12 * r13 * r23 - r12 * r12 - r13 * r13 - r23 * r23 AS det FROM c),
v AS (SELECT 1 AS place, 'l_quantity' AS "column", (1 - r23 * r23) / det AS vif FROM d
      UNION ALL SELECT 2, 'l_extendedprice', (1 - r13 * r13) / det FROM d
      UNION ALL SELECT 3, 'net_price', (1 - r12 * r12) / det FROM d)"""
_GRADE = """CASE WHEN vif > 20 THEN 'very_high' WHEN vif > 10 THEN 'high'
            WHEN vif > 5 THEN 'moderate' ELSE 'ok' END"""


@query(
    "vif",
    cte("collinear")
    + f""", {_VIF3}
SELECT CAST(row_number() OVER (ORDER BY round(vif, 2) DESC, place) AS BIGINT) AS rank, "column", round(vif, 2) AS vif,
       {_GRADE} AS status,
       CAST((SELECT count(*) FROM v WHERE vif > 10) AS BIGINT) AS high_vif_count FROM v""",
)
def vif(spark, sf_dir):
    lines = derived(spark, sf_dir, "collinear")
    # The binary column has two values and is left out.
    return correlation.calculate_vif(lines, [*THREE, "binary_col"])


@query(
    "vif_display",
    cte("collinear")
    + f""", {_VIF3}
SELECT "column", least(round(vif, 2), 100.0) AS display_vif, vif > 10 AS over_threshold FROM v""",
)
def vif_display(spark, sf_dir):
    return correlation.vif_display(derived(spark, sf_dir, "collinear"), THREE)


@query(
    "multicollinearity_summary",
    cte("collinear")
    + f""", {_VIF3}, p AS ({_corr_rows('collinear', [(a, b) for i, a in enumerate(THREE) for b in THREE[i + 1:]])})
SELECT CAST(3 AS BIGINT) AS columns_analyzed,
       CAST((SELECT count(*) FROM p WHERE abs(round(r, 4)) > 0.9) AS BIGINT) AS high_correlation_count,
       CAST((SELECT count(*) FROM v WHERE round(vif, 2) > 10) AS BIGINT) AS high_vif_count,
       CAST((SELECT count(*) FROM p WHERE abs(round(r, 4)) > 0.9) AS BIGINT) AS columns_recommended_for_removal""",
)
def multicollinearity_summary(spark, sf_dir):
    found = correlation.detect_multicollinearity(derived(spark, sf_dir, "collinear"), columns=THREE)
    return found.summary_frame(spark)


@query(
    "multicollinearity_recs",
    cte("collinear")
    + f""", {_VIF3}, p AS (SELECT corr(l_extendedprice, net_price) AS r FROM collinear)
SELECT 'drop' AS action, CASE WHEN a > b THEN 'l_extendedprice' ELSE 'net_price' END AS "column",
       'High correlation (' || printf('%.2f', round(r, 4)) || ') with '
       || CASE WHEN a > b THEN 'net_price' ELSE 'l_extendedprice' END AS reason
FROM p, (SELECT round(max(vif) FILTER ("column" = 'l_extendedprice'), 2) AS a,
                round(max(vif) FILTER ("column" = 'net_price'), 2) AS b FROM v)
WHERE abs(round(r, 4)) > 0.9""",
)
def multicollinearity_recs(spark, sf_dir):
    found = correlation.detect_multicollinearity(derived(spark, sf_dir, "collinear"), columns=THREE)
    return found.recommendations_frame(spark)


@query(
    "collinear_drop",
    cte("collinear") + "\nSELECT * EXCLUDE (exact_copy, net_price) FROM collinear",
)
def collinear_drop(spark, sf_dir):
    kept, _ = correlation.resolve_multicollinearity(
        derived(spark, sf_dir, "collinear"), {"exact_copy": "drop", "net_price": "drop"}
    )
    return kept


@query(
    "collinear_flag",
    cte("collinear") + "\nSELECT l_orderkey, net_price, true AS net_price_multicollinear_flag FROM collinear",
)
def collinear_flag(spark, sf_dir):
    lines = derived(spark, sf_dir, "collinear").select("l_orderkey", "net_price")
    flagged, _ = correlation.resolve_multicollinearity(
        lines, {"net_price": "flag", "l_orderkey": "keep"}
    )
    return flagged


@query(
    "collinear_combine",
    cte("collinear")
    + """
SELECT l_orderkey, l_quantity, l_discount, round(net_price / nullif(l_discount, 0), 4) AS ratio FROM collinear""",
)
def collinear_combine(spark, sf_dir):
    lines = derived(spark, sf_dir, "collinear")
    combined, _ = correlation.resolve_multicollinearity(
        lines, {"binary_col": "drop"}, {"ratio": "try_divide(net_price, l_discount)"}
    )
    return rounded(combined.select("l_orderkey", "l_quantity", "l_discount", "ratio"), 4, ["ratio"])


_EVENT_NUMBERS = ["event_id", "user_id", "value", "value2", "mostly_missing"]
_SQUARE = [(a, b) for a in _EVENT_NUMBERS for b in _EVENT_NUMBERS]


@query(
    "corr_pairwise",
    cte("dirty_events")
    + "\nSELECT column1, column2, round(r, 4) AS r FROM ("
    + _corr_rows("dirty_events", _SQUARE)
    + ")",
)
def corr_pairwise(spark, sf_dir):
    events = derived(spark, sf_dir, "dirty_events")
    return rounded(correlation.pairwise_correlations(events, _EVENT_NUMBERS), 4)


@query(
    "corr_masked",
    cte("collinear")
    + "\nSELECT column1, column2, CASE WHEN abs(r) >= 0.5 THEN round(r, 4) END AS r FROM ("
    + _corr_rows("collinear", [(a, b) for a in NUMBERS for b in NUMBERS])
    + ")",
)
def corr_masked(spark, sf_dir):
    lines = derived(spark, sf_dir, "collinear")
    return rounded(correlation.pairwise_correlations(lines, NUMBERS, 0.5), 4)


WIDE = [f"w{k}" for k in range(1, 28)]


@query(
    "corr_pearson_wide",
    cte("wide_lines")
    + "\nSELECT column1, column2, round(r, 4) AS r FROM ("
    + _corr_rows("wide_lines", [(a, b) for i, a in enumerate(WIDE) for b in WIDE[i + 1 :]])
    + ")",
)
def corr_pearson_wide(spark, sf_dir):
    return correlation.correlation_matrix(derived(spark, sf_dir, "wide_lines"))


@query(
    "corr_pairwise_wide",
    cte("wide_lines")
    + "\nSELECT column1, column2, round(r, 4) AS r FROM ("
    + _corr_rows("wide_lines", [(a, b) for a in WIDE for b in WIDE])
    + ")",
)
def corr_pairwise_wide(spark, sf_dir):
    return rounded(correlation.pairwise_correlations(derived(spark, sf_dir, "wide_lines")), 4)
