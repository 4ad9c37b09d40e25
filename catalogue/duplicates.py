"""Duplicate and near-duplicate queries."""

from pyspark.sql import functions as F

from catalogue.registry import cte, derived, query, table
from grainmill.functions import similarity
from grainmill.operators import duplicates
from grainmill.operators.near_duplicates import near_duplicate_classes, near_duplicates

WHOLE = "p_partkey, p_brand, p_type, p_size"


def _parts(spark, sf_dir):
    return derived(spark, sf_dir, "dup_part")


@query(
    "exact_dup_stats",
    cte("dup_part")
    + f"""
SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total_duplicates, CAST(count(*) AS BIGINT) AS unique_groups,
       CAST(coalesce(sum(n), 0) - count(*) AS BIGINT) AS rows_to_remove
FROM (SELECT count(*) AS n FROM dup_part GROUP BY {WHOLE} HAVING count(*) > 1)""",
)
def exact_dup_stats(spark, sf_dir):
    return duplicates.duplicate_stats(_parts(spark, sf_dir).drop("copy_no"))


@query(
    "dup_sample_groups",
    cte("dup_part")
    + f""",
g AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_partkey) AS group_rank FROM
      (SELECT {WHOLE}, count(*) AS n FROM dup_part GROUP BY {WHOLE} HAVING count(*) > 1))
SELECT CAST(group_rank AS BIGINT) AS group_rank, CAST(n AS BIGINT) AS group_size,
       CAST(r AS BIGINT) AS row_rank, {WHOLE}
FROM (SELECT g.*, unnest(range(1, least(n, 3) + 1)) AS r FROM g WHERE group_rank <= 5)""",
)
def dup_sample_groups(spark, sf_dir):
    return duplicates.sample_duplicate_groups(_parts(spark, sf_dir).drop("copy_no"))


@query(
    "subset_dup_stats",
    """
SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total_duplicates, CAST(count(*) AS BIGINT) AS unique_groups,
       CAST(coalesce(sum(n), 0) - count(*) AS BIGINT) AS rows_to_remove
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""",
)
def subset_dup_stats(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return duplicates.duplicate_stats(lines, ["l_orderkey", "l_linenumber"])


_LINE = "l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*_LINE.split(", "))


def _ranked(direction: str) -> str:
    order = ", ".join(f"{c} {direction}" for c in _LINE.split(", ")[2:])
    return f"""
SELECT {_LINE} FROM (SELECT {_LINE}, row_number() OVER (
    PARTITION BY l_orderkey, l_linenumber ORDER BY {order}) AS rn FROM lineitem) WHERE rn = 1"""


@query("dedup_keep_first", _ranked("ASC"))
def dedup_keep_first(spark, sf_dir):
    return duplicates.resolve_duplicates(
        _lines(spark, sf_dir), "keep_first", ["l_orderkey", "l_linenumber"], ["l_shipdate"]
    )


@query("dedup_keep_last", _ranked("DESC"))
def dedup_keep_last(spark, sf_dir):
    return duplicates.resolve_duplicates(
        _lines(spark, sf_dir), "keep_last", ["l_orderkey", "l_linenumber"], ["l_shipdate"]
    )


@query(
    "dedup_exact",
    cte("dup_part") + f"\nSELECT DISTINCT {WHOLE} FROM dup_part",
)
def dedup_exact(spark, sf_dir):
    return duplicates.resolve_duplicates(_parts(spark, sf_dir).drop("copy_no"))


@query(
    "dedup_drop_all",
    """
SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice
FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1""",
)
def dedup_drop_all(spark, sf_dir):
    return duplicates.resolve_duplicates(
        _lines(spark, sf_dir), "drop_all", ["l_orderkey", "l_linenumber"]
    )


@query(
    "dedup_stats",
    cte("dup_part")
    + f""", g AS (SELECT count(*) AS n FROM dup_part GROUP BY {WHOLE})
SELECT CAST(sum(n) AS BIGINT) AS original_rows, CAST(count(*) AS BIGINT) AS remaining_rows,
       CAST(sum(n) - count(*) AS BIGINT) AS removed_rows, 'keep_first' AS strategy,
       CAST(NULL AS VARCHAR) AS subset FROM g
UNION ALL
SELECT CAST(sum(n) AS BIGINT), CAST(count(*) FILTER (n = 1) AS BIGINT),
       CAST(sum(n) - count(*) FILTER (n = 1) AS BIGINT), 'drop_all', 'p_brand,p_type'
FROM (SELECT count(*) AS n FROM dup_part GROUP BY p_brand, p_type)""",
)
def dedup_stats(spark, sf_dir):
    parts = _parts(spark, sf_dir).drop("copy_no")
    return duplicates.resolution_stats(parts, "keep_first").unionByName(
        duplicates.resolution_stats(parts, "drop_all", ["p_brand", "p_type"])
    )


def _chars(text: str) -> str:
    return f"CASE WHEN {text} = '' THEN [] ELSE list_distinct(string_split(lower({text}), '')) END"


_JACCARD = """CASE WHEN a IS NULL OR b IS NULL THEN a IS NULL AND b IS NULL
    WHEN len(a) = 0 OR len(b) = 0 THEN len(a) = len(b)
    ELSE len(list_intersect(a, b)) / CAST(len(a) + len(b) - len(list_intersect(a, b)) AS DOUBLE) >= 0.9 END"""
_NUMBERS = """CASE WHEN x IS NULL OR y IS NULL THEN false WHEN x = y THEN true
    WHEN x = 0 OR y = 0 THEN abs(x - y) <= 0.05
    ELSE abs(x - y) / CAST(greatest(abs(x), abs(y)) AS DOUBLE) <= 0.05 END"""


@query(
    "near_dup_adjacent",
    f"""
SELECT previous_doc_id, doc_id FROM (
  SELECT lag(doc_id) OVER w AS previous_doc_id, doc_id, {_chars('text')} AS a, lag({_chars('text')}) OVER w AS b,
         n_chars AS x, lag(n_chars) OVER w AS y
  FROM documents WINDOW w AS (ORDER BY doc_id))
WHERE previous_doc_id IS NOT NULL AND {_JACCARD} AND {_NUMBERS}""",
)
def near_dup_adjacent(spark, sf_dir):
    docs = derived(spark, sf_dir, "adjacent_docs")
    return near_duplicates(docs, ["doc_id"], ["text"], ["n_chars"])


@query(
    "near_dup_blocked",
    f"""
SELECT previous_lang, previous_n_chars, previous_doc_id, lang, n_chars, doc_id FROM (
  SELECT lag(lang) OVER w AS previous_lang, lag(n_chars) OVER w AS previous_n_chars,
         lag(doc_id) OVER w AS previous_doc_id, lang, n_chars, doc_id, {_chars('text')} AS a,
         lag({_chars('text')}) OVER w AS b, n_chars AS x, lag(n_chars) OVER w AS y
  FROM documents WINDOW w AS (PARTITION BY lang ORDER BY n_chars, doc_id))
WHERE previous_doc_id IS NOT NULL AND {_JACCARD} AND {_NUMBERS}""",
)
def near_dup_blocked(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return near_duplicates(
        docs, ["n_chars", "doc_id"], ["text"], ["n_chars"], block_by=["lang"]
    )


@query(
    "similar_strings",
    f"""
SELECT conv_id, turn, {_JACCARD} AS similar FROM (
  SELECT conv_id, turn, {_chars('text')} AS a, {_chars('role')} AS b FROM conversations)
UNION ALL
SELECT conv_id, turn, {_JACCARD} FROM (
  SELECT conv_id, turn, {_chars('text')} AS a, {_chars("replace(text, 'e', 'E')")} AS b FROM conversations)""",
)
def similar_strings(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    pairs = turns.select("conv_id", "turn", "text", F.col("role").alias("other")).unionByName(
        turns.select("conv_id", "turn", "text", F.replace("text", F.lit("e"), F.lit("E")).alias("other"))
    )
    similar = similarity.similar_strings(F.col("text"), F.col("other"), 0.9)
    return pairs.select("conv_id", "turn", similar.alias("similar"))


@query(
    "similar_numbers",
    f"""
SELECT l_orderkey, l_linenumber, l_partkey, {_NUMBERS} AS similar FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_discount AS x, l_tax AS y FROM lineitem)""",
)
def similar_numbers(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    similar = similarity.similar_numbers(F.col("l_discount"), F.col("l_tax"), 0.05)
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", similar.alias("similar"))


@query(
    "near_dup_default",
    f"""
SELECT previous_o_orderkey, o_orderkey FROM (
  SELECT lag(o_orderkey) OVER w AS previous_o_orderkey, o_orderkey,
         o_orderstatus AS s, lag(o_orderstatus) OVER w AS ps, o_orderpriority AS p, lag(o_orderpriority) OVER w AS pp,
         o_orderkey % 2 AS x, lag(o_orderkey % 2) OVER w AS px, o_custkey % 4 AS y, lag(o_custkey % 4) OVER w AS py
  FROM orders WINDOW w AS (ORDER BY o_orderkey))
WHERE previous_o_orderkey IS NOT NULL AND s = ps AND p = pp AND y = py""",
)
def near_dup_default(spark, sf_dir):
    # Four text columns; the rows of a pair agree in the first three more often than in the fourth.
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_orderstatus", "o_orderpriority", "'same' AS constant",
        "element_at(array('abcd', 'efgh', 'ijkl', 'mnop'), int(o_custkey % 4) + 1) AS fourth",
    )
    return near_duplicates(orders, ["o_orderkey"])


_CLASSES = f"""WITH docs AS (SELECT doc_id, lang, n_chars AS number, {_chars('text')} AS letters,
    CASE WHEN text IS NULL THEN NULL ELSE array_to_string(list_sort({_chars('text')}), '') END AS set FROM documents)"""


@query(
    "near_dup_members",
    _CLASSES + """
SELECT doc_id, min(doc_id) OVER (PARTITION BY set) AS first_doc_id FROM docs""",
)
def near_dup_members(spark, sf_dir):
    return near_duplicate_classes(table(spark, sf_dir, "documents"), ["doc_id"], ["text"], []).members


@query(
    "near_dup_pairs",
    _CLASSES + f""", k AS (SELECT set, any_value(letters) AS letters, min(doc_id) AS first, count(*) AS n FROM docs GROUP BY set)
SELECT first AS first_doc_id, second AS second_doc_id, n, other_n FROM (
  SELECT x.first, y.first AS second, x.n, y.n AS other_n, x.letters AS a, y.letters AS b
  FROM k x JOIN k y ON x.first < y.first)
WHERE {_JACCARD}""",
)
def near_dup_pairs(spark, sf_dir):
    return near_duplicate_classes(table(spark, sf_dir, "documents"), ["doc_id"], ["text"], []).pairs


@query(
    "near_dup_summary",
    _CLASSES + f""", k AS (SELECT lang, set, number, any_value(letters) AS letters, min(doc_id) AS first, count(*) AS n
      FROM docs GROUP BY lang, set, number, CASE WHEN number IS NULL THEN doc_id END),
p AS (SELECT n * other_n AS found FROM (
  SELECT x.n, y.n AS other_n, x.letters AS a, y.letters AS b, x.number AS x, y.number AS y
  FROM k x JOIN k y ON x.first < y.first AND x.lang IS NOT DISTINCT FROM y.lang)
  WHERE {_JACCARD} AND {_NUMBERS})
SELECT CAST((SELECT count(*) FROM k) AS BIGINT) AS classes, CAST((SELECT count(*) FROM p) AS BIGINT) AS class_pairs,
       CAST(coalesce((SELECT sum(found) FROM p), 0)
            + (SELECT coalesce(sum(n * (n - 1) // 2), 0) FROM k WHERE number IS NOT NULL) AS BIGINT) AS candidates_found""",
)
def near_dup_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return near_duplicate_classes(docs, ["doc_id"], ["text"], ["n_chars"], block_by=["lang"]).summary()
