"""The registered queries against SQL, and their columns."""

import __spark_entry__ as entry
import pytest
from grainmill.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op2_licenses": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op6_decontaminate": ["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_matches", "item_words"],
    "op8_quality": ["doc_id", "held_out", "score", "predicted"],
    "op9_jaccard": ["doc_id", "n_shingles", "component_id"],
    "op11_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
    "op12_extraction": ["page_id", "url", "text", "n_chars"],
    "op10_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
}


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    ours = sorted(map(str, (tuple(r[c] for c in columns) for r in found.collect())))
    answer = duck.sql(ORACLES[name])
    names = [d[0] for d in answer.description]
    place = [names.index(c) for c in columns]
    assert ours == sorted(str(tuple(row[k] for k in place)) for row in answer.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    found = QUERIES[name](spark, SF)
    assert found.columns == COLUMNS[name]
    table = "pages" if name == "op12_extraction" else "documents"
    docs = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert found.count() == docs or name == "op6_decontaminate"
