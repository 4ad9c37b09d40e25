"""Ingest, export, report and snapshot queries."""

from pyspark.sql import functions as F

from catalogue.registry import cte, derived, query, rounded, table
from grainmill.operators.schema import apply_schema_overrides
from grainmill.session import new_folder
from grainmill.sources import files
from grainmill.sources.report import as_markdown, prep_report
from grainmill.sources.snapshots import SnapshotStore, compare_tables, fingerprint, row_diff

ALL_ORDERS = "SELECT * FROM orders"


def _written(spark, frame, name: str, **options) -> str:
    """A fresh copy of a table in the shared folder."""
    path = f"{new_folder(spark, 'ingest')}/{name}"
    files.write_table(frame, path, **options)
    return path


@query(
    "ingest_csv",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
       CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS o_orderpriority FROM orders""",
)
def ingest_csv(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    # Every fifth priority is written as a text that means missing.
    marked = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority")).otherwise("N/A")
    path = f"{new_folder(spark, 'ingest')}/orders.csv"
    orders.withColumn("o_orderpriority", marked).write.option("header", True).option("sep", ";").csv(path)
    return apply_schema_overrides(files.read_table(spark, path), {"o_orderdate": "datetime"})


@query(
    "ingest_csv_words",
    """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END AS answer, o_orderkey % 3 = 0 AS flag,
       strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(9000000000000000000 + o_custkey AS BIGINT) AS long_number
FROM orders""",
)
def ingest_csv_words(spark, sf_dir):
    # Only numbers, true and false change their type; 19 digits keep all of them.
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "IF(o_orderkey % 2 = 0, 'yes', 'no') AS answer", "o_orderkey % 3 = 0 AS flag",
        "date_format(o_orderdate, 'yyyy-MM-dd') AS day", "9000000000000000000 + o_custkey AS long_number",
    )
    return files.read_csv(spark, _written(spark, orders, "words.csv"))


@query("ingest_json_array", "SELECT conv_id, turn, role, text FROM conversations")
def ingest_json_array(spark, sf_dir):
    # Arrays of records, as other tools write them, one a file.
    turns = table(spark, sf_dir, "conversations")
    path = f"{new_folder(spark, 'ingest')}/turns.json"
    files.write_json_arrays(turns, path)
    return files.read_json(spark, path, schema=turns.schema)


@query("ingest_parquet", "SELECT * FROM lineitem")
def ingest_parquet(spark, sf_dir):
    return files.read_table(spark, f"{sf_dir}/lineitem.parquet")


@query(
    "ingest_json",
    "SELECT conv_id, turn, role, text FROM conversations",
)
def ingest_json(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    path = _written(spark, turns, "turns.json")
    return files.read_json(spark, path, lines=True, schema=turns.schema)


@query(
    "ingest_encoding",
    "SELECT doc_id, text, lang, source, n_chars FROM documents",
)
def ingest_encoding(spark, sf_dir):
    # Accented letters in Latin-1 are not valid UTF-8, which tells them apart.
    docs = table(spark, sf_dir, "documents")
    path = f"{new_folder(spark, 'ingest')}/documents.csv"
    writer = docs.write.option("header", True).option("encoding", files.FALLBACK)
    writer.option("sep", ";").option("escape", '"').csv(path)
    return files.read_csv(spark, path, delimiter=";", types={"doc_id": "int64", "n_chars": "int64"}, multiline=True)


_DELIMITERS = {",": "','", ";": "';'", "\t": "chr(9)", "|": "'|'"}


@query(
    "detect_delimiter",
    "WITH t AS (SELECT "
    + ", ".join(
        f"CAST(sum(length(text) - length(replace(text, {q}, ''))) AS BIGINT) AS d{i}"
        for i, q in enumerate(_DELIMITERS.values())
    )
    + " FROM documents)\n"
    + " UNION ALL ".join(
        f"SELECT {q} AS delimiter, d{i} AS occurrences, "
        + " AND ".join(
            [f"d{i} > d{j}" for j in range(i)] + [f"d{i} >= d{j}" for j in range(i + 1, 4)]
        )
        + " AS chosen FROM t"
        for i, q in enumerate(_DELIMITERS.values())
    ),
)
def detect_delimiter(spark, sf_dir):
    return files.delimiter_counts(table(spark, sf_dir, "documents"), "text")


@query(
    "ingest_metadata",
    """
SELECT 'lineitem.parquet' AS source_file, 'parquet' AS format, CAST(NULL AS VARCHAR) AS encoding,
       CAST(NULL AS VARCHAR) AS delimiter, CAST(count(*) AS BIGINT) AS row_count, CAST(11 AS BIGINT) AS col_count
FROM lineitem
UNION ALL SELECT 'orders.csv', 'csv', 'UTF-8', ',', CAST(count(*) AS BIGINT), 6 FROM orders""",
)
def ingest_metadata(spark, sf_dir):
    path = _written(spark, table(spark, sf_dir, "orders"), "orders.csv")
    return files.ingest_metadata(spark, f"{sf_dir}/lineitem.parquet").unionByName(
        files.ingest_metadata(spark, path)
    )


@query("export_roundtrip_csv", "SELECT page_id, url, html FROM pages")
def export_roundtrip_csv(spark, sf_dir):
    # Raw web pages hold commas, quotes and line breaks.
    path = _written(spark, table(spark, sf_dir, "pages"), "pages.csv")
    return files.read_csv(spark, path, delimiter=",", types={"page_id": "int64"}, multiline=True)


@query("export_roundtrip_parquet", ALL_ORDERS)
def export_roundtrip_parquet(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    path = _written(spark, orders, "orders.parquet", partition_by=["o_orderstatus"])
    return files.read_table(spark, path).select(*orders.columns)


@query(
    "export_roundtrip_json",
    cte("dirty_events") + "\nSELECT * FROM dirty_events",
)
def export_roundtrip_json(spark, sf_dir):
    events = derived(spark, sf_dir, "dirty_events")
    path = _written(spark, events, "events.json")
    return files.read_json(spark, path, lines=True, schema=events.schema)


_REPORT_TYPES = {
    "event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string",
    "value": "double", "value2": "double", "mostly_missing": "double", "all_missing": "double",
    "const_col": "int",
}
_REPORT_NUMBERS = [c for c, t in _REPORT_TYPES.items() if t in ("bigint", "int", "double")]
_STATS = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "median": "median"}


@query(
    "prep_report",
    cte("dirty_events")
    + """
SELECT 'summary' AS section, CAST(NULL AS VARCHAR) AS "column", 'rows' AS metric,
       CAST(count(*) AS VARCHAR) AS value FROM dirty_events
UNION ALL SELECT 'summary', NULL, 'columns', '9'
"""
    + "".join(
        f"UNION ALL SELECT 'types', '{c}', 'type', '{t}'\n" for c, t in _REPORT_TYPES.items()
    )
    + "".join(
        f"""UNION ALL SELECT 'missing', '{c}', 'missing_count', CAST(count(*) - count({c}) AS VARCHAR)
        FROM dirty_events HAVING count(*) > count({c})
        UNION ALL SELECT 'missing', '{c}', 'missing_pct', printf('%.2f', (count(*) - count({c})) / CAST(count(*) AS DOUBLE) * 100)
        FROM dirty_events HAVING count(*) > count({c})
        """
        for c in _REPORT_TYPES
    )
    + "".join(
        f"""UNION ALL SELECT 'numeric', '{c}', '{m}', CASE WHEN count({c}) > 0
        THEN printf('%.2f', CAST({e}({c}) AS DOUBLE)) END FROM dirty_events
        """
        for c in _REPORT_NUMBERS
        for m, e in _STATS.items()
    ),
)
def report(spark, sf_dir):
    return prep_report(derived(spark, sf_dir, "dirty_events"))


def _store(spark) -> SnapshotStore:
    return SnapshotStore(spark, new_folder(spark, "snapshots"))


def _two_states(spark, sf_dir) -> SnapshotStore:
    """A raw and a cleaned state on the main branch, a branch off the raw one."""
    store = _store(spark)
    before = store.commit("df_raw", derived(spark, sf_dir, "state_before"), {}, "raw")
    store.create_branch("trial", "df_raw")
    store.commit("df_final", derived(spark, sf_dir, "state_after"), {"cap": 150}, "capped")
    store.commit("df_final", before.drop("event_type"), {}, "column dropped", "trial")
    return store


_MANIFEST = ["branch", "seq", "id", "parent", "row_count", "col_count", "config_snapshot", "delta_summary"]


@query(
    "snapshot_commit",
    cte("state_before", "state_after")
    + """
SELECT 'main' AS branch, CAST(0 AS BIGINT) AS seq, 'df_raw' AS id, CAST(NULL AS VARCHAR) AS parent,
       CAST(count(*) AS BIGINT) AS row_count, CAST(3 AS INT) AS col_count, '{}' AS config_snapshot,
       'raw' AS delta_summary FROM state_before
UNION ALL SELECT 'main', 1, 'df_final', 'df_raw', CAST(count(*) AS BIGINT), 3, '{"cap": 150}', 'capped'
FROM state_after""",
)
def snapshot_commit(spark, sf_dir):
    return _two_states(spark, sf_dir).history().select(*_MANIFEST)


@query("snapshot_load", cte("state_after") + "\nSELECT * FROM state_after")
def snapshot_load(spark, sf_dir):
    return _two_states(spark, sf_dir).load("df_final")


@query("snapshot_current", cte("state_before") + "\nSELECT event_id, value FROM state_before")
def snapshot_current(spark, sf_dir):
    return _two_states(spark, sf_dir).current("trial")


@query(
    "snapshot_fork",
    cte("state_before")
    + """
SELECT 'trial' AS branch, CAST(0 AS BIGINT) AS seq, 'df_raw' AS id, CAST(NULL AS VARCHAR) AS parent,
       CAST(count(*) AS BIGINT) AS row_count, CAST(3 AS INT) AS col_count, '{}' AS config_snapshot,
       'branched off df_raw of main' AS delta_summary, 'main' AS from_branch, 'df_raw' AS from_state FROM state_before
UNION ALL SELECT 'trial', 1, 'df_final', 'df_raw', CAST(count(*) AS BIGINT), 2, '{}', 'column dropped', NULL, NULL
FROM state_before""",
)
def snapshot_fork(spark, sf_dir):
    return _two_states(spark, sf_dir).history("trial").select(
        *_MANIFEST,
        F.col("forked_from.branch").alias("from_branch"),
        F.col("forked_from.state_id").alias("from_state"),
    )


@query(
    "branch_summary",
    cte("state_before", "state_after")
    + """
SELECT 'main' AS branch, CAST(2 AS BIGINT) AS states, 'df_final' AS terminal_state,
       CAST(count(*) AS BIGINT) AS row_count, CAST(3 AS INT) AS col_count FROM state_after
UNION ALL SELECT 'trial', 2, 'df_final', CAST(count(*) AS BIGINT), 2 FROM state_before""",
)
def branch_summary(spark, sf_dir):
    return _two_states(spark, sf_dir).branch_summary().drop("last_modified")


@query(
    "compare_snapshots",
    cte("state_before", "state_after")
    + """
SELECT (SELECT CAST(count(*) AS BIGINT) FROM state_after) AS rows_a,
       (SELECT CAST(count(*) AS BIGINT) FROM state_before) AS rows_b,
       CAST(3 AS BIGINT) AS cols_a, CAST(2 AS BIGINT) AS cols_b,
       'event_type' AS columns_only_in_a, '' AS columns_only_in_b, 'event_id,value' AS common_columns""",
)
def compare_snapshots(spark, sf_dir):
    return _two_states(spark, sf_dir).compare_branches("main", "trial", "df_final")


@query(
    "compare_tables",
    cte("dirty_events", "state_before")
    + """
SELECT (SELECT CAST(count(*) AS BIGINT) FROM state_before) AS rows_a,
       (SELECT CAST(count(*) AS BIGINT) FROM dirty_events) AS rows_b,
       CAST(3 AS BIGINT) AS cols_a, CAST(9 AS BIGINT) AS cols_b, '' AS columns_only_in_a,
       'all_missing,const_col,mostly_missing,ts,user_id,value2' AS columns_only_in_b,
       'event_id,event_type,value' AS common_columns""",
)
def compare_two_tables(spark, sf_dir):
    return compare_tables(
        derived(spark, sf_dir, "state_before"), derived(spark, sf_dir, "dirty_events")
    )


@query(
    "snapshot_row_diff",
    cte("state_before", "state_after")
    + """
SELECT *, 'only_in_a' AS side, CAST(1 AS BIGINT) AS n FROM
  (SELECT * FROM state_before EXCEPT ALL SELECT * FROM state_after)
UNION ALL
SELECT *, 'only_in_b', 1 FROM (SELECT * FROM state_after EXCEPT ALL SELECT * FROM state_before)""",
)
def snapshot_row_diff(spark, sf_dir):
    store = _two_states(spark, sf_dir)
    return row_diff(store.load("df_raw"), store.load("df_final"))


_PRINTED = {"l_shipdate": "strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%f')"}
_LINE_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]


def _measured_text(c: str) -> str:
    text = _PRINTED.get(c, f"CAST({c} AS VARCHAR)")
    return f"coalesce(strlen({text}) || ':' || {text}, '~')"


@query(
    "fingerprint",
    "SELECT CAST(count(*) AS BIGINT) AS row_count, CAST(sum(CAST('0x' || left(md5("
    + " || ".join(_measured_text(c) for c in _LINE_COLUMNS)
    + "), 15) AS BIGINT)::HUGEINT) AS VARCHAR) AS row_hash_sum FROM lineitem",
)
def fingerprint_lines(spark, sf_dir):
    return fingerprint(table(spark, sf_dir, "lineitem"), portable=True)


@query("snapshot_export", cte("state_before") + "\nSELECT * FROM state_before")
def snapshot_export(spark, sf_dir):
    folder = new_folder(spark, "export")
    _two_states(spark, sf_dir).export(folder)
    return rounded(spark.read.parquet(f"{folder}/df_raw"), 9)


@query(
    "snapshot_export_manifest",
    cte("state_before", "state_after")
    + """
SELECT 'main' AS branch, CAST(0 AS BIGINT) AS seq, 'df_raw' AS id, CAST(count(*) AS BIGINT) AS row_count,
       '{"cap": 150}' AS config FROM state_before
UNION ALL SELECT 'main', 1, 'df_final', CAST(count(*) AS BIGINT), '{"cap": 150}' FROM state_after
UNION ALL SELECT 'trial', 0, 'df_raw', CAST(count(*) AS BIGINT), '{"cap": 150}' FROM state_before
UNION ALL SELECT 'trial', 1, 'df_final', CAST(count(*) AS BIGINT), '{"cap": 150}' FROM state_before""",
)
def snapshot_export_manifest(spark, sf_dir):
    folder = new_folder(spark, "export")
    _two_states(spark, sf_dir).export(folder)
    manifest = spark.read.json(f"{folder}/manifest").select("branch", "seq", "id", "row_count")
    # One row of configuration, read back beside the manifest.
    config = spark.read.text(f"{folder}/config").first()["value"]
    return manifest.withColumn("config", F.lit(config))


@query(
    "report_text",
    """
SELECT line FROM (SELECT unnest(['# Data preparation report', '## Summary', '- rows: ' || count(*), '- columns: 4',
  '## Types', '- p_size type: int', '- p_retailprice type: double', '- p_brand type: string', '- p_type type: string',
  '## Numeric',
  '- p_size mean: ' || printf('%.2f', avg(p_size)), '- p_size std: ' || printf('%.2f', stddev_samp(p_size)),
  '- p_size min: ' || printf('%.2f', min(p_size)::DOUBLE), '- p_size max: ' || printf('%.2f', max(p_size)::DOUBLE),
  '- p_size median: ' || printf('%.2f', median(p_size)),
  '- p_retailprice mean: ' || printf('%.2f', avg(p_retailprice)),
  '- p_retailprice std: ' || printf('%.2f', stddev_samp(p_retailprice)),
  '- p_retailprice min: ' || printf('%.2f', min(p_retailprice)), '- p_retailprice max: ' || printf('%.2f', max(p_retailprice)),
  '- p_retailprice median: ' || printf('%.2f', median(p_retailprice))]) AS line FROM part)""",
)
def report_text(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_size", "p_retailprice", "p_brand", "p_type")
    lines = [line for line in as_markdown(prep_report(parts)).split("\n") if line]
    return spark.createDataFrame([(line,) for line in lines], "line string")
