import json

import pytest
from pyspark.sql import functions as F

from catalogue.sources import ingest_json_array
from grainmill.sources import files, snapshots
from grainmill.sources.report import as_markdown, prep_report
from grainmill.sources.snapshots import SnapshotStore, StateNotFoundError


def _write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv_types_and_missing_tokens(spark, tmp_path):
    text = "id;price;day;ok;note\n1;1.5;2024-01-02;yes;a\n2;NA;;no;\"x;\ny\"\n3;n/a;2024-01-04;YES;None\n"
    df = files.read_table(spark, _write(tmp_path / "t.csv", text), multiline=True)
    # Dates and words stay text; true and false would not.
    assert df.dtypes == [
        ("id", "bigint"), ("price", "double"), ("day", "string"), ("ok", "string"), ("note", "string"),
    ]
    rows = df.orderBy("id").collect()
    assert [r["price"] for r in rows] == [1.5, None, None]
    assert [r["ok"] for r in rows] == ["yes", "no", "YES"]
    text = "flag;big;huge\nTrue;1234567890123456789;1\nfalse;1;99999999999999999999\n"
    df = files.read_table(spark, _write(tmp_path / "u.csv", text))
    assert df.dtypes == [("flag", "boolean"), ("big", "bigint"), ("huge", "double")]
    assert df.first()["big"] == 1234567890123456789
    assert [r["note"] for r in rows] == ["a", "x;\ny", None]


@pytest.mark.parametrize("delimiter", files.DELIMITERS)
def test_delimiters(spark, tmp_path, delimiter):
    path = _write(tmp_path / "t.csv", f"a{delimiter}b\n1{delimiter}2\n")
    assert files.detect_delimiter(spark, path) == delimiter


def test_no_delimiter_means_comma(spark, tmp_path):
    assert files.detect_delimiter(spark, _write(tmp_path / "t.csv", "a\n1\n")) == ","


def test_latin1_keeps_the_delimiter(spark, tmp_path):
    path = _write(tmp_path / "t.csv", "name;n\nCafé;1\nNiño;2\n", "latin-1")
    assert files.detect_encoding(spark, path) == "ISO-8859-1"
    df = files.read_table(spark, path)
    assert sorted(r["name"] for r in df.collect()) == ["Café", "Niño"]
    row = files.ingest_metadata(spark, path).first()
    assert (row["encoding"], row["delimiter"], row["row_count"], row["col_count"]) == (
        "ISO-8859-1", ";", 2, 2,
    )


def test_utf8_with_replacement_character(spark, tmp_path):
    path = _write(tmp_path / "t.csv", "a,b\n�,é\n")
    assert files.detect_encoding(spark, path) == "UTF-8"


def test_json_array(spark, tmp_path):
    path = _write(tmp_path / "t.json", json.dumps([{"a": 1, "b": None}, {"a": 2, "b": "x"}], indent=2))
    assert sorted(tuple(r) for r in files.read_table(spark, path).collect()) == [(1, None), (2, "x")]


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        files.read_table(spark, "table.xlsx")
    with pytest.raises(ValueError):
        files.write_table(spark.range(1), "table", "orc")


def test_csv_round_trip_of_hard_texts(spark, tmp_path):
    rows = [(1, 'a "quoted" word'), (2, "two\nlines"), (3, "comma, semicolon;"), (4, None), (5, "é\\n")]
    df = spark.createDataFrame(rows, "id bigint, t string")
    path = str(tmp_path / "out.csv")
    files.write_table(df, path)
    back = files.read_csv(spark, path, types={"id": "int64"}, multiline=True)
    assert sorted(tuple(r) for r in back.collect()) == rows


def test_report_text(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b")], "x double, s string")
    text = as_markdown(prep_report(df, {"big": "y" * 3000}))
    assert "- x missing_pct: 50.00" in text and "y" * 3000 in text and "- rows: 2" in text


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    assert store.current() is None and store.current_id() is None
    store.commit("df_raw", spark.range(5).toDF("a"), {"n": 1}, "raw")
    store.commit("df_final", spark.range(3).selectExpr("id AS a", "id AS b"), {}, "cut")
    # A later commit of the same state wins; the earlier files stay.
    store.commit("df_final", spark.range(4).toDF("a"), {"n": 2}, "again")
    assert store.current_id() == "df_final" and store.load("df_final").count() == 4
    history = store.history().collect()
    assert [(r["seq"], r["parent"], r["row_count"]) for r in history] == [
        (0, None, 5), (1, "df_raw", 3), (2, "df_final", 4),
    ]
    assert spark.read.parquet(history[1]["path"]).count() == 3

    store.create_branch("trial", "df_raw")
    assert store.current("trial").count() == 5
    fork = store.history("trial").first()
    assert fork["path"] == history[0]["path"] and fork["forked_from"]["state_id"] == "df_raw"
    assert json.loads(fork["config_snapshot"]) == {"n": 1}
    store.commit("df_final", spark.range(2).toDF("b"), branch="trial")
    row = store.compare_branches("main", "trial", "df_final").first()
    assert (row["rows_a"], row["rows_b"], row["columns_only_in_a"], row["columns_only_in_b"]) == (
        4, 2, "a", "b",
    )
    assert {r["branch"]: r["states"] for r in store.branch_summary().collect()} == {
        "main": 3, "trial": 2,
    }
    with pytest.raises(StateNotFoundError):
        store.load("nope")
    with pytest.raises(StateNotFoundError):
        store.commit("x", spark.range(1), branch="nowhere")
    with pytest.raises(ValueError):
        store.create_branch("trial", "df_raw")

    store.export(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "df_raw")).count() == 5
    assert spark.read.json(str(tmp_path / "out" / "manifest")).count() == 5
    assert json.loads(spark.read.text(str(tmp_path / "out" / "config")).first()[0]) == {"n": 2}


def test_a_commit_that_failed_can_be_repeated(spark, tmp_path, monkeypatch):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    with monkeypatch.context() as patch:
        patch.setattr(store, "_add", lambda row: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            store.commit("df_raw", spark.range(5).toDF("a"))
    assert store.current() is None
    store.commit("df_raw", spark.range(6).toDF("a"))
    assert store.current().count() == 6 and store.history().count() == 1


def test_json_arrays_keep_all_rows_of_many_partitions(spark, tmp_path, monkeypatch):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    kept = spark.conf.get(key)
    texts = ['a "quoted" } { [ word', "two\nlines", "back\\slash\\", "it's", None]
    rows = [(k, texts[k % 5] and f"{texts[k % 5]} {k}") for k in range(1000)]
    turns = spark.createDataFrame(rows, "conv_id bigint, text string")
    turns.repartition(7).write.parquet(str(tmp_path / "conversations.parquet"))
    monkeypatch.setattr(files, "ARRAY_RECORDS", 50)
    spark.conf.set(key, "false")
    try:
        back = ingest_json_array(spark, str(tmp_path)).select("conv_id", "text").collect()
    finally:
        spark.conf.set(key, kept)
    assert sorted(map(tuple, back)) == rows
    files.write_json_arrays(turns.limit(0), str(tmp_path / "none.json"))
    assert files.read_json(spark, str(tmp_path / "none.json"), schema=turns.schema).count() == 0


def test_json_files_have_one_root(spark, tmp_path):
    """As stated: of a file the first array counts; a folder may hold many files."""
    record = {"a": 'x } ] [ { " \\', "b": [{"c": "it's"}, {}], "d": "'}'"}
    whole = json.dumps([record] * 9, indent=1)
    for k, text in enumerate([whole, json.dumps(record), "[]", f"{whole}\n{whole}"]):
        _write(tmp_path / f"{k}.json", text)
    assert files.read_json(spark, str(tmp_path / "0.json")).count() == 9
    assert files.read_json(spark, str(tmp_path / "3.json")).count() == 9
    assert files.read_json(spark, str(tmp_path)).count() == 19
    found = files.read_json(spark, str(tmp_path / "1.json")).first()
    assert (found["a"], found["d"]) == (record["a"], record["d"])


def test_fingerprints_tell_close_states_apart(spark):
    """Fractions of a second, the last digit, a missing value and its mark, a bar that moves, a column that is missing."""
    schema = "t timestamp, d double, a string, b string"
    rows = [
        ("2024-01-01 00:00:00.000001", 0.1, "x", "y"), ("2024-01-01 00:00:00.000002", 0.1, "x", "y"),
        ("2024-01-01 00:00:00.000001", 0.1 + 2**-56, "x", "y"), ("2024-01-01 00:00:00.000001", 0.1, "-", "y"),
        ("2024-01-01 00:00:00.000001", 0.1, None, "y"), ("2024-01-01 00:00:00.000001", 0.1, "~", "y"),
        ("2024-01-01 00:00:00.000001", 0.1, "x|", "y"), ("2024-01-01 00:00:00.000001", 0.1, "x", "|y"),
        ("2024-01-01 00:00:00.000001", 0.1, "y", None), ("2024-01-01 00:00:00.000001", 0.1, "", "y"),
    ]
    for portable in (False, True):
        seen = set()
        for t, *rest in rows:
            df = spark.createDataFrame([(t, *rest)], "t string, d double, a string, b string")
            df = df.withColumn("t", F.col("t").cast("timestamp"))
            assert df.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
            seen.add(tuple(snapshots.fingerprint(df, portable).first()))
        assert len(seen) == len(rows)
        twice = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
        shuffled = spark.createDataFrame([(2, None), (1, "a")], "i int, s string")
        assert snapshots.fingerprint(twice, portable).first() == snapshots.fingerprint(shuffled, portable).first()


def test_a_second_commit_of_a_number_is_refused(spark, tmp_path, monkeypatch):
    store = snapshots.SnapshotStore(spark, str(tmp_path / "store"))
    df = spark.range(3).toDF("id")
    store.commit("a", df)
    late = snapshots.SnapshotStore(spark, str(tmp_path / "store"))
    before = late._last("main")
    store.commit("b", df)
    monkeypatch.setattr(late, "_last", lambda branch: before)  # it has looked before the other one committed
    with pytest.raises(snapshots.ConcurrentCommitError):
        late.commit("c", df)
    monkeypatch.undo()
    with pytest.raises(Exception):  # a commit that fails gives its number back
        store.commit("bad", df.selectExpr("raise_error('no') AS id"))
    store.commit("c", df)
    assert [r["seq"] for r in store.history().collect()] == [0, 1, 2]
