import hashlib
import io

import pytest
from pyspark.sql import functions as F
from grainmill.llm import warc
from grainmill.llm.warc import members, parse, read_archives, record, with_types, write_archives
from grainmill.session import new_folder, settle

PAGES = "page_id long, url string, html string, key string, n int, first int"


def _round_trip(spark, pages, **options):
    files = settle(write_archives(with_types(pages), new_folder(spark, "warc")))
    return files, read_archives(files, **options).collect()


def test_round_trip_with_awkward_rows(spark):
    same = "é" * 60
    rows = [
        (5, "http://a/ b\r\nX: y", same), (3, None, same), (9, "http://c", same), (4, "u", None), (6, "u", ""),
        (7, "u", "<p>" * 200_000), (8, "u", "x" * 99), (10, "u", "x" * 99), (3, None, same), (None, "u", same),
        (11, "u", "\r\n\r\nWARC/1.1\r\n\x1f\x8b\x08" * 9),
    ]
    pages = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], PAGES).repartition(3)
    _, found = _round_trip(spark, pages, range_bytes=64)
    assert len(found) == len(rows)
    by_id = {}
    for r in found:
        by_id.setdefault(r["page_id"], []).append(r)
    for page_id, _, html in rows:
        data = (html or "").encode()
        for r in by_id[None if page_id is None else str(page_id)]:
            assert r["payload_bytes"] == len(data) and r["payload_digest"] == hashlib.sha256(data).hexdigest()
            assert r["record_type"] == "revisit" or r["payload"] == data
    kinds = {k: {(r["record_type"], r["refers_to"]) for r in v} for k, v in by_id.items()}
    assert kinds["3"] == {("response", None)} and len(by_id["3"]) == 2
    assert kinds["5"] == kinds["9"] == kinds[None] == {("revisit", "3")}
    assert kinds["8"] == kinds["10"] == kinds["4"] == {("response", None)}


@pytest.mark.parametrize("step", [1, 7, 100, 10_000])
def test_every_record_has_one_owner(step):
    parts = [warc._member(record(k, "u", "text " * k + "\x1f\x8b\x08", "d", "response", None, "now")) for k in range(1, 30)]
    data = b"junk" + b"".join(parts[:10]) + b"\x1f\x8b\x08 no member" + b"".join(parts[10:]) + parts[0][:-9]
    file = io.BytesIO(data)
    seen = []
    for begin in range(0, len(data), step):
        for content in members(file, begin, min(len(data), begin + step), len(data)):
            seen.append(content)
    assert len(seen) == 29 and len(set(seen)) == 29


def test_a_changed_payload_is_noticed():
    good = record(1, "u", "abc", hashlib.sha256(b"abc").hexdigest(), "response", None, "now")
    assert parse(good)["payload"] == b"abc"
    with pytest.raises(ValueError):
        parse(good.replace(b"abc", b"abd"))


def test_files_are_cut_and_empty_tables_give_none(spark, monkeypatch):
    pages = spark.createDataFrame([(k, "u", f"page {k} " * 50, "k", 1, 2) for k in range(40)], PAGES).repartition(2)
    files, found = _round_trip(spark, pages)
    assert len(found) == 40 and files.agg({"records": "sum"}).first()[0] == 40
    assert _round_trip(spark, pages.limit(0))[1] == []


def test_ranges_are_read_by_several_tasks(spark, monkeypatch):
    """Adaptive execution does not merge the few bytes of the range rows into one task."""
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    pages = spark.createDataFrame([(k, "u", f"page {k * k} " * 50, "k", 1, 2) for k in range(60)], PAGES).repartition(3)
    files = settle(write_archives(with_types(pages), new_folder(spark, "warc")))
    whole = files.agg({"bytes": "sum"}).first()[0]
    found = read_archives(files, range_bytes=whole // 10).withColumn("task", F.spark_partition_id())
    tasks = [r["n"] for r in found.groupBy("task").agg(F.count("*").alias("n")).collect()]
    assert sum(tasks) == 60 and len(tasks) >= 8 and max(tasks) <= 15
