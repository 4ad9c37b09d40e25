import zlib
from collections import defaultdict

import corpus_pipeline
import pandas as pd
import pytest
from edges import awkward_docs
from grainmill.llm.common import DOCUMENT_COLUMNS, words_of
from grainmill.session import BATCH_KEY, bound_batches
from test_jaccard import brute

SF = "/root/testdata/sf0.001"


def test_every_stage_does_its_work(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = {r["doc_id"]: r for r in docs.collect()}
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    kept = corpus_pipeline.toxicity(spark, docs, SF)
    assert kept.columns == DOCUMENT_COLUMNS
    rows = {r["doc_id"]: r for r in kept.collect()}
    clean = [i for i in given if i not in toxic]
    assert all(rows[i] == given[i] for i in rows) and len([i for i in clean if i in rows]) > 0.95 * len(clean)

    single = corpus_pipeline.near_duplicates(spark, docs, SF)
    wanted = {i for i, (_, c) in brute([(i, r["text"]) for i, r in given.items()]).items() if i == c}
    assert {r["doc_id"] for r in single.collect()} == wanted and single.columns == DOCUMENT_COLUMNS

    items = [b" ".join([b"", *words_of(r["text"]), b""]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {i for i, r in given.items() if any(x in b" ".join([b"", *words_of(r["text"]), b""]) for x in items)}
    left = {r["doc_id"] for r in corpus_pipeline.decontaminate(spark, docs, SF).collect()}
    assert not left & leaked and len(left) >= len(given) - len(leaked) - 1

    masked = {r["doc_id"]: r for r in corpus_pipeline.secrets(spark, docs, SF).collect()}
    assert masked.keys() == given.keys()
    for i, r in masked.items():
        assert "password=" not in r["text"]
        assert r == given[i] or ("[SECRET]" in r["text"] and r["n_chars"] == len(r["text"]))


def test_whole_run_packs_what_is_left(spark):
    pieces = corpus_pipeline.run(spark, SF).collect()
    slots = defaultdict(int)
    for r in pieces:
        slots[r["sequence_id"]] += r["length"]
    assert max(slots.values()) <= 1024 and len({(r["doc_id"], r["piece"]) for r in pieces}) == len(pieces)
    assert all(isinstance(r["ids_crc32"], int) and r["ids_crc32"] >= 0 for r in pieces) and zlib.crc32(b"") == 0


@pytest.mark.parametrize("name", ["toxicity", "jaccard", "secrets", "packing"])
def test_workers_get_small_batches(spark, name):
    def lengths(batches):
        for batch in batches:
            yield pd.DataFrame({"n": [int(batch["text"].str.len().sum())]})

    long = spark.range(0, 3000, 1, 1).selectExpr("repeat('abcdefghij', 1000) AS text")
    own = spark.newSession()
    docs = own.read.parquet(f"{SF}/documents.parquet").limit(0)
    dict(corpus_pipeline.STAGES)[name](own, docs, SF)
    seen = own.createDataFrame(long.toPandas()).coalesce(1).mapInPandas(lengths, "n long").collect()
    assert sum(r["n"] for r in seen) == 30_000_000 and max(r["n"] for r in seen) < 5_000_000
    chosen = spark.newSession()
    chosen.conf.set(BATCH_KEY, "1m")
    bound_batches(chosen)
    assert chosen.conf.get(BATCH_KEY) == "1m"


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_a_stage_begins_with_a_collected_heap(spark, name):
    """What the stage before has left is collected, and its memory given back, before rows are read."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()

    def collections():
        return sum(b.getCollectionCount() for b in beans if b.getName() in ("G1 Old Generation", "MarkSweepCompact", "PS MarkSweep"))

    class Read(Exception):
        pass

    class Docs:
        sparkSession = spark

        def __getattr__(self, attribute):
            raise Read(collections())

    before = collections()
    with pytest.raises(Read) as found:
        dict(corpus_pipeline.STAGES)[name](spark, Docs(), SF)
    assert found.value.args[0] > before


@pytest.mark.parametrize("name", ["near_duplicates", "decontaminate", "secrets", "toxicity"])
def test_awkward_rows(spark, name):
    docs = awkward_docs(spark).withColumnsRenamed({"score": "masked", "row": "toxic", "class": "component_id"})
    kept = dict(corpus_pipeline.STAGES, near_duplicates=corpus_pipeline.near_duplicates).get(name)(spark, docs, SF)
    assert kept.columns == docs.columns
    rows = kept.collect()
    ids = [r["doc_id"] for r in rows]
    if name == "near_duplicates":
        assert sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 4, 5, 6]
    else:
        assert len(ids) == docs.count()
