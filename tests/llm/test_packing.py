import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from edges import awkward_docs, no_docs
from grainmill.llm import packing
from grainmill.llm.packing import best_fit_plan, pack, pieces, token_ids
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=12))
def test_plan_is_best_fit_decreasing(counts):
    """The plan over counts has as many bins as best-fit over single pieces, without overlap."""
    capacity, used = 32, defaultdict(list)
    seen = defaultdict(int)
    for length, low, high, each, first, at in best_fit_plan(counts, capacity):
        assert low == seen[length]
        seen[length] = high
        for rank in range(low, high):
            nth = rank - low
            used[first + nth // each].append((at + nth % each * length, length))
    assert dict(seen) == counts
    for slots in used.values():
        place = 0
        for at, length in sorted(slots):
            assert at == place
            place += length
        assert place <= capacity
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [k for k, r in enumerate(rooms) if r >= length]
            if fits:
                rooms[min(fits, key=lambda k: rooms[k])] -= length
            else:
                rooms.append(capacity - length)
    assert len(used) == len(rooms)


def test_ids_equal_those_of_the_tokenizers_library():
    library = Tokenizer.from_file(PATH)
    for text in ["", " a  b\n\n c", "It's 12345 o'clock!!", "Éèç ñ 漢字 🙂\t\r\n ", "x" * 300, "<|endoftext|> a"]:
        assert token_ids(text, PATH).tolist() == library.encode(text, add_special_tokens=False).ids


def _check(rows, capacity):
    slots = defaultdict(list)
    for r in rows:
        slots[r["sequence_id"]].append((r["offset"], r["length"]))
    for taken in slots.values():
        place = 0
        for at, length in sorted(taken):
            assert at == place
            place += length
        assert place <= capacity
    return len(slots)


def test_pieces_fill_sequences_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(packing, "PER_CELL", 3)
    draw = random.Random(1)
    texts = [" ".join("word" for _ in range(draw.choice([1, 1, 1, 7, 30, 200]))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = pack(docs, PATH, capacity=64, keep_ids=True).collect()
    total = sum(r["length"] for r in rows)
    assert _check(rows, 64) <= total / 64 * 1.02 + 1
    whole = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == len(whole[r["doc_id"]]) and r["length"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        whole[r["doc_id"]] += r["ids"]
    for k, text in enumerate(texts):
        assert whole[k] == [*token_ids(text, PATH).tolist(), 2]
    assert all(r["length"] == 64 for r in rows if r["piece"] > 0)


def test_awkward_rows(spark):
    rows = pack(awkward_docs(spark), PATH).collect()
    _check(rows, 1024)
    empty = [r for r in rows if r["doc_id"] in (1, 2)]
    assert [r["length"] for r in empty] == [1, 1]
    assert sum(r["doc_id"] == 0 for r in rows) == 3 and sum(r["doc_id"] is None for r in rows) == 1
    assert pack(no_docs(spark), PATH).count() == 0
    assert pieces(no_docs(spark), PATH, keep_ids=True).count() == 0
