import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from edges import awkward_docs, no_docs
from grainmill.llm import alignment
from grainmill.llm.alignment import align, aligned_groups, gallop, intersect
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.decoders import ByteLevel

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60))), max_size=5), st.sampled_from([(1,), (4, 1), (8, 4, 2, 1)]))
def test_intersection_equals_sets(texts, strides):
    short, long, s_edges, l_edges, wanted = [], [], [0], [0], []
    for k, (x, y) in enumerate(texts):
        short += [100 * k + v for v in sorted(x)]
        long += [100 * k + v for v in sorted(y)]
        wanted += [100 * k + v for v in sorted(x & y)]
        s_edges.append(len(short))
        l_edges.append(len(long))
    arrays = [np.array(v, np.int64) for v in (short, long, s_edges, l_edges)]
    i, j = intersect(*arrays, strides)
    assert [short[k] for k in i] == wanted == [long[k] for k in j]


@given(st.lists(st.integers(0, 100), max_size=40), st.lists(st.integers(-5, 110), max_size=10))
def test_gallop_counts_smaller_values(ordered, keys):
    ordered, keys = np.array(sorted(ordered), np.int64), np.array(keys, np.int64)
    found = gallop(keys, ordered, np.zeros(len(keys), np.int64))
    assert found.tolist() == np.searchsorted(ordered, keys).tolist()


def brute(texts):
    """Rows in the order of the texts, token by token, with the other libraries' encoders."""
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    piece = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    assert ByteLevel  # the byte-level alphabet above
    docs, holders = [], Counter()
    for text in texts:
        groups = []
        if text:
            whole = (" " + text).encode()
            ids = library.encode(" " + text, add_special_tokens=False).ids
            a = [(k, bytes(byte_of[c] for c in library.id_to_token(k))) for k in ids]
            b = [
                (k, bytes([int(piece.id_to_piece(k)[3:5], 16)]) if piece.is_byte(k) else piece.id_to_piece(k).replace("▁", " ").encode())
                for k in piece.encode(text)
            ]
            if b"".join(t for _, t in a) == whole == b"".join(t for _, t in b):
                ends = []
                for side in (a, b):
                    at, own = 0, []
                    for _, t in side:
                        at += len(t)
                        own.append(at)
                    ends.append(own)
                common = sorted(set(ends[0]) & set(ends[1]))
                places = [0, 0]
                for c in common:
                    parts = []
                    for s, (side, own) in enumerate(zip((a, b), ends, strict=True)):
                        first = places[s]
                        places[s] = own.index(c, first) + 1
                        parts.append([k for k, _ in side[first : places[s]]])
                    groups.append(tuple(parts))
        docs.append(groups)
        holders.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    best = defaultdict(int)
    for (x, _), n in holders.items():
        best[x] = max(best[x], n)
    rows = []
    for groups in docs:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append(
            (
                sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
                sum(holders[p] == best[p[0]] for p in links), sum(holders[p] for p in links),
                hashlib.sha256(told.encode()).hexdigest() if groups else "",
            )
        )
    return rows


def found_of(docs, **options):
    rows = align(docs, A, B, **options).collect()
    return sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in rows)


def wanted_of(docs):
    given = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    return sorted((str(i), *row) for (i, _), row in zip(given, brute([t for _, t in given]), strict=True))


TEXTS = [
    "Plain words, and more of them.", "plain words again", "  blanks \n\n and\ttabs ", "漢字 и слова 🙂 é é", "▁lower one eighth", "<s>x</s> <|endoftext|>",
    "aGVsbG8gd29ybGQgdGhpcyBpcyBsb25nIGJhc2U2NA==" * 3, "=" * 200, "x", "12345 678,9", "a\x00b", "ﬁ ＡＢ", "words " * 30,
]


def test_alignment_equals_brute_force(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(3, TEXTS[0]), (3, TEXTS[0]), (None, TEXTS[1]), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    wanted = wanted_of(docs)
    for head in (1 << 20, 8, 0):  # all pairs sent, some, none
        assert found_of(docs, head=head) == wanted
    monkeypatch.setattr(alignment, "BLOCK", 50)
    monkeypatch.setattr(alignment, "LARGE_GROUP", 2)
    monkeypatch.setattr(alignment, "PAIR_PIECE", 7)
    both = alignment.sides(A, B)
    found = alignment.group(both.encode(TEXTS), both)
    text, codes, times = found.distinct_pairs()
    assert times.sum() == sum(r[3] for r in brute(TEXTS))
    assert len(set(zip(text.tolist(), codes.tolist(), strict=True))) == len(codes)
    monkeypatch.setattr(alignment, "STRIDES", (2, 1))
    assert found.digests(both.names) == [r[6] for r in brute(TEXTS)]


def test_awkward_and_empty_tables(spark):
    docs = awkward_docs(spark)
    assert found_of(docs) == wanted_of(docs)
    assert align(no_docs(spark), A, B).collect() == []


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    assert found_of(docs, head=100) == wanted_of(docs)


def test_groups_give_bytes_and_ids(spark):
    rows = aligned_groups(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), A, B).collect()
    both = alignment.sides(A, B)
    for r in rows:
        whole = (" " + TEXTS[r["doc_id"]]).encode()
        at = 0
        for g in r["groups"]:
            assert g["start"] == at
            at = g["stop"]
            assert both.a.decode_bytes(g["a"]) == whole[g["start"] : at] == b"".join(both.b_bytes[k] for k in g["b"])
        assert at == len(whole) or not r["groups"]
