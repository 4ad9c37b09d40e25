"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

A text, with a space before it, is encoded by a byte-level vocabulary (A) and a
piece vocabulary (B). Both give the byte offsets where their tokens end. The
offsets common to both are found by a galloping intersection: the shorter list
drives an exponential and then a binary search into the longer one. All texts of
a block are searched at once; a key starts where the search of an earlier key of
its text ended (every 4,096th key first, then those between, and so on), so most
keys move a few places only. The common offsets cut both token lists into
groups; the differences of their ranks give the token ranges of a group.

Each pair of an A and a B token of one group is a link. The count of a pair of
ids is the number of documents that hold it linked: tasks count their own
documents before anything is shuffled, and a document is told how frequent its
pairs are in two ways. Pairs from a count on that at most HEAD pairs reach are
sent to all tasks (12 bytes each); a document asks for the others by a join,
and of these no key is frequent.

Texts that are missing, empty or not given back by both vocabularies have no
tokens: counts of 0 and an empty digest. Each row is a document, also rows that
repeat an id or have none. An empty table gives no rows. Only ``doc_id`` and
``text`` are read. Memory of a task follows its longest text.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.packing import encoder
from grainmill.session import Scratch, settle

BLOCK = 1 << 20
STRIDES = (4096, 512, 64, 8, 1)
LARGE_GROUP = 4096
PAIR_PIECE = 1 << 20
HEAD = 1 << 20
MEASURES = ["n_a", "n_b", "n_groups", "n_links"]


@dataclass
class Sides:
    """Both vocabularies: encoders, and bytes and lengths of each id."""

    a: tiktoken.Encoding
    b: sentencepiece.SentencePieceProcessor
    b_bytes: list[bytes]
    a_lengths: np.ndarray
    b_lengths: np.ndarray
    names: np.ndarray  # of ids, before a comma, and at an end of a list

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and B; none of a text that is not given back."""
        none = np.zeros(0, np.uint16)
        given = [k for k, text in enumerate(texts) if text]
        found = [(none, none)] * len(texts)
        pieces = self.b.encode([texts[k] for k in given], num_threads=1) if given else []
        for k, b in zip(given, pieces, strict=True):
            text = " " + texts[k]
            whole = text.encode()
            if b"".join(map(self.b_bytes.__getitem__, b)) != whole:
                continue
            a = self.a.encode_to_numpy(text, disallowed_special=())
            if self.a_lengths[a].sum() == len(whole) and self.a.decode_bytes(a.tolist()) == whole:
                found[k] = a.astype(np.uint16), np.array(b, np.uint16)
        return found


@functools.cache
def sides(a_path: str, b_path: str) -> Sides:
    a = encoder(a_path)
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    if a.max_token_value >= 1 << 16 or b.vocab_size() > 1 << 16:
        raise ValueError("ids beyond 16 bits are not supported")
    pieces = []
    for k in range(b.vocab_size()):
        piece = b.id_to_piece(k)
        pieces.append(bytes([int(piece[3:5], 16)]) if b.is_byte(k) else piece.replace("▁", " ").encode())
    lengths = np.zeros(a.max_token_value + 1, np.int64)
    for token in a.token_byte_values():
        lengths[a.encode_single_token(token)] = len(token)
    for special in a.special_tokens_set:
        lengths[a.encode_single_token(special)] = len(special.encode())
    size = max(len(lengths), len(pieces))
    names = np.array([f"{k}{mark}".encode() for mark in (",", "|", ";", "") for k in range(size)], object)
    return Sides(a, b, pieces, lengths, np.array([len(p) for p in pieces], np.int64), names)


def gallop(keys: np.ndarray, ordered: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each key the number of smaller values; it is known to be ``low`` at least."""
    n = len(ordered)
    low, width = low.copy(), np.ones(len(keys), np.int64)
    left = np.flatnonzero(low < n)
    while len(left):  # exponential
        last = np.minimum(low[left] + width[left], n) - 1
        left = left[ordered[last] < keys[left]]
        low[left] = np.minimum(low[left] + width[left], n)
        width[left] *= 2
        left = left[low[left] < n]
    high = np.minimum(low + width - 1, n)
    left = np.flatnonzero(low < high)
    while len(left):  # binary
        middle = (low[left] + high[left]) // 2
        less = ordered[middle] < keys[left]
        low[left[less]] = middle[less] + 1
        high[left[~less]] = middle[~less]
        left = left[low[left] < high[left]]
    return low


def intersect(
    short: np.ndarray, long: np.ndarray, short_edges: np.ndarray, long_edges: np.ndarray, strides: tuple[int, ...] = STRIDES
) -> tuple[np.ndarray, np.ndarray]:
    """Places in both lists of their common values.

    Both rise over all texts; the edges tell where a text begins in them.
    """
    text = np.repeat(np.arange(len(short_edges) - 1), np.diff(short_edges))
    within = np.arange(len(short)) - short_edges[text]
    place = np.zeros(len(short), np.int64)
    before = 0
    for stride in strides:
        turn = within % stride == 0
        if before:
            turn &= within % before != 0
        keys = np.flatnonzero(turn)
        if before:
            start = place[short_edges[text[keys]] + within[keys] // before * before]
        else:
            start = long_edges[text[keys]]
        place[keys] = gallop(short[keys], long, start)
        before = stride
    common = np.flatnonzero(long[np.minimum(place, len(long) - 1)] == short) if len(long) else np.zeros(0, np.int64)
    return common, place[common]


@dataclass
class Groups:
    """The groups of a block of texts: token ids and, for each group, where its tokens end."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray  # bytes
    a_stops: np.ndarray  # tokens
    b_stops: np.ndarray
    text: np.ndarray
    texts: int

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        return np.diff(self.a_stops, prepend=0), np.diff(self.b_stops, prepend=0)

    def measures(self) -> np.ndarray:
        """texts x MEASURES."""
        left, right = self.sizes()
        count = lambda w: np.bincount(self.text, w, self.texts).astype(np.int64)
        return np.stack([count(left), count(right), count(np.ones(len(left))), count(left * right)], axis=1)

    def digests(self, names: np.ndarray) -> list[str]:
        """SHA-256 of each text's groups, '' without tokens."""
        size = len(names) // 4
        left, right = self.sizes()
        a_mark, b_mark = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        a_mark[self.a_stops - 1] = 1
        b_mark[self.b_stops - 1] = 2
        last = np.flatnonzero(np.diff(self.text, append=-1))
        b_mark[self.b_stops[last] - 1] = 3
        out = np.zeros(len(self.a) + len(self.b), np.int64)
        shift = np.concatenate([[0], self.b_stops[:-1]]) if len(left) else np.zeros(0, np.int64)
        out[np.arange(len(self.a)) + np.repeat(shift, left)] = a_mark * size + self.a
        out[np.arange(len(self.b)) + np.repeat(self.a_stops, right)] = b_mark * size + self.b
        parts = names[out]
        found, at = [""] * self.texts, 0
        for k in last:
            stop = int(self.a_stops[k] + self.b_stops[k])
            found[self.text[k]] = hashlib.sha256(b"".join(parts[at:stop].tolist())).hexdigest()
            at = stop
        return found

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """text, code of the pair of ids, and number of links, of bounded pieces of groups.

        A piece may repeat a pair. Of a large group, ids count first, so that
        its links are not listed one by one.
        """
        left, right = self.sizes()
        links = left * right
        small = np.flatnonzero(links <= LARGE_GROUP)
        edges = np.cumsum(links[small])
        at = 0
        while at < len(small):
            done = edges[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(edges, done + PAIR_PIECE, "right")))
            rows = small[at:stop]
            which = np.repeat(np.arange(len(rows)), links[rows])
            nth = np.arange(len(which)) - np.repeat(edges[at:stop] - links[rows] - done, links[rows])
            group = rows[which]
            a = self.a[self.a_stops[group] - left[group] + nth // right[group]].astype(np.int64)
            b = self.b[self.b_stops[group] - right[group] + nth % right[group]].astype(np.int64)
            yield self.text[group], a << 16 | b, np.ones(len(a), np.int64)
            at = stop
        for k in np.flatnonzero(links > LARGE_GROUP):
            a, a_times = np.unique(self.a[self.a_stops[k] - left[k] : self.a_stops[k]], return_counts=True)
            b, b_times = np.unique(self.b[self.b_stops[k] - right[k] : self.b_stops[k]], return_counts=True)
            step = max(1, PAIR_PIECE // len(b))
            for i in range(0, len(a), step):
                codes = (a[i : i + step, None].astype(np.int64) << 16 | b[None, :]).ravel()
                times = (a_times[i : i + step, None] * b_times[None, :]).ravel()
                yield np.full(len(codes), self.text[k]), codes, times

    def distinct_pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """text, code and number of links of each pair of ids of each text, in this order."""
        keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for text, codes, count in self.pairs():
            more, inverse = np.unique(text << 32 | codes, return_inverse=True)
            sums = np.bincount(inverse, count, len(more)).astype(np.int64)
            if len(keys):
                more, inverse = np.unique(np.concatenate([keys, more]), return_inverse=True)
                sums = np.bincount(inverse, np.concatenate([times, sums]), len(more)).astype(np.int64)
            keys, times = more, sums
        return keys >> 32, keys & (1 << 32) - 1, times


def group(encoded: list[tuple[np.ndarray, np.ndarray]], both: Sides) -> Groups:
    """Align the ids of several texts."""
    none = np.zeros(0, np.uint16)
    a, b = (np.concatenate([none, *[ids[k] for ids in encoded]]) for k in (0, 1))
    a_edges, b_edges = (np.cumsum([0, *[len(ids[k]) for ids in encoded]]) for k in (0, 1))
    # The tokens of a text cover equally many bytes, so both lists go on from text to text.
    a_ends, b_ends = np.cumsum(both.a_lengths[a]), np.cumsum(both.b_lengths[b])
    swapped = np.diff(a_edges) > np.diff(b_edges)
    found = []
    for driven_by_b in (False, True):
        chosen = np.flatnonzero(swapped == driven_by_b)
        places = [np.concatenate([[0], np.cumsum(np.diff(e)[chosen])]) for e in (a_edges, b_edges)]
        of = [
            np.repeat(e[chosen] - p[:-1], np.diff(p)) + np.arange(p[-1])
            for e, p in zip((a_edges, b_edges), places, strict=True)
        ]
        ends = [a_ends[of[0]], b_ends[of[1]]]
        order = (1, 0) if driven_by_b else (0, 1)
        common = intersect(ends[order[0]], ends[order[1]], places[order[0]], places[order[1]])
        found.append([of[0][common[order.index(0)]], of[1][common[order.index(1)]]])
    a_places, b_places = (np.sort(np.concatenate([f[k] for f in found])) for k in (0, 1))
    text = np.searchsorted(a_edges, a_places, "right") - 1
    return Groups(a, b, a_ends, a_places + 1, b_places + 1, text, len(encoded))


def _blocks(lengths: list[int]) -> Iterator[slice]:
    """Slices of about BLOCK characters or ids."""
    at, size = 0, 0
    for k, length in enumerate(lengths):
        size += length
        if size >= BLOCK:
            yield slice(at, k + 1)
            at, size = k + 1, 0
    if at < len(lengths):
        yield slice(at, len(lengths))


def aligned_groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id and groups: start and stop of their bytes (the space counts), ids of A and of B."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(a_path, b_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in _blocks([len(t or "") for t in texts]):
                found = group(both.encode(texts[part]), both)
                rows: list = [[] for _ in range(found.texts)]
                left, right = found.sizes()
                begin = np.concatenate([[0], np.cumsum(both.a_lengths[found.a])])
                first = np.searchsorted(found.text, np.arange(found.texts))
                for k, (text, n, m) in enumerate(zip(found.text, left, right, strict=True)):
                    i, j = int(found.a_stops[k]), int(found.b_stops[k])
                    opened = found.a_stops[first[text]] - left[first[text]]
                    rows[text].append(
                        {"start": begin[i - n] - begin[opened], "stop": begin[i] - begin[opened],
                         "a": found.a[i - n : i].tolist(), "b": found.b[j - m : j].tolist()}
                    )
                kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
                ids = batch.column(0).slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([ids, pa.array(rows, kind)], names=["doc_id", "groups"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, groups array<struct<start:long,stop:long,a:array<int>,b:array<int>>>"
    return docs.select("doc_id", "text").mapInArrow(each, schema)


def _encoded(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of documents (ids and measures), and rows of pairs with the number of their documents."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(a_path, b_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in _blocks([len(t or "") for t in texts]):
                encoded = both.encode(texts[part])
                found = group(encoded, both)
                measures = found.measures()
                codes, times = np.unique(found.distinct_pairs()[1], return_counts=True)
                n = found.texts
                last = [pa.array([None] * n + [k.tolist()], pa.list_(pa.int64())) for k in (codes, times)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([batch.column(0).slice(part.start, n), pa.nulls(1, batch.column(0).type)]),
                        pa.array([*[ids[0].tobytes() for ids in encoded], None], pa.binary()),
                        pa.array([*[ids[1].tobytes() for ids in encoded], None], pa.binary()),
                        *[pa.array([*measures[:, k].tolist(), None], pa.int64()) for k in range(len(MEASURES))],
                        pa.array([*found.digests(both.names), None], pa.string()),
                        *last,
                    ],
                    names=["doc_id", "a", "b", *MEASURES, "groups_sha256", "codes", "times"],
                )

    schema = f"doc_id {kind}, a binary, b binary, " + ", ".join(f"{m} long" for m in MEASURES)
    schema += ", groups_sha256 string, codes array<long>, times array<long>"
    return docs.select("doc_id", "text").mapInArrow(each, schema)


def _least_head(counts: DataFrame, head: int) -> int:
    """The smallest power of two that at most ``head`` pairs have as their count, or more."""
    level = (F.length(F.bin("n")) - 1).alias("level")
    sizes = {r["level"]: r["count"] for r in counts.groupBy(level).count().collect()}
    total, least = 0, max(sizes, default=0) + 1
    while least > 0 and total + sizes.get(least - 1, 0) <= head:
        least -= 1
        total += sizes.get(least, 0)
    return 1 << least


def align(docs: DataFrame, a_path: str, b_path: str, head: int = HEAD) -> DataFrame:
    """Per document: MEASURES, n_best, count_sum and groups_sha256.

    ``count_sum`` adds the counts of all links; ``n_best`` counts the links whose
    pair has the highest count of all pairs with its A id.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        # Ids for rows are given before the rows are written, so they stay.
        seen = _encoded(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id())
        seen = scratch.settle(seen)
        counts = seen.where("codes IS NOT NULL").select(F.inline(F.arrays_zip("codes", "times")))
        counts = scratch.settle(counts.groupBy(F.col("codes").alias("code")).agg(F.sum("times").alias("n")))
        # One row for each id of A at most.
        best = counts.groupBy(F.shiftright("code", 16).cast("int").alias("a")).agg(F.max("n").alias("best"))
        best = scratch.settle(best)
        least = _least_head(counts, head)
        frequent = counts.where(F.col("n") >= least).orderBy("code").toArrow()
        tops = best.toArrow()
        highest = np.zeros(1 << 16, np.int64)
        highest[tops["a"].to_numpy()] = tops["best"].to_numpy()
        sent = spark.sparkContext.broadcast(
            (frequent["code"].to_numpy().astype(np.uint32), frequent["n"].to_numpy().astype(np.int64), highest)
        )

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            both = sides(a_path, b_path)
            known, numbers, highest = sent.value
            for batch in batches:
                a, b = (
                    [np.frombuffer(ids, np.uint16) for ids in batch.column(k).to_pylist()] for k in (1, 2)
                )
                for part in _blocks([len(ids) for ids in a]):
                    found = group(list(zip(a[part], b[part], strict=True)), both)
                    text, codes, times = found.distinct_pairs()
                    at = np.minimum(np.searchsorted(known, codes), max(0, len(known) - 1))
                    hit = known[at] == codes if len(known) else np.zeros(len(codes), bool)
                    n = np.where(hit, numbers[at], 0) if len(known) else np.zeros(len(codes), np.int64)
                    top = hit & (n == highest[codes >> 16])
                    sums = [np.zeros(found.texts, np.int64) for _ in range(2)]
                    np.add.at(sums[0], text[top], times[top])
                    np.add.at(sums[1], text, times * n)
                    rest = ~hit
                    places = np.searchsorted(text[rest], np.arange(found.texts + 1)).astype(np.int32)
                    lists = [
                        pa.ListArray.from_arrays(pa.array(places), pa.array(values[rest].astype(np.int64)))
                        for values in (codes, times)
                    ]
                    doc = batch.column(0).slice(part.start, found.texts)
                    yield pa.RecordBatch.from_arrays(
                        [doc, *map(pa.array, sums), *lists], names=["doc", "n_best", "count_sum", "code", "times"]
                    )

        doc = F.struct("row", "doc_id", *MEASURES, "groups_sha256").alias("doc")
        rows = seen.where("codes IS NULL").select(doc, "a", "b")
        lists = F.array().cast("array<long>")
        numbers = [F.lit(0).cast("long").alias(c) for c in ("n_best", "count_sum")]
        schema = rows.select("doc", *numbers, lists.alias("code"), lists.alias("times")).schema
        # What only a join can tell comes with the row.
        scored = scratch.settle(rows.mapInArrow(each, schema).select("doc.*", "n_best", "count_sum", "code", "times"))
        asked = scored.where(F.size("code") > 0).select("row", F.inline(F.arrays_zip("code", "times")))
        rare = counts.where(F.col("n") < least).withColumn("a", F.shiftright("code", 16).cast("int"))
        rare = rare.join(F.broadcast(best), "a").select("code", "n", (F.col("n") == F.col("best")).alias("top"))
        told = asked.join(rare, "code").groupBy("row").agg(
            F.sum(F.col("times") * F.col("n")).alias("more_sum"),
            F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("more_best"),
        )
        result = scored.drop("code", "times").join(told, "row", "left")
        return settle(
            result.select(
                "doc_id", *MEASURES,
                (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
                (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
                "groups_sha256",
            )
        )
