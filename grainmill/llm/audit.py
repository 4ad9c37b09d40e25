"""Filter interaction audit: what each filter removes alone, in every order, and together.

Texts are measured by a finite-state transducer over UTF-8 bytes: a table gives
the class of a byte, two more the next state and the output for each state and
class. The next state depends on the class alone, so the state before a byte is
known from the byte before it and a whole block of texts runs in a few array
look-ups. The output marks the begins of words, capitals, code points and
symbols. The spans of the words go into an open-addressing hash table, all of a
block at once; a slot counts as the same word only if its bytes are equal, so a
collision of hashes never joins two words.

Texts are taken in blocks of about BLOCK bytes. A longer text is cut at blanks
into parts, whose distinct words are gathered in one set.

A missing text is empty: no word, no code point. A missing part is the empty
string. A row without an id comes after all ids: it is a copy if any row with an
id has its text. Rows that repeat an id are documents each, and no copies of
each other. Labels that repeat an id count if any of them is 1. Empty tables
give no rows. Of the documents only the id, the text and the part are read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm.common import join_unique
from grainmill.session import Scratch, settle

BLOCK = 1 << 20
MAX_FILTERS = 7

# Classes of bytes.
BLANK, CAPITAL, SYMBOL, OTHER, TAIL = range(5)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[32, *range(9, 14)]] = BLANK
CLASS[65:91] = CAPITAL
CLASS[list(b"#$%&*|")] = SYMBOL
CLASS[128:192] = TAIL  # bytes of a character after its first

# States, the next one by state and class, and the output by state and class.
SPACE, WORD = range(2)
NEXT = np.array([[SPACE, WORD, WORD, WORD, WORD]] * 2, np.uint8)
BEGIN, CAPITALS, SYMBOLS, POINT = 1, 2, 4, 8
OUTPUT = np.array(
    [
        [POINT, BEGIN | CAPITALS | POINT, BEGIN | SYMBOLS | POINT, BEGIN | POINT, BEGIN],
        [POINT, CAPITALS | POINT, SYMBOLS | POINT, POINT, 0],
    ],
    np.uint8,
)

LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
MIXERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]

MEASURES = ["n_words", "n_distinct", "n_capitals", "n_symbols", "n_points"]


def _owners(data: np.ndarray, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Insert the spans into a hash table; the spans that came first of equal ones of a text.

    A word of up to 16 bytes is told by its length, its first and its last eight
    bytes; of longer ones all bytes are compared.
    """
    n = len(starts)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded.view(np.uint8)[:8].view(np.uint64), (len(data) + 1,), (1,))
    size = ends - starts
    head = eight[starts] & LOW_BYTES[np.minimum(size, 8)]
    tail = np.where(size > 8, eight[np.maximum(ends - 8, 0)], np.uint64(0))
    mixed = head * MIXERS[0]
    mixed ^= (mixed >> np.uint64(29)) + tail * MIXERS[1]
    mixed ^= (text.astype(np.uint64) * MIXERS[2]) + size.astype(np.uint64)
    mixed *= MIXERS[3]
    bits = max(4, (2 * n - 1).bit_length())
    slot = (mixed >> np.uint64(64 - bits)).astype(np.int64)
    table = np.full(1 << bits, -1, np.int64)
    first = np.zeros(n, bool)
    left = np.arange(n)
    while len(left):
        at = slot[left]
        free = table[at] < 0
        table[at[free]] = left[free]
        holder = table[at]
        own = holder == left
        first[left[own]] = True
        same = (
            (text[holder] == text[left]) & (size[holder] == size[left])
            & (head[holder] == head[left]) & (tail[holder] == tail[left])
        )
        for k in np.flatnonzero(same & ~own & (size[left] > 16)):
            a, b = starts[left[k]], starts[holder[k]]
            same[k] = np.array_equal(data[a : a + size[left[k]]], data[b : b + size[left[k]]])
        left = left[~same]
        slot[left] = (slot[left] + 1) & ((1 << bits) - 1)
    return np.flatnonzero(first)


def _measured(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts (texts x MEASURES) of the texts between edges; text, start and end of their distinct words."""
    texts = len(edges) - 1
    counts = np.zeros((texts, len(MEASURES)), np.int64)
    none = np.zeros(0, np.int64)
    if not len(data):
        return counts, none, none, none
    kind = CLASS[data]
    state = np.zeros(len(data), np.uint8)
    state[1:] = NEXT[SPACE, kind[:-1]]
    filled = np.flatnonzero(np.diff(edges))
    begins = edges[filled]
    state[begins] = SPACE  # every text starts anew
    output = OUTPUT[state, kind]

    def total(mark: int) -> np.ndarray:
        return np.add.reduceat((output & mark) != 0, begins, dtype=np.int64)

    for column, mark in ((0, BEGIN), (2, CAPITALS), (3, SYMBOLS), (4, POINT)):
        counts[filled, column] = total(mark)
    starts = np.flatnonzero(output & BEGIN)
    inside = kind != BLANK
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    stops = edges[filled + 1] - 1
    last[stops] = inside[stops]
    ends = np.flatnonzero(last) + 1
    text = np.repeat(np.arange(texts), counts[:, 0])
    kept = _owners(data, text, starts, ends)
    counts[:, 1] = np.bincount(text[kept], minlength=texts)
    return counts, text[kept], starts[kept], ends[kept]


def _long_text(data: np.ndarray, block: int) -> np.ndarray:
    """Counts of one text, part by part; parts end at blanks."""
    counts, words, at = np.zeros(len(MEASURES), np.int64), set(), 0
    while at < len(data):
        stop = min(at + block, len(data))
        while stop < len(data):
            near = np.flatnonzero(CLASS[data[stop : stop + block]] == BLANK)
            if len(near):
                stop += int(near[0])
                break
            stop = min(stop + block, len(data))
        part = data[at:stop]
        found, _, starts, ends = _measured(part, np.array([0, len(part)]))
        counts += found[0]
        whole = part.tobytes()
        words.update(whole[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
        at = stop
    counts[1] = len(words)
    return counts


def measure(data: np.ndarray, edges: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """MEASURES of texts given as UTF-8 bytes and the edges between them."""
    parts, at, texts = [], 0, len(edges) - 1
    while at < texts:
        stop = max(at + 1, int(np.searchsorted(edges, edges[at] + block, "right")) - 1)
        stop = min(stop, texts)
        piece = data[edges[at] : edges[stop]]
        if stop == at + 1 and len(piece) > block:
            parts.append(_long_text(piece, block)[None])
        else:
            parts.append(_measured(piece, edges[at : stop + 1] - edges[at])[0])
        at = stop
    return np.concatenate(parts) if parts else np.zeros((0, len(MEASURES)), np.int64)


def utf8_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and edges of an Arrow column of strings without missing ones."""
    wide = pa.types.is_large_string(column.type)
    edges = np.frombuffer(column.buffers()[1] or b"", np.int64 if wide else np.int32)
    edges = edges[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(edges):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    return data, edges - edges[0]


def text_measures(rows: DataFrame, text: str = "text") -> DataFrame:
    """The rows with MEASURES in the place of the text."""
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in (text, *MEASURES)]
    given = rows.select(F.struct(*kept).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(*utf8_of(batch.column(1)))
            arrays = [batch.column(0), *[pa.array(found[:, k]) for k in range(len(MEASURES))]]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", *MEASURES])

    schema = given.select("row", *[F.lit(0).cast("long").alias(m) for m in MEASURES]).schema
    return given.mapInArrow(each, schema).select("row.*", *MEASURES)


def with_first(rows: DataFrame, digest: str, key: str = "doc_id") -> DataFrame:
    """The rows with ``first``: the smallest key of their digest if several rows have it, else NULL."""
    repeated = rows.groupBy(digest).agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1")
    return join_unique(rows, repeated, digest, "n", key, "left").drop("n")


def interactions(failures: DataFrame, letters: str) -> DataFrame:
    """What each filter does at each step of each order.

    ``failures`` has part, mask (bit k set: fails the filter of letter k), good,
    toxic (0 or 1) and n, the number of such documents. Each part is summed over
    the masks first, and then over the sets of filters that can stand before a
    filter, of which there are fewer than orders.
    """
    k = len(letters)
    if not 1 <= k <= MAX_FILTERS or len(set(letters)) < k:
        raise ValueError(f"1 to {MAX_FILTERS} filters with letters of their own are possible")
    spark = failures.sparkSession
    summed = failures.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("n_good"), F.sum(F.col("n") * F.col("toxic")).alias("n_toxic")
    )
    places = [(before, f) for f in range(k) for before in range(1 << k) if not before >> f & 1]
    array = F.array(*[F.struct(F.lit(b).alias("before"), F.lit(f).alias("f")) for b, f in places])
    rows = summed.withColumn("place", F.explode(array)).select("part", "mask", "n", "n_good", "n_toxic", "place.*")
    bit = F.pow(F.lit(2), F.col("f")).cast("int")
    fails = F.col("mask").bitwiseAND(bit) != 0
    earlier = F.col("mask").bitwiseAND(F.col("before")) != 0

    def total(condition: Column, count: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(count)).otherwise(0))

    found = rows.groupBy("part", "before", "f").agg(
        total(~fails & ~earlier).alias("kept"),
        total(fails & ~earlier).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(F.col("mask") == bit).alias("unique_fails"),
        total(fails & ~earlier, "n_good").alias("good_lost"),
        total(fails & ~earlier, "n_toxic").alias("toxic_lost"),
    )
    # Orders in which exactly these filters stand before this one.
    ways = [math.factorial(s) * math.factorial(k - 1 - s) for s in range(k)]
    number = F.get(F.array(*[F.lit(w) for w in ways]), F.bit_count("before"))
    found = found.withColumn(
        "shapley", F.sum(F.col("removed") * number).over(Window.partitionBy("part", "f"))
    )
    steps = []
    for order in itertools.permutations(range(k)):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append(("".join(letters[i] for i in order), step, before, f))
            before |= 1 << f
    steps = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, before int, f int"))
    return found.join(steps, ["before", "f"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def audit_filters(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column], part: str = "lang") -> DataFrame:
    """``interactions`` of filters over documents.

    A filter fails where its condition holds. Conditions may use MEASURES and
    ``copy``: whether a smaller id has the same text.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), "text",
    )
    good = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id").agg(
        F.max((F.col("quality").eqNullSafe(1)).cast("int")).alias("good"),
        F.max((F.col("toxic").eqNullSafe(1)).cast("int")).alias("toxic"),
    )
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.settle(text_measures(rows))
        rows = with_first(rows, "digest").withColumn(
            "copy", F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
        )
        mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions.values())), F.lit(0))
        # Repeated ids are one row before they meet the labels.
        rows = rows.groupBy("doc_id", "part", mask.alias("mask")).agg(F.count("*").alias("n"))
        rows = rows.join(good, "doc_id", "left").fillna(0, ["good", "toxic"])
        failures = rows.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
        return interactions(settle(failures), "".join(conditions))
