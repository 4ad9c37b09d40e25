"""N-gram Jaccard join by the size-aware heavy-light method.

A document's set holds its distinct shingles as 64-bit hashes. Equal sets form
a class; the join runs over classes. All tokens have one global order, rare
ones first, from counts of all documents in a fixed number of hashed counters.
If sets x and y overlap by c(x) = ceil(0.8 |x|) or more, as linked ones do, then
the first k common tokens lie among the first |x| - c(x) + k of x.

* Light sets (small ones) enumerate the subsets of two (k = 2) of that prefix.
* Heavy sets put their prefix on inverted lists and scan these. They take k as
  half of the tokens they may lack: a set with fewer than that many tokens on
  lists of two or more sets links with nothing, however frequent a passage it
  shares, and leaves all lists. Of the others the prefix for k = 1 stays.
* A light set within reach of a heavy size also visits the inverted lists.

The boundary is the size up to which the subsets cost less than the lists: a
list costs a set its posting and the postings it meets there, known from the
counters.

Three steps keep a large group of near copies from making all its pairs. In a few
rounds, each class is compared with a neighbour or two of some of its lists, the
same ones in sets that share them; links that hold contract the classes into
components. Lists that still hold two or more components go through one more
round, in which a class outside the largest component of a list is compared with
the nearest sketch beside it. What is left is paired on each list: members outside
its largest component with all members of other components, long lists in salted
parts; these are all the pairs that can still change the result. An odd sketch
(parities of hashed tokens, whose difference is at most that of the sets) rules
pairs out early; every other pair is verified on whole sets.

Missing and empty texts, and those without words, have no shingle and link with
nothing. Fewer words than a shingle make one shingle of all. Repeated rows are
documents of one class. A missing id takes part, but never names a component
that has an id. Only ``doc_id`` and ``text`` are read. Sets and shingles are
identified by 64-bit hashes, of which two of a billion sets agree by chance
with a probability of 3 %.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from grainmill.llm.common import join_unique
from grainmill.llm.graph import components, gathered
from grainmill.session import Scratch, release, settle

SHINGLE = 5
PERCENT = 80
COUNTERS = 1 << 20
SLICES = 64
# What meeting a posting on a list costs, next to shipping one.
VISIT = 0.05
ROUNDS = 3
# Postings of a class that take part in a round, about.
SAMPLED = 8
ROWS_AT_ONCE = 200_000
SKETCH = 8
MAX_SALTED = 100_000
BROADCAST_ROWS = 2_000_000
BROADCAST_PAIRS = 500_000
SKETCH_COLUMNS = [f"s{k}" for k in range(SKETCH)]

# Odd multipliers of the positions in a shingle, and of the final mixing.
FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5]
MIX = np.uint64(0xFF51AFD7ED558CCD)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(33))) * MIX
    return values ^ (values >> np.uint64(29))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of lower-cased (A-Z) words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(size, len(words))
    count = len(words) - width + 1
    total = np.full(count, width, np.uint64)
    for k in range(width):
        factor = np.uint64(FACTORS[k % 5] + 2 * (k // 5))
        total += hashes[k : k + count] * factor
        total ^= total >> np.uint64(31)
    return np.unique(_mixed(total))


def _fingerprint(tokens: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(tokens.tobytes()) - (1 << 63)


def _percent_of(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _sketch(tokens: np.ndarray) -> np.ndarray:
    """Parities of the numbers of tokens at 64 x SKETCH places."""
    places = (tokens >> np.uint64(7)) % np.uint64(64 * SKETCH)
    odd = np.bincount(places.astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _portions(batch: pd.DataFrame, rows: int = 1024) -> Iterator[pd.DataFrame]:
    """A batch in parts, so that what is made of it stays small."""
    for at in range(0, len(batch), rows):
        yield batch.iloc[at : at + rows]


def _reserve(n: int, percent: int) -> int:
    """Common tokens that a heavy set of size n must show in its prefix."""
    return max(1, (n - _percent_of(n, percent)) // 2)


def _scan(docs: DataFrame, size: int) -> DataFrame:
    """Rows of documents (doc_id, n, class, s0...) and of counters (slice, counts), in one pass."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shift = np.uint64(64 - COUNTERS.bit_length() + 1)
    width = COUNTERS // SLICES

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(COUNTERS, np.uint32)
        worker = 0
        for batch in batches:
            for rows in _portions(batch):
                sizes, prints, sketches = [], [], []
                for text in rows["text"]:
                    tokens = shingles(text, size)
                    sizes.append(len(tokens))
                    prints.append(_fingerprint(tokens))
                    sketches.append(_sketch(tokens))
                    np.add.at(counts, (tokens >> shift).astype(np.int64), 1)
                sketches = np.array(sketches, np.int64).reshape(-1, SKETCH)
                if prints:
                    worker = prints[0] & 0xFFFF
                yield pd.DataFrame(
                    {"doc_id": rows["doc_id"], "n": sizes, "class": prints, "slice": None, "part": None, "counts": None}
                    | {name: sketches[:, k] for k, name in enumerate(SKETCH_COLUMNS)}
                )
        parts = counts.reshape(SLICES, width)
        used = [k for k in range(SLICES) if parts[k].any()]
        yield pd.DataFrame(
            {"doc_id": None, "n": None, "class": None, "slice": used, "part": worker,
             "counts": [parts[k].tobytes() for k in used]}
            | dict.fromkeys(SKETCH_COLUMNS)
        )

    return docs.select("doc_id", "text").mapInPandas(
        scan,
        f"doc_id {kind}, n long, class long, slice int, part int, counts binary, "
        + ", ".join(f"{c} long" for c in SKETCH_COLUMNS),
    )


def _summed(rows: DataFrame) -> np.ndarray:
    """The counters over all tasks: SLICES rows of fixed size reach the driver."""

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.uint64) for c in group["counts"])
        return pd.DataFrame({"slice": [key[0]], "part": [0], "counts": [total.tobytes()]})

    @pandas_udf("binary")
    def widened(counts: pd.Series) -> pd.Series:
        return counts.map(lambda c: np.frombuffer(c, np.uint32).astype(np.uint64).tobytes())

    schema = "slice int, part int, counts binary"
    rows = rows.select("slice", (F.col("part") % 256).alias("part"), widened("counts").alias("counts"))
    # Two levels, so that a task adds 1/256 of the tasks' rows of a slice.
    rows = rows.groupBy("slice", "part").applyInPandas(add, schema)
    rows = rows.groupBy("slice").applyInPandas(add, schema)
    total = np.zeros((SLICES, COUNTERS // SLICES), np.uint64)
    for row in rows.collect():
        total[row["slice"]] = np.frombuffer(row["counts"], np.uint64)
    return total.ravel()


def boundary(counts: np.ndarray, percent: int) -> int:
    """The largest size for which subsets of two cost less than inverted lists."""
    total = float(counts.sum())
    usual = total / len(counts)
    met = float((counts * np.maximum(counts - usual, 0)).sum()) / max(total, 1.0)
    best = 1
    for n in range(2, 200):
        spare = n - _percent_of(n, percent)
        subsets = (spare + 2) * (spare + 1) / 2
        if subsets <= (spare + 1) * (1 + VISIT * met):
            best = n
        else:
            break
    return best


def _postings(docs: DataFrame, size: int, percent: int, counts: np.ndarray) -> DataFrame:
    """What each class puts on the lists: key, salt, class, n, first (place of the key), light."""
    light_to = boundary(counts, percent)
    # A byte for each counter, a fixed size: twice the binary logarithm.
    ranks = (2 * np.log2(np.maximum(counts, 1))).astype(np.uint8)
    spread = docs.sparkSession.sparkContext.broadcast(ranks.tobytes())
    shift = np.uint64(64 - COUNTERS.bit_length() + 1)

    def frame(blocks: list[tuple]) -> pd.DataFrame:
        lengths = [len(b[0]) for b in blocks]
        join = lambda k, t: np.concatenate([b[k] for b in blocks]).astype(t) if blocks else np.zeros(0, t)
        many = lambda k, t: np.repeat(np.array([b[k] for b in blocks], t), lengths)
        marks = many(3, np.int64)
        # A very long list is cut into salted parts of MAX_SALTED or so.
        salts = (np.exp2(join(2, np.float64) / 2) // MAX_SALTED).astype(np.int64) + 1
        return pd.DataFrame(
            {
                "key": join(0, np.uint64).view(np.int64),
                "salts": salts.astype(np.int32),
                "salt": (marks % salts).astype(np.int32),
                "class": marks,
                "n": many(4, np.int32),
                "first": join(1, np.int32),
                "kind": many(5, np.int8),
            }
        )

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank_of = np.frombuffer(spread.value, np.uint8)
        seen: set[int] = set()
        blocks: list[tuple] = []
        held = 0
        for batch in batches:
            for text in batch["text"]:
                tokens = shingles(text, size)
                n = len(tokens)
                mark = _fingerprint(tokens)
                if n < 2 or mark in seen:
                    continue
                seen.add(mark)
                rank = rank_of[(tokens >> shift).astype(np.int64)]
                spare = n - _percent_of(n, percent)
                reserve = _reserve(n, percent)
                order = np.lexsort((tokens, rank))[: spare + max(2, reserve)]
                head, rank = tokens[order], rank[order]
                if n <= light_to:
                    two, two_rank = head[: spare + 2], rank[: spare + 2]
                    left, right = np.triu_indices(len(two), 1)
                    blocks.append((_mixed(two[left] * MIX ^ two[right]), left, two_rank[right], mark, n, 1))
                    held += len(left)
                if 100 * n >= percent * light_to:
                    kind = 2 if n <= light_to else 0
                    stop = spare + reserve
                    blocks.append((head[:stop], np.arange(len(head[:stop])), rank[:stop], mark, n, kind))
                    held += stop
                if held >= ROWS_AT_ONCE:
                    yield frame(blocks)
                    blocks, held = [], 0
        yield frame(blocks)

    schema = "key long, salts int, salt int, class long, n int, first int, kind byte"
    return docs.select("text").mapInPandas(post, schema)


def _possible(percent: int) -> Column:
    """Whether sets that first meet at these places can overlap enough."""
    overlap = F.least(F.col("n") - F.col("first"), F.col("other_n") - F.col("other_first"))
    return (100 + percent) * overlap >= percent * (F.col("n") + F.col("other_n"))


def _differing() -> Column:
    """How many bits of two sketches differ."""
    return functools.reduce(
        Column.__add__, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"other_{c}"))) for c in SKETCH_COLUMNS]
    )


def _alike(percent: int) -> Column:
    """Whether the sketches leave it open that the sets link."""
    return (100 + percent) * _differing() <= (100 - percent) * (F.col("n") + F.col("other_n"))


def _other(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return rows.select([F.col(c).alias(c if c in keep else f"other_{c}") for c in rows.columns])


def _whole_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """class and tokens of the wanted classes, made anew from one text of each."""
    chosen = scratch.settle(
        classes.join(wanted, "class", "left_semi").select(F.col("one").alias("doc_id"), "class")
    )
    rows = docs.select("doc_id", "text")
    few = chosen.count() <= BROADCAST_ROWS  # 16 bytes a row
    picked = rows.join(F.broadcast(chosen) if few else chosen, rows["doc_id"].eqNullSafe(chosen["doc_id"]))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tokens = [shingles(t, size) for t in batch["text"]]
            keep = [_fingerprint(t) == c for t, c in zip(tokens, batch["class"], strict=True)]
            kept = [t.tobytes() for t, k in zip(tokens, keep, strict=True) if k]
            yield pd.DataFrame({"class": batch["class"][keep].to_numpy(), "tokens": kept})

    made = picked.select("text", "class").mapInPandas(make, "class long, tokens binary")
    return scratch.settle(made.dropDuplicates(["class"]))


def _linked(
    pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int, scratch: Scratch
) -> DataFrame:
    """The pairs a, b of classes whose whole sets link."""
    pairs = scratch.settle(pairs.distinct())
    asked = pairs.count()
    wanted = gathered(pairs.select(F.col("a").alias("class")).union(pairs.select("b")), asked).distinct()
    wanted = F.broadcast(wanted) if asked <= BROADCAST_PAIRS else wanted
    sets = _whole_sets(docs, classes, wanted, size, scratch)

    @pandas_udf("boolean")
    def link(left: pd.Series, right: pd.Series) -> pd.Series:
        def one(x: bytes, y: bytes) -> bool:
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            at = np.searchsorted(x, y)
            at[at == len(x)] = 0
            common = int((x[at] == y).sum())
            return 100 * common >= percent * (len(x) + len(y) - common)

        return pd.Series([one(x, y) for x, y in zip(left, right, strict=True)], dtype=bool)

    left = sets.select(F.col("class").alias("a"), F.col("tokens").alias("left"))
    right = sets.select(F.col("class").alias("b"), F.col("tokens").alias("right"))
    sent = F.broadcast(pairs) if asked <= BROADCAST_PAIRS else pairs
    found = left.join(sent, "a").join(right, "b").where(link("left", "right"))
    return scratch.settle(found.select("a", "b"))


def _lists(postings: DataFrame) -> DataFrame:
    """The postings on lists of two or more classes, each class once a list."""
    near = Window.partitionBy("key", "salt").orderBy("class")
    columns = ["key", "salts", "class", "n", "first", "kind"]
    rows = postings.select(
        *columns, F.lag("class").over(near).alias("before"), F.lead("class").over(near).alias("after")
    )
    new = F.col("before").isNull() | (F.col("before") != F.col("class"))
    shared = F.col("before").isNotNull() | F.col("after").isNotNull() | (F.col("salts") > 1)
    return rows.where(new & shared).select(columns)


def _sent(table: DataFrame) -> DataFrame:
    """Broadcast if it has at most BROADCAST_PAIRS rows, of 16 bytes or less."""
    return F.broadcast(table) if table.count() <= BROADCAST_PAIRS else table


def _promising(lists: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The postings of classes with enough common tokens to link, with their number ``held``.

    A linked set has sizes within the percentage of its own, so it shows the
    reserve of the smallest of these. Subsets of two stay. Of lists the
    prefix for k = 1 goes on.
    """
    subset = F.col("kind") == 1
    least = F.ceil(F.lit(percent) * F.col("n") / 100)
    reserve = F.greatest(F.lit(1), F.floor(F.floor((100 - percent) * least / 100) / 2))
    held = lists.groupBy("class", subset.alias("subset")).agg(F.count("*").alias("held"), F.max("n").alias("n"))
    kept = scratch.settle(held.where(F.col("subset") | (F.col("held") >= reserve)).drop("n"))
    rows = lists.withColumn("subset", subset).join(_sent(kept), ["class", "subset"])
    spare = F.floor((100 - percent) * F.col("n") / 100)
    return scratch.settle(rows.where(F.col("subset") | (F.col("first") <= spare)).drop("subset"))


def _sampled(lists: DataFrame, turn: int) -> DataFrame:
    """About SAMPLED postings of each class, chosen by their keys."""
    place = F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(1 << 20))
    return lists.where(place * F.col("held") < SAMPLED << 20)


def _rooted(lists: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The postings with the component of their class."""
    if roots is None:
        return lists.withColumn("root", F.col("class"))
    named = roots.select(F.col("node").alias("class"), F.col("root").alias("new"))
    rows = lists.join(_sent(named), "class", "left")
    return rows.withColumn("root", F.coalesce("new", "class")).drop("new")


def _with_roots(lists: DataFrame, roots: DataFrame | None, scratch: Scratch) -> DataFrame:
    """The postings on lists that hold classes of two or more components."""
    rows = scratch.settle(_rooted(lists.drop("root"), roots))
    ends = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    mixed = scratch.settle(ends.where("low <> high").select("key"))
    rows = scratch.settle(rows.join(mixed, "key", "left_semi"))
    release(lists.sparkSession)
    return rows


def _some_pairs(lists: DataFrame, sketches: DataFrame, percent: int, turn: int) -> DataFrame:
    """For each class two classes of other components that stand beside it on a list."""
    mixed = F.xxhash64("class", "key", F.lit(turn))
    near = Window.partitionBy("key", F.pmod(mixed, F.col("salts"))).orderBy(mixed)
    other = [F.lag(c).over(near).alias(f"other_{c}") for c in ("class", "n", "first", "root")]
    rows = lists.select("key", "class", "n", "first", "root", *other)
    rows = rows.where((F.col("root") != F.col("other_root")) & _possible(percent))
    order = F.xxhash64("key", F.lit(turn))
    pairs = rows.groupBy("class").agg(
        F.min_by("other_class", order).alias("p"), F.max_by("other_class", order).alias("q")
    )
    pairs = pairs.select("class", F.explode(F.array("p", "q")).alias("other_class")).distinct()
    pairs = pairs.join(sketches, "class").join(_other(sketches), "other_class")
    return _named(pairs.where(_alike(percent)))


def _tops(lists: DataFrame) -> DataFrame:
    """The largest component (top) of each list."""
    sizes = lists.groupBy("key", "root").agg(F.count("*").alias("size"))
    return sizes.groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("top"))


def _parts(lists: DataFrame) -> Column:
    """Into how many parts a long list is cut; lists without salts are short."""
    return F.col("salts") if "salts" in lists.columns else F.lit(1)


def _nearest_pairs(lists: DataFrame, sketches: DataFrame, percent: int, turn: int) -> DataFrame:
    """For each class outside the largest component of a list two classes of other components.

    They stand beside it on its lists and may link: one whose sketch is nearest
    for their sizes, and one chosen by hash.
    """
    mixed = F.xxhash64("class", "key", F.lit(turn))
    near = Window.partitionBy("key", F.pmod(mixed, _parts(lists))).orderBy(mixed)
    names = ["class", "n", "first", "root", *SKETCH_COLUMNS]
    rows = lists.drop("n").join(sketches, "class")
    rows = rows.select("key", *names, *[F.lag(c).over(near).alias(f"other_{c}") for c in names])
    rows = rows.where((F.col("root") != F.col("other_root")) & _possible(percent) & _alike(percent))
    far = _differing() / (F.col("n") + F.col("other_n"))
    sides = F.array(
        F.struct("class", "root", F.col("other_class").alias("other")),
        F.struct(F.col("other_class").alias("class"), F.col("other_root").alias("root"), F.col("class").alias("other")),
    )
    rows = rows.select("key", far.alias("far"), F.explode(sides).alias("side")).join(_tops(lists), "key")
    rows = rows.where("side.root <> top").select("key", "far", "side.class", "side.other")
    pairs = rows.groupBy("class").agg(
        F.min_by("other", F.struct("far", "other")).alias("p"),
        F.min_by("other", F.xxhash64("key", F.lit(turn))).alias("q"),
    )
    return _named(pairs.select("class", F.explode(F.array("p", "q")).alias("other_class")))


def _rest_of_pairs(lists: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """All pairs of classes that share a list, are of different components and may link.

    Of two classes in different components one is outside the largest component
    of the list; only such classes look for partners. Long lists are cut into
    salted parts, and those who look visit each.
    """
    rows = lists.select("key", "salts", "class", "first", "kind", "root")
    left = rows.join(_tops(lists), "key").where("root <> top").join(sketches, "class")
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    right = rows.withColumn("part", F.pmod(F.xxhash64("class"), F.col("salts")).cast("int")).join(sketches, "class")
    pairs = left.join(_other(right, ("key", "part")), ["key", "part"])
    pairs = pairs.where("root <> other_root AND (other_root = top OR class < other_class)")
    pairs = pairs.where("kind = 0 OR other_kind = 0 OR (kind = 1 AND other_kind = 1)")
    return _named(pairs.where(_possible(percent) & _alike(percent)))


def _named(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        F.least("class", "other_class").alias("a"), F.greatest("class", "other_class").alias("b")
    )


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of the documents: doc_id, n_shingles, class and component_id."""
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        seen = scratch.settle(_scan(docs, size))
        rows = settle(seen.where("n IS NOT NULL").select("doc_id", "n", "class"))
        classes = scratch.settle(
            seen.where("n IS NOT NULL").groupBy("class").agg(
                F.min("doc_id").alias("one"), F.count("*").alias("copies"), F.max("n").alias("n"),
                *[F.max(c).alias(c) for c in SKETCH_COLUMNS],  # equal in all copies
            )
        )
        sketches = classes.select("class", "n", *SKETCH_COLUMNS)
        counts = _summed(seen.where("slice IS NOT NULL"))
        lists = scratch.settle(_lists(_postings(docs, size, percent, counts)))
        release(spark)

        lists = _promising(lists, percent, scratch)
        links = roots = None
        for turn in range(ROUNDS):
            some = _rooted(_sampled(lists, turn), roots)
            found = _linked(_some_pairs(some, sketches, percent, turn), docs, classes, size, percent, scratch)
            links = scratch.settle(found if links is None else links.union(found))
            roots = components(links, scratch)
            release(spark)
        lists = _with_roots(lists, roots, scratch)
        found = _linked(_nearest_pairs(lists, sketches, percent, ROUNDS), docs, classes, size, percent, scratch)
        links = scratch.settle(links.union(found))
        roots = components(links, scratch)
        lists = _with_roots(lists, roots, scratch)
        release(spark)
        found = _linked(_rest_of_pairs(lists, sketches, percent), docs, classes, size, percent, scratch)
        roots = components(links.union(found), scratch).withColumnRenamed("node", "class")
        named = classes.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
        names = named.groupBy("root").agg(F.min("one").alias("component_id"))
        linked = F.when(F.col("n") > 0, F.col("component_id")).alias("component_id")
        named = settle(named.join(names, "root").select("class", "copies", linked))
    joined = join_unique(rows.withColumnRenamed("n", "n_shingles"), named, "class", "copies", "doc_id", "left")
    return joined.select(
        "doc_id", "n_shingles", "class", F.coalesce("component_id", "doc_id").alias("component_id")
    )
