"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

Words are lower-cased runs of letters, digits and non-ASCII characters. A fixed
mask selects some positions of a window and ignores the others, so a replaced
word under an ignored position does not hide a shared passage. Seeds of the
benchmark items and of all documents are joined on their hashes. At a hit
document and item are laid over each other. The document is contaminated if
any stretch there holds ``min_matches`` equal words or the whole item, and the
share of equal words in it is ``min_share`` or more. With the weights 1 - share
of a match and -share of a replaced word, the stretches with that share are
those whose sum is not negative; of them the one of highest sum is reported.

The masks meet every stretch of ten or more equal words with a share of 0.75 or
more. Of one with 20 equal words, either the part up to its tenth or the rest
is such a stretch too, so it is enough that they meet all stretches of up to 19
equal and 6 replaced words, which a test counts through. Smaller parameters
have no such guarantee.

Items shorter than a window are looked for as a whole. Missing and empty texts
on either side match nothing; items of equal text are all reported; several
rows with one doc_id are judged together, as are items with one item_id; rows
without an id are left out, as nothing could name them. Only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import functools
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.session import Scratch, settle

# Selected positions of the masks, six in a window of six to twelve words.
MASKS = [
    (0, 1, 2, 3, 4, 5), (0, 1, 3, 5, 6, 7), (0, 1, 3, 6, 8, 9), (0, 1, 2, 6, 9, 10),
    (0, 1, 3, 5, 8, 10), (0, 1, 4, 8, 10, 11), (0, 2, 6, 7, 10, 11),
]
SPAN = 9
MIN_MATCHES = 10
MIN_SHARE = 0.75
BROADCAST_ROWS = 1_000_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text: str) -> Column:
    plain = F.lower(F.coalesce(F.col(text), F.lit("")))
    return F.array_remove(F.split(plain, NOT_WORD), "")


def _seeds(rows: DataFrame, masks: list[tuple[int, ...]]) -> DataFrame:
    """Rows id, at (word position) and seed, for each mask at each position where it fits.

    The hashes of the words are made once per text; what runs per position is
    small enough for the JVM to compile.
    """
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    rows = rows.select("id", hashes.alias("hashes"))
    reach = min(mask[-1] + 1 for mask in masks)
    steps = F.sequence(F.lit(0), F.size("hashes") - reach)
    places = rows.where(F.size("hashes") >= reach).select("id", "hashes", F.explode(steps).alias("at"))
    seeds = [
        F.when(
            F.col("at") + mask[-1] < F.size("hashes"),
            F.xxhash64(F.lit(k), *[F.get("hashes", F.col("at") + o) for o in mask]),
        )
        for k, mask in enumerate(masks)
    ]
    return places.select("id", "at", F.explode(F.array(*seeds)).alias("seed")).where("seed IS NOT NULL")


def _hits(texts: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows id, item_id, shift: where a seed of both sides meets."""
    sizes = [r["n"] for r in items.where(F.size("words") < SPAN).select(F.size("words").alias("n")).distinct().collect()]
    found = []
    # The masks, and a whole item for each length below SPAN that occurs.
    for masks, reach in [(MASKS, SPAN), *[([tuple(range(n))], n) for n in sorted(sizes)]]:
        own = items if reach == SPAN else items.where(F.size("words") == reach)
        known = _seeds(own, masks).select(F.col("id").alias("item_id"), F.col("at").alias("item_at"), "seed")
        known = scratch.settle(known)
        few = known.count() <= BROADCAST_ROWS  # 24 bytes a row
        met = _seeds(texts, masks).join(F.broadcast(known) if few else known, "seed")
        found.append(met.select("id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")))
    return scratch.settle(functools.reduce(DataFrame.union, found).distinct())


def _matches(equal: Column, share: Fraction) -> Column:
    """The matches of a Boolean array: place and rise, its number less share * place, times a constant."""
    places = F.filter(F.transform(equal, lambda same, at: F.when(same, at)), lambda at: at.isNotNull())
    return F.transform(
        places,
        lambda at, k: F.struct(
            k.alias("k"), at.alias("at"), (k.cast("long") * share.denominator - at.cast("long") * share.numerator).alias("rise")
        ),
    )


def _stretch(matched: Column, enough: Column, share: Fraction) -> Column:
    """Of the stretches with enough matches, the one of highest sum: score, matches, first, last (exclusive).

    The sum of a stretch is the difference in rise of its last and first match
    and a constant. So the best start for a last match is the lowest rise
    among the matches at least ``enough`` before it. Without any, the score is -1.
    """
    spare = F.greatest(F.size(matched) - enough + 1, F.lit(0))
    pairs = F.zip_with(
        F.slice(matched, F.lit(1), spare), F.slice(matched, enough, spare),
        lambda first, last: F.struct(first.alias("first"), last.alias("last")),
    )
    start = F.struct(
        F.lit(None).cast("struct<k: int, at: int, rise: bigint>").alias("low"), F.lit(-1).cast("long").alias("score"),
        *[F.lit(0).alias(c) for c in ("matches", "first", "last")],
    )

    def step(state: Column, pair: Column) -> Column:
        fresh, end = pair["first"], pair["last"]
        low = F.when(fresh["rise"] >= state["low"]["rise"], state["low"]).otherwise(fresh)
        score = end["rise"] - low["rise"] + (share.denominator - share.numerator)
        matches = end["k"] - low["k"] + 1
        better = (score > state["score"]) | ((score == state["score"]) & (matches > state["matches"]))
        return F.struct(
            low.alias("low"),
            F.when(better, score).otherwise(state["score"]).alias("score"),
            F.when(better, matches).otherwise(state["matches"]).alias("matches"),
            F.when(better, low["at"]).otherwise(state["first"]).alias("first"),
            F.when(better, end["at"] + 1).otherwise(state["last"]).alias("last"),
        )

    return F.aggregate(pairs, start, step)


def benchmark_overlaps(
    docs: DataFrame, benchmark: DataFrame, min_matches: int = MIN_MATCHES, min_share: float = MIN_SHARE
) -> DataFrame:
    """One row per contaminated document and item: the best stretch they share.

    Columns doc_id, item_id, doc_start, item_start, n_words, n_matches and
    item_words; starts are word positions from 0.
    """
    with Scratch(docs.sparkSession) as scratch:
        benchmark = benchmark.where("item_id IS NOT NULL")
        docs = docs.where("doc_id IS NOT NULL")
        items = benchmark.select(F.col("item_id").alias("id"), word_array("text").alias("words"))
        items = scratch.settle(items.where(F.size("words") > 0))
        texts = docs.select(F.col("doc_id").alias("id"), word_array("text").alias("words"))
        hits = _hits(texts, items, scratch)

        aligned = hits.join(
            items.select(F.col("id").alias("item_id"), F.col("words").alias("item_words")), "item_id"
        )
        few = hits.count() <= BROADCAST_ROWS
        wanted = hits.select("id").distinct()
        texts = texts.join(F.broadcast(wanted) if few else wanted, "id", "left_semi")
        aligned = aligned.join(texts, "id")
        begin = F.greatest(F.col("shift"), F.lit(0))
        skipped = begin - F.col("shift")
        both = F.zip_with(
            F.slice("words", begin + 1, F.size("item_words")),
            F.slice("item_words", skipped + 1, F.size("item_words")),
            lambda a, b: F.coalesce(a == b, F.lit(False)),
        )
        share = Fraction(str(min_share))
        enough = F.greatest(F.least(F.lit(min_matches), F.size("item_words")), F.lit(1))
        laid = aligned.select(
            "id", "item_id", F.size("item_words").alias("item_words"), begin.alias("begin"),
            skipped.alias("skipped"), enough.alias("enough"), _matches(both, share).alias("matched"),
        )
        best = laid.select(
            "id", "item_id", "item_words", "begin", "skipped",
            _stretch(F.col("matched"), F.col("enough"), share).alias("best"),
        )
        length = F.col("best.last") - F.col("best.first")
        found = best.where("best.score >= 0")
        found = found.select(
            F.col("id").alias("doc_id"), "item_id",
            F.struct(
                F.col("best.matches").alias("n_matches"), (-length).alias("longer"),
                (-F.col("begin") - F.col("best.first")).alias("later"),
                (F.col("begin") + F.col("best.first")).cast("long").alias("doc_start"),
                (F.col("skipped") + F.col("best.first")).cast("long").alias("item_start"),
                length.cast("long").alias("n_words"), "item_words",
            ).alias("best"),
        )
        found = settle(found.groupBy("doc_id", "item_id").agg(F.max("best").alias("best")))
    return found.select(
        "doc_id", "item_id", "best.doc_start", "best.item_start", "best.n_words",
        F.col("best.n_matches").cast("long").alias("n_matches"),
        F.col("best.item_words").cast("long").alias("item_words"),
    )
