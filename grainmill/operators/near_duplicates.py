"""Rows that nearly equal their neighbour in a given order, or any other row."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.columns import col, numeric_columns, require, string_columns
from grainmill.functions.similarity import (
    character_set,
    similar_character_sets,
    similar_numbers,
)
from grainmill.plans.lookup import balanced_lookup
from grainmill.plans.ordering import ROWS_PER_BLOCK, split_points, with_previous
from grainmill.session import settle

NO_TEXT, EMPTY_TEXT, ANY = "missing", "empty", "any"
# Parts of a sketch of a set, of 64 bits each.
SKETCH = 2


def near_duplicates(
    df: DataFrame,
    order_by: list[str],
    texts: list[str] | None = None,
    numbers: list[str] | None = None,
    string_threshold: float = 0.9,
    numeric_threshold: float = 0.05,
    block_by: list[str] | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Pairs of neighbouring rows that are similar in all compared columns.

    ``texts`` and ``numbers`` are the columns to compare, by default all
    text and all numeric columns but the key. Neighbours follow ``order_by``, which must name a
    unique key; with ``block_by`` both rows must also agree in those columns,
    and rows are ordered by them first. Result: the order columns of the
    earlier row with the prefix ``previous_`` and those of the later row.

    Only the character sets of the texts are moved and compared, however long
    the texts are. At most one pair per row is produced.
    """
    if not 0 <= string_threshold <= 1:
        raise ValueError("string_threshold must be between 0 and 1")
    if texts is None:
        texts = [c for c in string_columns(df) if c not in order_by]
    if numbers is None:
        numbers = [c for c in numeric_columns(df) if c not in order_by]
    if not texts and not numbers:
        raise ValueError("no column to compare")
    blocks = list(block_by or [])
    order = blocks + [c for c in order_by if c not in blocks]
    require(df, order + list(texts) + list(numbers))

    points = split_points(df, order, rows_per_block)
    narrow = df.select(
        *[col(c) for c in order],
        *[F.array_join(character_set(col(c)), "").alias(f"_s{i}")
          for i, c in enumerate(texts)],
        *[col(c).cast("double").alias(f"_n{i}") for i, c in enumerate(numbers)],
    )
    sets = [f"_s{i}" for i in range(len(texts))]
    amounts = [f"_n{i}" for i in range(len(numbers))]
    paired = with_previous(narrow, order, order + sets + amounts, "_previous", points)

    similar = F.col("_previous").isNotNull()
    for b in blocks:
        similar &= col(b).eqNullSafe(F.col("_previous").getField(b))
    for n in amounts:
        similar &= similar_numbers(F.col(n), F.col("_previous").getField(n), numeric_threshold)
    for s in sets:
        similar &= similar_character_sets(
            character_set(F.col(s)),
            character_set(F.col("_previous").getField(s)),
            string_threshold,
        )
    return paired.where(similar).select(
        *[F.col("_previous").getField(c).alias(f"previous_{c}") for c in order],
        *[col(c) for c in order],
    )


@dataclass
class NearDuplicates:
    """``classes`` of rows that are equal in what is compared (first: the least key, n: rows), ``members``
    (the key of each row and the ``first`` of its class) and ``pairs`` of classes that are similar."""

    key: list[str]
    classes: DataFrame
    members: DataFrame
    pairs: DataFrame

    def summary(self) -> DataFrame:
        """Classes, pairs of them, and the number of similar pairs of rows."""
        within = self.classes.where("NOT alone").agg(
            F.count("*").alias("classes"),
            F.coalesce(F.sum(F.expr("n * (n - 1) DIV 2")), F.lit(0)).alias("within"),
        )
        alone = self.classes.where("alone").agg(F.count("*").alias("alone"))
        between = self.pairs.agg(
            F.count("*").alias("class_pairs"), F.coalesce(F.sum(F.expr("n * other_n")), F.lit(0)).alias("between")
        )
        parts = [
            within.select("classes", F.col("within"), *[F.lit(0).cast("long").alias(c) for c in ("alone", "class_pairs", "between")]),
            alone.selectExpr("0L AS classes", "0L AS within", "alone", "0L AS class_pairs", "0L AS between"),
            between.selectExpr("0L AS classes", "0L AS within", "0L AS alone", "class_pairs", "between"),
        ]
        rows = parts[0].unionAll(parts[1]).unionAll(parts[2]).agg(
            (F.sum("classes") + F.sum("alone")).alias("classes"), F.sum("class_pairs").alias("class_pairs"),
            (F.sum("within") + F.sum("between")).alias("candidates_found"),
        )
        return rows


def _prefixes(classes: DataFrame, threshold: float) -> DataFrame:
    """The classes with ``prefix``: their rarest characters, of which similar sets share one.

    If x and y are similar, they share ``ceil(threshold * |x|)`` characters or
    more, so in any common order the first ``|x| - ceil(threshold * |x|) + 1`` of
    x meet those of y. Rare ones first: the number of classes with each
    character is a table of one row per character of the alphabet, so its size
    is bounded by Unicode.
    """
    if threshold <= 0:
        kind = F.when(F.col("_s0").isNull(), NO_TEXT).when(F.col("_s0") == "", EMPTY_TEXT).otherwise(ANY)
        return classes.withColumn("prefix", F.array(kind))
    letters = classes.where("_s0 <> ''").select("class", F.explode(F.split("_s0", "")).alias("letter"))
    rarity = F.broadcast(letters.groupBy("letter").agg(F.count("*").alias("held")))
    n = F.char_length("_s0")
    size = n - F.ceil(F.lit(threshold) * n - 1e-9) + 1
    ordered = letters.join(rarity, "letter").groupBy("class").agg(
        F.array_sort(F.collect_list(F.struct("held", "letter"))).alias("ordered")
    )
    rows = classes.join(ordered, "class", "left")
    kept = F.slice(F.col("ordered.letter"), F.lit(1), F.least(n, size).cast("int"))
    filled = F.when(F.col("_s0").isNull(), F.array(F.lit(NO_TEXT))).when(F.col("_s0") == "", F.array(F.lit(EMPTY_TEXT)))
    return rows.withColumn("prefix", filled.otherwise(kept)).drop("ordered")


def _buckets(number: Column, threshold: float) -> tuple[Column, Column]:
    """Texts that name buckets of a number, for either side of a join.

    Numbers of one sign within the relative threshold are in the same or in
    neighbouring buckets of the logarithm. Zero, and what is within the
    threshold of it, meets in a bucket of its own.
    """
    if threshold >= 1:
        return F.array(F.lit(ANY)), F.array(F.lit(ANY))
    sign = F.when(number < 0, "-").otherwise("+")
    if threshold > 0:
        place = F.floor(F.log(F.abs(number)) / F.lit(-math.log1p(-threshold)))
        names = [F.concat(sign, (place + k).cast("string")) for k in (0, 1)]
    else:
        names = [number.cast("string")]
    zero = F.lit("zero")
    small = F.abs(number) <= threshold

    def side(own: list[Column]) -> Column:
        return F.when(number == 0, F.array(zero)).when(small, F.array(*own, zero)).otherwise(F.array(*own))

    return side(names[:1]), side(names)


def _sketched(text: str) -> dict[str, Column]:
    """The size of a set that is written as a text, and parities of the numbers of its characters at 64 x SKETCH places."""
    places = f"pmod(xxhash64(l), {64 * SKETCH})"
    parts = {
        f"{text}_m{k}": F.expr(
            f"aggregate(split({text}, ''), 0L, (a, l) -> "
            f"CASE WHEN {places} DIV 64 = {k} THEN a ^ shiftleft(1L, int({places} % 64)) ELSE a END)"
        )
        for k in range(SKETCH)
    }
    parts[f"{text}_n"] = F.char_length(text).cast("long")
    return {name: F.coalesce(c, F.lit(0).cast("long")) for name, c in parts.items()}


def _alike(text: str, threshold: float) -> Column:
    """Whether sizes and sketches leave it open that two sets are similar.

    Sketches differ in no more places than the sets in characters.
    """
    n, other_n = F.col(f"{text}_n"), F.col(f"other_{text}_n")
    most = F.lit(1 - threshold) * (n + other_n) + 1e-6
    differ = F.lit(0)
    for k in range(SKETCH):
        differ = differ + F.bit_count(F.col(f"{text}_m{k}").bitwiseXOR(F.col(f"other_{text}_m{k}")))
    return (F.lit(1 + threshold) * F.abs(n - other_n) <= most) & (F.lit(1 + threshold) * differ <= most)


def near_duplicate_classes(
    df: DataFrame,
    key: list[str],
    texts: list[str] | None = None,
    numbers: list[str] | None = None,
    string_threshold: float = 0.9,
    numeric_threshold: float = 0.05,
    block_by: list[str] | None = None,
) -> NearDuplicates:
    """All similar pairs of rows, as pairs of classes and their members.

    Rows that agree in the blocking columns, in the character sets of all texts
    and in all numbers are a class; they are counted and never paired with each
    other. Classes meet where they share a rare character of the first text
    and a bucket of the first number; each pair is met once, and all columns are
    then compared. ``key`` should be unique; the least key names a class. A row
    that lacks a number (or has NaN) is similar to none and a class of its own.
    Missing texts are similar to each other, empty ones too. Blocking columns
    that lack a value agree. An empty table gives no classes.
    """
    for name, value in (("string_threshold", string_threshold), ("numeric_threshold", numeric_threshold)):
        if value < 0 or name == "string_threshold" and value > 1:
            raise ValueError(f"{name} is out of range")
    if texts is None:
        texts = [c for c in string_columns(df) if c not in key]
    if numbers is None:
        numbers = [c for c in numeric_columns(df) if c not in key]
    if not texts and not numbers:
        raise ValueError("no column to compare")
    blocks = list(block_by or [])
    require(df, [*key, *texts, *numbers, *blocks])
    sets, amounts = [f"_s{i}" for i in range(len(texts))], [f"_n{i}" for i in range(len(numbers))]
    parts = [f"_b{i}" for i in range(len(blocks))]
    narrow = df.select(
        F.struct(*[col(c).alias(c) for c in key]).alias("key"),
        *[F.array_join(F.array_sort(character_set(col(c))), "").alias(s) for c, s in zip(texts, sets, strict=True)],
        # Adding 0.0 turns a negative zero into zero.
        *[(col(c).cast("double") + F.lit(0.0)).alias(a) for c, a in zip(numbers, amounts, strict=True)],
        *[col(c).alias(b) for c, b in zip(blocks, parts, strict=True)],
    )
    lacking = F.lit(False)
    for a in amounts:
        lacking = lacking | F.col(a).isNull() | F.isnan(a)
    values = F.to_json(F.struct(*sets, *amounts, *parts, F.when(lacking, F.col("key")).alias("own")))
    narrow = narrow.withColumns({"alone": lacking, "digest": F.sha2(values, 256)})
    grouped = narrow.groupBy("digest").agg(
        F.min("key").alias("first"), F.count("*").alias("n"), F.any_value("alone").alias("alone"),
        *[F.any_value(c).alias(c) for c in (*sets, *amounts, *parts)],
    )
    # Numbered before they are written, so the numbers stay.
    classes = settle(grouped.withColumn("class", F.monotonically_increasing_id()))
    sizes = classes.agg(F.sum("n").alias("rows"), F.count("*").alias("classes")).first()
    members = balanced_lookup(
        narrow.select("digest", "key"), classes.select("digest", "first"), classes.select("digest", "n"), "digest",
        sizes["rows"] or 0, sizes["classes"],
    ).select("key.*", *[F.col("first").getField(c).alias(f"first_{c}") for c in key])

    wanted = classes.where("NOT alone")
    rows = _prefixes(wanted, string_threshold) if texts else wanted.withColumn("prefix", F.array(F.lit(ANY)))
    left, right = _buckets(F.col("_n0"), numeric_threshold) if numbers else (F.array(F.lit(ANY)),) * 2
    # The prefixes are computed once for both sides of the join.
    rows = settle(
        rows.select(
            "class", "first", "n", *sets, *amounts, *parts, "prefix",
            left.alias("left"), right.alias("right"), F.get(left, F.lit(0)).alias("own"),
            *[c.alias(name) for text in sets for name, c in _sketched(text).items()],
        )
    )
    ours = rows.drop("right").withColumn("bucket", F.explode("left")).drop("left")
    ours = ours.withColumn("letter", F.explode("prefix"))
    theirs = rows.drop("left").withColumn("bucket", F.explode("right")).drop("right")
    theirs = theirs.withColumn("letter", F.explode("prefix"))
    theirs = theirs.select([F.col(c).alias(c if c in ("bucket", "letter") else f"other_{c}") for c in theirs.columns])
    on = (ours["bucket"] == theirs["bucket"]) & (ours["letter"] == theirs["letter"])
    for b in parts:
        on &= F.col(b).eqNullSafe(F.col(f"other_{b}"))
    met = ours.join(theirs, on).drop(theirs["bucket"]).drop(theirs["letter"])
    once = F.get(F.array_intersect("prefix", "other_prefix"), F.lit(0)) == F.col("letter")
    # A pair of neighbouring buckets meets in one order only, others in both.
    at_zero = F.col("bucket") == "zero"
    both_orders = (F.col("own") == F.col("other_own")) | at_zero
    once &= ~both_orders | (F.col("class") < F.col("other_class"))
    if numbers:  # two small numbers meet in their own buckets
        once &= ~at_zero | (F.col("_n0") == 0) | (F.col("other__n0") == 0)
    similar = F.lit(True)
    for a in amounts:
        similar &= similar_numbers(F.col(a), F.col(f"other_{a}"), numeric_threshold)
    for s in sets:
        similar &= similar_character_sets(_letters(s), _letters(f"other_{s}"), string_threshold)
    swapped = F.col("first") > F.col("other_first")
    # Most pairs that meet are ruled out by a few numbers, before any set is read.
    for s in sets:
        met = met.where(_alike(s, string_threshold))
    found = met.where(once & similar)
    pairs = found.select(
        *[F.when(swapped, F.col("other_first").getField(c)).otherwise(F.col("first").getField(c)).alias(f"first_{c}") for c in key],
        *[F.when(swapped, F.col("first").getField(c)).otherwise(F.col("other_first").getField(c)).alias(f"second_{c}") for c in key],
        F.when(swapped, F.col("other_n")).otherwise(F.col("n")).alias("n"),
        F.when(swapped, F.col("n")).otherwise(F.col("other_n")).alias("other_n"),
    )
    return NearDuplicates(list(key), classes, members, pairs)


def _letters(text: str) -> Column:
    """The characters of a set that is written as a text."""
    return F.when(F.col(text) == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))
