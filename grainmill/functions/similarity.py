"""Similarity tests used for near-duplicate rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def character_set(text: Column) -> Column:
    """Distinct lower-cased characters of a text."""
    characters = F.array_distinct(F.split(F.lower(text), ""))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(characters)


def similar_character_sets(a: Column, b: Column, threshold: float) -> Column:
    """Jaccard overlap of two character sets reaches the threshold.

    Two empty or two missing texts are similar; an empty or a missing one is
    never similar to a filled one.
    """
    size_a, size_b = F.array_size(a), F.array_size(b)
    shared = F.array_size(F.array_intersect(a, b)).cast("double")
    overlap = F.try_divide(shared, size_a + size_b - shared)
    return (
        F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull())
        .when((size_a == 0) | (size_b == 0), size_a == size_b)
        .otherwise(overlap >= threshold)
    )


def similar_strings(a: Column, b: Column, threshold: float = 0.9) -> Column:
    """Texts are equal or their character sets overlap by the threshold."""
    sets = similar_character_sets(character_set(a), character_set(b), threshold)
    return a.eqNullSafe(b) | sets


def similar_numbers(a: Column, b: Column, threshold: float = 0.05) -> Column:
    """Relative difference within the threshold; absolute when one side is 0."""
    x, y = a.cast("double"), b.cast("double")
    gap = F.abs(x - y)
    largest = F.greatest(F.abs(x), F.abs(y))
    return (
        F.when(x.isNull() | y.isNull() | F.isnan(x) | F.isnan(y), F.lit(False))
        .when(x == y, F.lit(True))
        .when((x == 0) | (y == 0), gap <= threshold)
        .otherwise(F.try_divide(gap, largest) <= threshold)
    )
