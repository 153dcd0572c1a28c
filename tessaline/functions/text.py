"""Text functions without Python: hashes, token sets, overlaps, word tests, polarity, size estimates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whole-word markers of negation; an even number cancels out.
NEGATIONS = (
    "not", "n't", "never", "no", "none", "neither", "nor", "cannot", "can't", "won't", "don't", "doesn't", "didn't", "shouldn't", "wouldn't", "couldn't", "isn't", "aren't", "wasn't", "weren't", "hasn't", "haven't", "hadn't",
)


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def normalised_hash(text: Column) -> Column:
    return F.sha2(collapsed(text).cast("binary"), 256)


def tokens(text: Column, least: int = 2) -> Column:
    """Distinct lower-case ASCII words of at least `least` characters, sorted."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) >= least)
    return F.array_sort(F.array_distinct(words))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as distinct arrays; 0 when both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, both / F.when(either > 0, either)).otherwise(0.0)


def dice(a: Column, b: Column) -> Column:
    size = F.size(a) + F.size(b)
    return F.when(size > 0, 2.0 * F.size(F.array_intersect(a, b)) / F.when(size > 0, size)).otherwise(0.0)


def contains_word(text: Column, word: str) -> Column:
    return F.lower(text).rlike(rf"(^|[^a-z0-9]){re.escape(word.lower())}($|[^a-z0-9])")


def contains_ignoring_case(text: Column, part: str) -> Column:
    return F.lower(text).contains(part.lower())


def is_positive(text: Column) -> Column:
    """Whether the number of negation markers is even."""
    words = F.split(F.lower(text), "[^a-z']+")
    return F.size(F.filter(words, lambda w: w.isin(*NEGATIONS))) % 2 == 0


def token_estimate(text: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4.0).cast("bigint")
