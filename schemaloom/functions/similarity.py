"""Similarities of names and sets, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from schemaloom.functions.names import bare_key, joined_key, tokens


def closeness(a: Column, b: Column) -> Column:
    """1 less the edit distance as a share of the longer text; 0 if both are empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def syntactic(a: Column, b: Column) -> Column:
    """Closeness of the bare names; 1 if they are equal, 0 if one is empty."""
    x, y = bare_key(a), bare_key(b)
    return F.when((x == "") | (y == ""), F.lit(0.0)).otherwise(closeness(x, y))


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements of two arrays as a share of all; 0 if both are empty. Nulls and repetitions don't count."""
    x, y = F.array_distinct(F.array_compact(a)), F.array_distinct(F.array_compact(b))
    shared = F.size(F.array_intersect(x, y))
    every = F.size(x) + F.size(y) - shared
    return F.when(every == 0, F.lit(0.0)).otherwise(shared / every)


def token_jaccard(a: Column, b: Column) -> Column:
    return jaccard(tokens(a), tokens(b))


def hybrid(a: Column, b: Column) -> Column:
    return F.greatest(syntactic(a, b), token_jaccard(a, b))


def lexical(a: Column, b: Column) -> Column:
    """Mean of the closeness of the joined names and the token Jaccard."""
    return 0.5 * closeness(joined_key(a), joined_key(b)) + 0.5 * token_jaccard(a, b)


def structural(category_a: Column, category_b: Column, targets_a: Column, targets_b: Column, properties_a: Column, properties_b: Column) -> Column:
    """Same category, shared relation targets and shared properties."""
    return 0.34 * F.when(category_a == category_b, 1.0).otherwise(0.0) + 0.33 * jaccard(targets_a, targets_b) + 0.33 * jaccard(properties_a, properties_b)


def overlap(shared: Column, a: Column, b: Column) -> Column:
    """Jaccard from counts: shared values and the values of either side; 0 if a side has none."""
    return F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(shared / (a + b - shared))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))


def share(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)
