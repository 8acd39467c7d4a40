"""Token and gram expressions (JVM-side, no UDF).

``tokens(s)``: lower case, split on runs of non letter/digit characters,
empty strings dropped, no stemming.  Leading separators are stripped first
so array positions are token positions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sagebrush.config import GRAM_SIZE, LEADING_SEP, TOKEN_SPLIT


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokens(col: Column | str) -> Column:
    """array<string> of tokens; NULL text gives an empty array.

    Leading separators are stripped, so only the last element of the split can
    be empty; it is sliced off (no per-element lambda, which Spark would
    interpret instead of compiling)."""
    s = F.regexp_replace(F.lower(F.coalesce(_c(col), F.lit(""))), LEADING_SEP, "")
    arr = F.split(s, TOKEN_SPLIT)
    return F.when(F.element_at(arr, -1) == "", F.slice(arr, 1, F.size(arr) - 1)).otherwise(arr)


def array_tokens(col: Column | str) -> Column:
    """Tokens of an array<string> field counted as the concatenation of its elements."""
    return tokens(F.array_join(F.coalesce(_c(col), F.array().cast("array<string>")), " "))


def token_grams(tok: Column, n: int = GRAM_SIZE) -> Column:
    """All n-character substrings of one token; a token shorter than n stays whole."""
    last = F.greatest(F.length(tok) - n, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(tok, i + 1, n))


def grams(col: Column | str, n: int = GRAM_SIZE) -> Column:
    """Grams of every token of a string field (the `gram-size: 3` match mode)."""
    return F.flatten(F.transform(tokens(col), lambda t: token_grams(t, n)))


def query_terms(col: Column | str) -> Column:
    """Distinct tokens of a query text."""
    return F.array_distinct(tokens(col))
