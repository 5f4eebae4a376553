"""Exact "pattern is a substring of text" matching by a rarest-gram index.

Used for domain rules and keyword tables of any size. Instead of a
nested-loop (theta) join, texts are indexed by their distinct grams of
``GRAM`` characters; every pattern is looked up by one of its grams only, the
one with the fewest texts, and the texts found there are verified. A pattern
shorter than a gram is its own key, and the empty pattern's key is held by
every non-empty text, so one equi-join serves all. A text holds a gram once
and a pattern has one key, so no pair is met twice.

Texts are expected to be distinct (hosts, not packets): the index has at most
three rows for every character of a distinct text, whatever the number and
the lengths of the patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import let
from ..session import scratch_table

GRAM = 3


def _grams(text: Column, n: int) -> Column:
    """All runs of ``n`` characters; none if the text is shorter."""
    def runs(chars):
        each = F.transform(F.sequence(F.lit(0), F.size(chars) - n), lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))
        return F.when(F.size(chars) >= n, each).otherwise(F.array().cast("array<string>"))
    return let(F.split(text, ""), runs)


def gram_index(texts: DataFrame, text_col: str) -> DataFrame:
    """``texts`` with a row for each distinct gram (``__gram``) of up to GRAM
    characters, and one with the empty gram."""
    t = F.col(text_col)
    sizes = F.flatten(F.array(F.array(F.lit("")), *[_grams(t, n) for n in range(1, GRAM + 1)]))
    return texts.filter(F.length(t) > 0).select("*", F.explode(F.array_distinct(sizes)).alias("__gram"))


def keyed_patterns(index: DataFrame, patterns: DataFrame, pat_col: str) -> DataFrame:
    """``patterns`` with the gram they are looked up by: the rarest of the
    index, ties by the gram itself. A pattern with a gram that no text holds
    occurs in none: most are known by their first or last gram and left out
    before all of their grams are looked up, others get a key that no text holds."""
    p = F.col(pat_col)
    held = index.filter(F.length("__gram") == GRAM).groupBy("__gram").agg(F.count(F.lit(1)).alias("__held"))
    long = patterns.filter(F.length(p) >= GRAM).select(p.alias("__pat"))
    for at in (-GRAM, 1):
        long = long.withColumn("__gram", F.substring("__pat", at, GRAM)).join(held.select("__gram"), "__gram", "left_semi").select("__pat")
    long = long.distinct()
    each = long.select("__pat", F.explode(F.array_distinct(_grams(F.col("__pat"), GRAM))).alias("__gram"))
    rarest = (each.join(held, "__gram", "left").groupBy("__pat")
              .agg(F.min(F.struct(F.coalesce("__held", F.lit(0)).alias("n"), "__gram"))["__gram"].alias("__key")))
    own = patterns.filter(F.length(p) < GRAM).select("*", p.alias("__gram"))
    return own.unionByName(patterns.join(rarest, p == F.col("__pat")).drop("__pat").withColumnRenamed("__key", "__gram"))


def substring_matches(texts: DataFrame, text_col: str,
                      patterns: DataFrame, pat_col: str) -> DataFrame:
    """All (text row, pattern row) pairs where ``pattern`` occurs in ``text``.

    Returns the columns of ``texts`` plus those of ``patterns``. An empty
    pattern matches every non-empty text; nulls match nothing. ``texts`` is
    written once, since the index is read for its counts and its postings.
    """
    index = gram_index(scratch_table(texts, "texts"), text_col)
    keyed = keyed_patterns(index, patterns, pat_col)
    return index.join(keyed, "__gram").filter(F.contains(F.col(text_col), F.col(pat_col))).drop("__gram")
