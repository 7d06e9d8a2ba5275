"""Lemma rules mined from the vocabulary of a corpus.

A rule replaces a suffix by an ending, as ``ies`` by ``y``. It is supported by every word whose stem is also a word of the corpus
with that ending, and is kept if enough words support it, and enough of those with its suffix. A word takes the
rule of its longest suffix whose result is a word of the corpus; words without one are their own lemma.

All of it are joins on words: no stem's words are paired with each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_SUFFIX = 4
MIN_STEM = 3
#: Endings of base forms.
ENDINGS = ("", "e", "y")
MIN_SUPPORT = 20
MIN_PERCENT = 10
MAX_RULES = 200


def word_counts(df: DataFrame, tokens_col: str = "words") -> DataFrame:
    """Rows ``(term, n)``."""
    return df.select(F.explode(tokens_col).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def splits(vocabulary: DataFrame, max_suffix: int = MAX_SUFFIX, min_stem: int = MIN_STEM) -> DataFrame:
    """Rows ``(term, stem, suffix)`` for every suffix that leaves a stem."""
    longest = F.least(F.lit(max_suffix), F.length("term") - min_stem)
    sizes = vocabulary.filter(F.length("term") > min_stem).select("term", F.explode(F.sequence(F.lit(1), longest)).alias("k"))
    return sizes.select("term", F.expr("left(term, length(term) - k)").alias("stem"), F.expr("right(term, k)").alias("suffix"))


def lemma_rules(
    vocabulary: DataFrame,
    endings: Sequence[str] = ENDINGS,
    max_suffix: int = MAX_SUFFIX,
    min_stem: int = MIN_STEM,
    min_support: int = MIN_SUPPORT,
    min_percent: int = MIN_PERCENT,
    max_rules: int = MAX_RULES,
) -> DataFrame:
    """Rows ``(suffix, ending, support, total)``: the ``max_rules`` rules most words support, of those that pass the limits."""
    parts = splits(vocabulary, max_suffix, min_stem)
    totals = parts.groupBy("suffix").agg(F.count(F.lit(1)).alias("total"))
    bases = (
        parts.select("stem", "suffix", F.explode(F.array(*map(F.lit, endings))).alias("ending"))
        .filter("suffix != ending")
        .select("suffix", "ending", F.concat("stem", "ending").alias("term"))
    )
    support = bases.join(vocabulary.select("term"), "term").groupBy("suffix", "ending").agg(F.count(F.lit(1)).alias("support"))
    return (
        support.filter(F.col("support") >= min_support)
        .join(totals, "suffix")
        .filter(F.col("support") * 100 >= F.col("total") * min_percent)
        .orderBy(F.desc("support"), "suffix", "ending")
        .limit(max_rules)
        .select("suffix", "ending", "support", "total")
    )


def lemma_table(vocabulary: DataFrame, rules: DataFrame, max_suffix: int = MAX_SUFFIX, min_stem: int = MIN_STEM) -> DataFrame:
    """Rows ``(form, lemma)`` for the words that a rule leads to another word: that of the longest suffix, among equals the
    one with the most support. The rules are broadcast; ``max_rules`` bounds them."""
    bases = splits(vocabulary, max_suffix, min_stem).join(F.broadcast(rules), "suffix").select(
        F.col("term").alias("form"), F.concat("stem", "ending").alias("term"), F.length("suffix").alias("size"), "support", "ending"
    )
    order = F.struct((-F.col("size")).alias("a"), (-F.col("support")).alias("b"), F.col("ending").alias("c"))
    known = bases.join(vocabulary.select("term"), "term")
    return known.groupBy("form").agg(F.min_by("term", order).alias("lemma"))
