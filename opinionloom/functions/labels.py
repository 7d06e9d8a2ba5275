"""Label and band columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POSITIVE = "positive"
NEGATIVE = "negative"
NEUTRAL = "neutral"
MIXED = "mixed"


def star_sentiment(rating: Column) -> Column:
    """PRJ5: 4 stars and up positive, 2 and below negative, else neutral."""
    return F.when(rating >= 4, POSITIVE).when(rating <= 2, NEGATIVE).otherwise(NEUTRAL)


def star_binary(rating: Column) -> Column:
    """PRJ6: positive or negative; null for the 3-star rows the binary comparison leaves out."""
    return F.when(rating >= 4, POSITIVE).when(rating != 3, NEGATIVE)


def score_label(score: Column, threshold: float = 0.05) -> Column:
    """PRJ8: inclusive thresholds on the score as the scorer returns it."""
    return F.when(score >= threshold, POSITIVE).when(score <= -threshold, NEGATIVE).otherwise(NEUTRAL)


def labels_agree(left: Column, right: Column) -> Column:
    """PRJ7: equal labels; a null on either side is a disagreement."""
    return F.coalesce(left == right, F.lit(False))


def share_band(fraction: Column) -> Column:
    """PRJ9: majority label of a positive fraction."""
    return F.when(fraction >= 0.6, POSITIVE).when(fraction <= 0.4, NEGATIVE).otherwise(MIXED)


def rating_band(avg_rating: Column) -> Column:
    """PRJ10: colour band of a mean rating."""
    return F.when(avg_rating >= 4, POSITIVE).when(avg_rating >= 3, MIXED).otherwise(NEGATIVE)


def pretty_label(label: Column) -> Column:
    """PRJ14: ``battery_value`` -> ``Battery Value``."""
    return F.initcap(F.replace(label, F.lit("_"), F.lit(" ")))


def topic_label_or_default(label: Column, topic: Column) -> Column:
    """PRJ16: the given label, or ``topic_<id>``."""
    return F.coalesce(label, F.concat(F.lit("topic_"), topic.cast("string")))


def preview(text: Column, width: int = 120) -> Column:
    """PRJ15: first ``width`` characters on one line."""
    return F.replace(F.substring(text, 1, width), F.lit("\n"), F.lit(" "))
