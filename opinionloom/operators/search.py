"""Filtered keyword search over the master table."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinionloom.functions.numeric import decimal_mean, share

RESULT_LIMIT = 500

# Result column -> heading.
HEADINGS = {
    "rating": "Rating",
    "model_label": "Sentiment",
    "vader_score": "Lexicon score",
    "topic_label": "Topic",
    "product_name": "Product",
    "review_text": "Review",
}


def keyword(term: str, literal: bool = False) -> Column:
    """FLT11: case-insensitive pattern on the raw text; null text does not match."""
    pattern = re.escape(term.strip()) if literal else term.strip()
    return F.coalesce(F.col("review_text").rlike("(?iU)" + pattern), F.lit(False))


def search(
    df: DataFrame,
    topics: Sequence[str] = (),
    sentiments: Sequence[str] = (),
    ratings: Sequence[int] = (),
    term: str = "",
    literal: bool = False,
) -> DataFrame:
    """FLT8 to FLT13: an empty selection or a blank term does not filter; the pattern is tested last."""
    wanted = {"topic_label": topics, "model_label": sentiments, "rating": ratings}
    tests = [F.col(column).isin(list(values)) for column, values in wanted.items() if len(values)]
    if term.strip():
        tests.append(keyword(term, literal))
    return df.filter(reduce(and_, tests)) if tests else df


def search_summary(hits: DataFrame) -> DataFrame:
    """AGG18: number of hits and their means; the means are null when nothing matched."""
    return hits.agg(
        F.count(F.lit(1)).alias("matching"),
        F.bround(F.avg("rating"), 2).alias("avg_rating"),
        F.bround(share(F.col("model_label") == "positive") * 100, 1).alias("pct_positive"),
        F.bround(decimal_mean(F.col("vader_score"), 4), 3).alias("avg_score"),
    )


def search_results(hits: DataFrame, limit: int | None = RESULT_LIMIT, friendly: bool = False) -> DataFrame:
    """LIM1, PRJ13: the first hits by review id (all with ``limit=None``), display columns that exist."""
    shown = [name for name in HEADINGS if name in hits.columns]
    first = hits if limit is None else hits.orderBy("review_id").limit(limit)
    if friendly:
        return first.select(*(F.col(name).alias(HEADINGS[name]) for name in shown))
    return first.select("review_id", *shown)
