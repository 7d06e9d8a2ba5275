"""Data-quality audit of the master table: every check from one aggregation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinionloom.functions import labels
from opinionloom.functions.lookups import lookup_join
from opinionloom.functions.numeric import decimal_mean
from opinionloom.operators.agreement import binary_agreement
from opinionloom.operators.clean import MIN_CLEAN_CHARS
from opinionloom.operators.tokens import MIN_TOKENS
from opinionloom.session import written

SENTIMENTS = (labels.POSITIVE, labels.NEUTRAL, labels.NEGATIVE)
BINARY = (labels.POSITIVE, labels.NEGATIVE)


def _outside(column: str, allowed: Iterable[str]):
    return F.count_if(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))


def audit(df: DataFrame, num_topics: int = 8, coherence: float | None = None) -> DataFrame:
    """DQ2 to DQ9, DQ11: ``(check_id, metric, value, passed)``; checks on absent columns are left out."""
    rating, topic = F.col("rating"), F.col("dominant_topic")
    per_topic = [F.count_if(topic == t) for t in range(num_topics)]
    unused = sum((F.when(n == 0, 1).otherwise(0) for n in per_topic), F.lit(0))
    rows = F.count(F.lit(1))
    # check, metric, columns needed, value, test on the value
    checks = [
        ("DQ2", "null_text", {"review_text"}, F.count_if(F.col("review_text").isNull()), lambda v: v == 0),
        ("DQ2", "null_rating", {"rating"}, F.count_if(rating.isNull()), lambda v: v == 0),
        ("DQ3", "rating_outside_1_5", {"rating"}, F.count_if(~rating.between(1, 5)), lambda v: v == 0),
        ("DQ3", "distinct_ratings", {"rating"}, F.countDistinct("rating"), lambda v: v >= 3),
        ("DQ4", "short_text", {"review_text"}, F.count_if(F.length("review_text") <= MIN_CLEAN_CHARS), lambda v: v == 0),
        ("DQ4", "few_tokens", {"token_count"}, F.count_if(F.col("token_count") < MIN_TOKENS), lambda v: v == 0),
        ("DQ4", "mean_tokens", {"token_count"}, F.avg("token_count"), lambda v: v >= 5),
        ("DQ5", "unknown_vader_label", {"vader_label"}, _outside("vader_label", SENTIMENTS), lambda v: v == 0),
        ("DQ5", "unknown_model_label", {"model_label"}, _outside("model_label", BINARY), lambda v: v == 0),
        ("DQ6", "min_vader_score", {"vader_score"}, F.min("vader_score"), lambda v: v >= -1),
        ("DQ6", "max_vader_score", {"vader_score"}, F.max("vader_score"), lambda v: v <= 1),
        ("DQ6", "min_confidence", {"model_confidence"}, F.min("model_confidence"), lambda v: v >= 0),
        ("DQ6", "max_confidence", {"model_confidence"}, F.max("model_confidence"), lambda v: v <= 1),
        ("DQ6", "mean_confidence", {"model_confidence"}, decimal_mean(F.col("model_confidence"), 4), lambda v: v > 0.7),
        ("DQ6", "min_topic_score", {"topic_score"}, F.min("topic_score"), lambda v: v >= 0),
        ("DQ6", "max_topic_score", {"topic_score"}, F.max("topic_score"), lambda v: v <= 1),
        ("DQ6", "mean_topic_score", {"topic_score"}, decimal_mean(F.col("topic_score"), 4), lambda v: v > 0.1),
        ("DQ7", "lexicon_agreement", {"vader_label", "rating"}, binary_agreement("vader_label"), lambda v: v > 0.6),
        ("DQ7", "model_agreement", {"model_label", "rating"}, binary_agreement("model_label"), lambda v: v > 0.75),
        ("DQ8", "topic_out_of_range", {"dominant_topic"}, F.count_if(~topic.between(0, num_topics - 1)), lambda v: v == 0),
        ("DQ8", "unused_topics", {"dominant_topic"}, unused, lambda v: v <= 1),
        ("DQ8", "largest_topic_share", {"dominant_topic"}, F.greatest(F.lit(0), *per_topic) / rows, lambda v: v < 0.7),
        ("DQ8", "empty_topic_label", {"topic_label"}, _empty("topic_label"), lambda v: v == 0),
        ("DQ8", "empty_keywords", {"topic_keywords"}, _empty("topic_keywords"), lambda v: v == 0),
        ("DQ9", "rows", set(), rows, lambda v: v >= 1_000),
    ]
    present = set(df.columns)
    used = [c for c in checks if c[2] <= present]
    totals = df.agg(*(value.cast("double").alias(metric) for _, metric, _, value, _ in used))
    lines = [
        F.struct(
            F.lit(check).alias("check_id"), F.lit(metric).alias("metric"), F.col(metric).alias("value"),
            F.coalesce(test(F.col(metric)), F.lit(False)).alias("passed"),
        )
        for check, metric, _, _, test in used
    ]
    if coherence is not None:
        lines.append(
            F.struct(
                F.lit("DQ11").alias("check_id"), F.lit("coherence").alias("metric"),
                F.lit(float(coherence)).alias("value"), F.lit(coherence > 0.2).alias("passed"),
            )
        )
    return totals.select(F.inline(F.array(*lines)))


def _empty(column: str):
    return F.count_if(F.btrim(F.coalesce(F.col(column), F.lit(""))) == "")


def values_outside(df: DataFrame, column: str, allowed: DataFrame) -> DataFrame:
    """SET3: values that occur but are not allowed; ``allowed`` has the same single column."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().join(allowed, column, "left_anti")


def values_missing(df: DataFrame, column: str, expected: DataFrame) -> DataFrame:
    """SET3: expected values that never occur."""
    # only values on the list are shuffled, once a task and value
    expected = written(expected.select(column), "expected-values")
    found = lookup_join(df.select(column), expected.distinct(), column, "left_semi").distinct()
    return expected.join(found, column, "left_anti")
