"""Column lists and DDL of every stage, and the check that a table fits its stage."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

REVIEWS_RAW = (
    "review_id bigint, review_text string, rating int, review_date timestamp, "
    "product_name string, review_title string, reviewer string"
)
REVIEWS_PROCESSED = REVIEWS_RAW + (
    ", review_clean string, review_normalized string, tokens array<string>, token_count int"
)
REVIEWS_SENTIMENT = REVIEWS_PROCESSED + (
    ", star_sentiment string, vader_score double, vader_label string, "
    "model_label string, model_confidence double, sentiment_agree boolean"
)
REVIEWS_TOPICS = REVIEWS_SENTIMENT + (
    ", dominant_topic int, topic_label string, topic_score double, topic_keywords string"
)

STAGES = {
    "raw": REVIEWS_RAW,
    "processed": REVIEWS_PROCESSED,
    "sentiment": REVIEWS_SENTIMENT,
    "topics": REVIEWS_TOPICS,
}

LEXICON = "term string, valence_tenths int"
BOOSTERS = "term string, step_thousandths int"
NEGATORS = "term string"
LEMMAS = "form string, lemma string"


def stage_schema(stage: str) -> T.StructType:
    return T.StructType.fromDDL(STAGES[stage])


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    """Required names the table lacks, in the order asked for."""
    present = set(df.columns)
    return [name for name in required if name not in present]


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """DQ1: pass ``df`` through, or fail with the missing and the available names."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing columns {missing}; available columns {df.columns}")
    return df


def schema_differences(df: DataFrame, stage: str, optional: Iterable[str] = ()) -> list[str]:
    """Human-readable differences between a table and the schema of its stage; empty when it fits."""
    skip = set(optional)
    actual = {f.name: f.dataType for f in df.schema.fields}
    found = []
    for field in stage_schema(stage).fields:
        if field.name not in actual:
            if field.name not in skip:
                found.append(f"{field.name}: missing")
        elif actual[field.name].simpleString() != field.dataType.simpleString():
            found.append(f"{field.name}: {actual[field.name].simpleString()}, not {field.dataType.simpleString()}")
    return found
