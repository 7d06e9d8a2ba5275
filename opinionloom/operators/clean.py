"""Cleaning of a review table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinionloom.functions.binding import pin
from opinionloom.functions.text import clean_text
from opinionloom.schemas import require_columns

MIN_CLEAN_CHARS = 10


def long_enough(text: Column, chars: int = MIN_CLEAN_CHARS) -> Column:
    """FLT2, FLT3: more than ``chars`` characters."""
    return F.length(text) > chars


def clean_reviews(df: DataFrame, text_col: str = "review_text") -> DataFrame:
    """NLP1: add ``review_clean`` and keep the rows with more than ten characters left."""
    require_columns(df, [text_col])
    return pin(df, review_clean=clean_text(text_col)).filter(long_enough(F.col("review_clean")))
