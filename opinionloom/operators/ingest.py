"""From raw columns to the standard review table, and its profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinionloom.functions.binding import pin
from opinionloom.functions.text import strip_space
from opinionloom.operators.clean import long_enough
from opinionloom.schemas import require_columns

# Source column -> standard column.
COLUMN_MAP = {
    "reviews.text": "review_text",
    "reviews.rating": "rating",
    "reviews.date": "review_date",
    "name": "product_name",
    "reviews.title": "review_title",
    "reviews.username": "reviewer",
}
NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
#: Date texts read besides the ISO forms.
DATE_FORMATS = ("MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "M/d/yyyy", "yyyy/M/d")
REQUIRED_SOURCE_COLUMNS = ("reviews.text", "reviews.rating")


def select_source_columns(df: DataFrame) -> DataFrame:
    """DQ1, PRJ1: the mapped columns that exist, under their standard names; text and rating are required."""
    require_columns(df, REQUIRED_SOURCE_COLUMNS)
    extra = ["review_id"] if "review_id" in df.columns else []
    return df.select(*extra, *(F.col(f"`{old}`").alias(new) for old, new in COLUMN_MAP.items() if old in df.columns))


def whole_rating(rating: Column) -> Column:
    """PRJ2: decimal number text with its fraction cut off; null for anything else, ``NaN`` and ``4d`` included."""
    return F.when(rating.cast("string").rlike(NUMBER), rating.cast("string").try_cast("double").try_cast("int"))


def parsed_date(date: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """PRJ3: timestamp by ISO form or the first of the further formats that fits, or null when it cannot be read."""
    return F.coalesce(F.try_to_timestamp(date), *(F.try_to_timestamp(date, F.lit(f)) for f in formats))


def coerce_columns(df: DataFrame, formats: tuple[str, ...] = DATE_FORMATS) -> DataFrame:
    df = df.withColumn("rating", whole_rating(F.col("rating")))
    if "review_date" in df.columns:
        df = df.withColumn("review_date", parsed_date(F.col("review_date").cast("string"), formats))
    return df


def with_review_id(df: DataFrame) -> DataFrame:
    """Number the rows in file order; the number is fixed by writing the stage snapshot."""
    return df if "review_id" in df.columns else df.withColumn("review_id", F.monotonically_increasing_id())


def standardize(df: DataFrame, formats: tuple[str, ...] = DATE_FORMATS) -> DataFrame:
    """JOB1: PRJ1, FLT1, PRJ2, PRJ3, PRJ4, FLT2. One narrow pass."""
    df = with_review_id(select_source_columns(df)).dropna(subset=["review_text", "rating"])
    df = coerce_columns(df, formats).dropna(subset=["rating"])
    return keep_real_text(df)


def keep_real_text(df: DataFrame) -> DataFrame:
    """PRJ4, FLT2: strip the text and keep what is longer than ten characters."""
    return pin(df, review_text=strip_space("review_text")).filter(long_enough(F.col("review_text")))


def drop_reason(df: DataFrame) -> DataFrame:
    """DQ10: mapped raw rows with the step that would drop them; null for the rows that stay."""
    df = select_source_columns(df)
    number = whole_rating(F.col("rating"))
    reason = (
        F.when(F.col("review_text").isNull() | F.col("rating").isNull(), "missing text or rating")
        .when(number.isNull(), "rating not a number")
        .when(~long_enough(strip_space("review_text")), "text too short")
    )
    return df.withColumn("drop_reason", reason)


def drop_counts(flagged: DataFrame) -> DataFrame:
    """DQ10: rows per drop reason, kept rows included, in one pass."""
    return flagged.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason")).agg(
        F.count(F.lit(1)).alias("count")
    )


def unparsed_dates(raw: DataFrame) -> DataFrame:
    """PRJ3: how many dates cannot be read (missing ones included)."""
    date = F.col("`reviews.date`")
    return raw.agg(F.count_if(parsed_date(date).isNull()).alias("invalid_dates"))


def dataset_profile(df: DataFrame) -> DataFrame:
    """AGG15: row count and date range."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.to_date(F.min("review_date")).alias("first_date"),
        F.to_date(F.max("review_date")).alias("last_date"),
    )


def null_counts(df: DataFrame) -> DataFrame:
    """AGG15: missing values per column, as rows; one pass over the table."""
    totals = df.agg(*(F.count_if(F.col(f"`{name}`").isNull()).alias(name) for name in df.columns))
    pairs = F.array(*(F.struct(F.lit(n).alias("column_name"), F.col(f"`{n}`").alias("nulls")) for n in df.columns))
    return totals.select(F.inline(pairs))


def rating_histogram(df: DataFrame, width: int = 30) -> DataFrame:
    """SRT2, AGG16: rows per rating with a bar length scaled to ``width``."""
    return value_counts(df, "rating").withColumn(
        "bar", F.floor(F.col("count") * width / F.sum("count").over(_whole_table())).cast("long")
    ).orderBy("rating")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """AGG14: rows per non-null value."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def _whole_table():
    from pyspark.sql import Window

    return Window.partitionBy()
