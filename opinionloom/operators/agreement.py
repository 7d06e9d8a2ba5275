"""Star labels and agreement rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinionloom.functions import labels
from opinionloom.functions.numeric import share


def add_star_sentiment(df: DataFrame) -> DataFrame:
    """PRJ5."""
    return df.withColumn("star_sentiment", labels.star_sentiment(F.col("rating")))


def add_agreement_flag(df: DataFrame) -> DataFrame:
    """PRJ7: a neutral lexicon label always counts as a disagreement."""
    return df.withColumn("sentiment_agree", labels.labels_agree(F.col("vader_label"), F.col("model_label")))


def binary_agreement(label: str):
    """Share of agreement with the binary star label; 3-star rows stay outside the denominator."""
    star = labels.star_binary(F.col("rating"))
    agree = F.when(labels.labels_agree(F.col(label), star), 1.0).otherwise(0.0)
    return F.avg(F.when(F.col("rating") != 3, agree))


def lexicon_vs_stars(df: DataFrame) -> DataFrame:
    """AGG11: three-way agreement over all rows."""
    star = labels.star_sentiment(F.col("rating"))
    return df.agg(share(F.col("vader_label") == star).alias("lexicon_agreement"))


def model_vs_stars(df: DataFrame) -> DataFrame:
    """AGG12: binary agreement, 3-star rows left out."""
    return df.agg(binary_agreement("model_label").alias("model_agreement"))


def agreement_report(df: DataFrame) -> DataFrame:
    """AGG11, AGG12, AGG13 in one pass.

    The three-way and the binary rate have different denominators; ``lexicon_binary`` is the lexicon rate that can
    be compared with ``model_binary``.
    """
    star = labels.star_sentiment(F.col("rating"))
    rates = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("rating") != 3).alias("n_binary"),
        share(F.col("vader_label") == star).alias("lexicon_three_way"),
        binary_agreement("vader_label").alias("lexicon_binary"),
        binary_agreement("model_label").alias("model_binary"),
        share(F.col("vader_label") == F.col("model_label")).alias("lexicon_vs_model"),
    )
    return rates.withColumn("model_gain", F.col("model_binary") - F.col("lexicon_three_way"))
