"""Snapshots, reports and chart tables."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinionloom.functions import labels
from opinionloom.functions.numeric import share
from opinionloom.operators import aggregates
from opinionloom.operators.agreement import binary_agreement

#: Chart tables with a row per review; the others have a row per group.
ROW_TABLES = ("vader_scores",)


def write_snapshot(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """SNK1: write a stage as Parquet and continue from the written table."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """Reports are a few rows; one JSON file is what a reader wants."""
    report.coalesce(1).write.mode("overwrite").json(path)


def sentiment_report(df: DataFrame) -> DataFrame:
    """SNK2: ``(section, metric, value)`` from one pass over the sentiment table."""
    three = labels.star_sentiment(F.col("rating"))
    figures = [
        ("overall", "total", F.count(F.lit(1))),
        *((aggregates.LEXICON_MODEL, n, F.count_if(F.col("vader_label") == n)) for n in (
            labels.POSITIVE, labels.NEUTRAL, labels.NEGATIVE)),
        (aggregates.LEXICON_MODEL, "agreement", share(F.col("vader_label") == three)),
        *((aggregates.CLASSIFIER_MODEL, n, F.count_if(F.col("model_label") == n)) for n in (
            labels.POSITIVE, labels.NEGATIVE)),
        (aggregates.CLASSIFIER_MODEL, "agreement", binary_agreement("model_label")),
        ("comparison", "agreement", share(F.col("vader_label") == F.col("model_label"))),
    ]
    if "model_confidence" in df.columns:
        figures.append((aggregates.CLASSIFIER_MODEL, "confidence", F.avg("model_confidence")))
    totals = df.agg(*(value.cast("double").alias(f"{section}_{metric}") for section, metric, value in figures))
    lines = [
        F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"), F.col(f"{s}_{m}").alias("value"))
        for s, m, _ in figures
    ]
    gain = F.col("classifier_agreement") - F.col("lexicon_agreement")
    lines.append(F.struct(F.lit("comparison").alias("section"), F.lit("gain").alias("metric"), gain.alias("value")))
    return totals.select(F.inline(F.array(*lines)))


def report_text(report: DataFrame) -> DataFrame:
    """STR15: report lines with counts grouped in thousands and rates as percentages."""
    rate = F.col("metric").isin("agreement", "gain")
    shown = (
        F.when(rate, F.format_string("%.1f%%", F.col("value") * 100))
        .when(F.col("metric") == "confidence", F.format_string("%.3f", F.col("value")))
        .otherwise(F.format_number("value", 0))
    )
    return report.select("section", "metric", shown.alias("shown"))


def topic_report(df: DataFrame, keywords: DataFrame | None = None) -> DataFrame:
    """SNK3: one row per topic with size, share, ratings, best examples and, where given, weighted keywords."""
    label = df.groupBy("dominant_topic").agg(F.min("topic_label").alias("topic_label"))
    examples = aggregates.topic_examples(df).groupBy("dominant_topic").agg(
        F.sort_array(F.collect_list(F.struct("rank", "rating", "topic_score", "preview"))).alias("examples")
    )
    report = aggregates.topic_blocks(df).join(label, "dominant_topic").join(examples, "dominant_topic")
    if keywords is not None:
        words = keywords.groupBy("dominant_topic").agg(
            F.array_join(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("rank", "term", "weight"))),
                    lambda w: F.format_string("%s(%.3f)", w["term"], w["weight"]),
                ),
                " | ",
            ).alias("keywords")
        )
        report = report.join(words, "dominant_topic", "left")
    return report.orderBy("dominant_topic")


def write_chart_tables(tables: Mapping[str, DataFrame], folder: str, as_parquet: Collection[str] = ROW_TABLES) -> list[str]:
    """SNK5: one folder per prepared table: Parquet with the partitioning they have for the tables named, one JSON file for the
    others, whatever their size."""
    written = []
    for name, table in tables.items():
        path = f"{folder}/{name}"
        if name in as_parquet:
            table.write.mode("overwrite").parquet(path)
        else:
            write_report(table, path)
        written.append(path)
    return written
