"""Stage jobs: each reads a snapshot, extends it and writes the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionloom.operators import agreement, aggregates, classify, clean, coherence, ingest, lexicon, sampling, tokens, topics
from opinionloom.schemas import require_columns
from opinionloom.sinks.tables import sentiment_report, topic_report, write_report, write_snapshot
from opinionloom.sources.csv_files import MIN_FILE_BYTES, all_csv, read_reviews_csv, validated_csv
from opinionloom.sources.snapshots import read_first_snapshot, read_snapshot


def ingest_job(
    spark: SparkSession,
    folder: str,
    output: str,
    min_bytes: int = MIN_FILE_BYTES,
    every_file: bool = False,
    formats: tuple[str, ...] = ingest.DATE_FORMATS,
) -> DataFrame:
    """JOB2: the largest CSV of a folder, or all of its files, standardized and written.

    Files of a data set must have the same columns. The profile is taken from the written table.
    """
    path = all_csv(spark, folder, min_bytes) if every_file else validated_csv(spark, folder, min_bytes)
    raw = require_columns(read_reviews_csv(spark, path), ingest.REQUIRED_SOURCE_COLUMNS)
    return write_snapshot(ingest.standardize(raw, formats), output)


def preprocess(df: DataFrame, sample_rows: int | None = None, **words) -> DataFrame:
    """SMP1, NLP1, NLP2. The whole table, or a stratified sample of ``sample_rows``."""
    if sample_rows is not None:
        df = sampling.stratified_sample(df, sample_rows)
    return df.transform(clean.clean_reviews).transform(tokens.normalize_reviews, **words)


def preprocess_job(spark: SparkSession, source: str, output: str, **options) -> DataFrame:
    """JOB3."""
    return write_snapshot(preprocess(read_snapshot(spark, source), **options), output)


def sentiment_job(
    spark: SparkSession, source: str, output: str, report: str, words: lexicon.Lexicon | None = None
) -> DataFrame:
    """SEN3: star label, lexicon score, classifier, agreement flag, snapshot, report.

    The report reads the written table, so nothing is computed twice and no cache has to survive an executor.
    """
    reviews = agreement.add_star_sentiment(read_snapshot(spark, source))
    model = classify.fit_word_odds(reviews)
    scored = (
        reviews.transform(lexicon.score_reviews, lexicon=words)
        .transform(classify.score_by_words, model)
        .transform(agreement.add_agreement_flag)
    )
    written = write_snapshot(scored, output)
    write_report(sentiment_report(written), report)
    return written


def topic_job(
    spark: SparkSession,
    sources: tuple[str, ...],
    output: str,
    report: str,
    model_folder: str,
    labels: DataFrame | None = None,
    **options,
) -> tuple[DataFrame, float]:
    """LDA7: load or train, measure coherence, assign, write the master table and the topic report."""
    reviews = topics.topic_input(read_first_snapshot(spark, *sources))
    model = topics.load_or_fit(reviews, model_folder, **options)
    keywords = topics.topic_keywords(spark, model, coherence.TOP_WORDS)
    leading = keywords.select(F.col("dominant_topic").alias("topic"), "term")
    score = coherence.mean_coherence(coherence.topic_coherence(reviews, leading)).first()["coherence"]
    master = write_snapshot(topics.assign_topics(reviews, model, labels).drop("topic_tokens"), output)
    write_report(topic_report(master, keywords.filter(F.col("rank") <= 12)), report)
    return master, score


def prepared_tables(master: DataFrame) -> dict[str, DataFrame]:
    """JOB4: the eight prepared tables by name, all lazy."""
    return {
        "sentiment_dist": aggregates.sentiment_distribution(master),
        "rating_dist": aggregates.rating_profile(master),
        "monthly": aggregates.monthly_trend(master),
        "topic_dist": aggregates.topic_profile(master),
        "topic_heatmap": aggregates.topic_hotspots(master),
        "avg_rating": aggregates.topic_rating_ci(master),
        "vader_scores": aggregates.score_rows(master),
        "wc_tokens": aggregates.topic_term_weights(master),
    }


def kpis_with_coherence(master: DataFrame, coherence_score: float) -> DataFrame:
    """AGG8 with the measured coherence."""
    return aggregates.kpis(master).withColumn("coherence", F.lit(float(coherence_score)))
