"""Prepared aggregates over the master table.

Each function returns a lazy plan. Group keys are pre-aggregated before they are shuffled, so a rating or a topic that
holds most of the rows costs no more than the others; window functions run on aggregated rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinionloom.functions import labels
from opinionloom.functions.lookups import lookup_join
from opinionloom.functions.numeric import decimal_mean, percent, sample_stddev, share
from opinionloom.session import written

LEXICON_MODEL = "lexicon"
CLASSIFIER_MODEL = "classifier"
MIN_MONTH_REVIEWS = 5
HISTOGRAM_BINS = 40
CLOUD_TERMS = 80
EXAMPLES_PER_TOPIC = 3


def _count():
    return F.count(F.lit(1))


def sentiment_distribution(df: DataFrame) -> DataFrame:
    """AGG1, SET1, PRJ17: rows per label and model, both models in one pass over the table."""
    pairs = F.array(
        F.struct(F.lit(LEXICON_MODEL).alias("model"), F.col("vader_label").alias("label")),
        F.struct(F.lit(CLASSIFIER_MODEL).alias("model"), F.col("model_label").alias("label")),
    )
    counted = df.select(F.inline(pairs)).filter(F.col("label").isNotNull()).groupBy("label", "model")
    return counted.agg(_count().alias("count")).orderBy("model", F.desc("count"), "label")


def sentiment_share(df: DataFrame) -> DataFrame:
    """AGG2, WIN2: label counts with their share of the model's rows."""
    total = F.sum("count").over(Window.partitionBy("model"))
    return sentiment_distribution(df).withColumn("share", F.col("count") / total)


def label_counts(df: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
    """AGG14: one row with a count per label of the domain, zero where a label does not occur."""
    return df.agg(*(F.count_if(F.col(column) == label).alias(label) for label in domain))


def rating_profile(df: DataFrame) -> DataFrame:
    """AGG3, PRJ9: count, mean lexicon score, positive fraction and majority band per rating."""
    profile = df.filter(F.col("rating").isNotNull()).groupBy("rating").agg(
        _count().alias("count"),
        decimal_mean(F.col("vader_score"), 4).alias("avg_vader"),
        share(F.col("model_label") == labels.POSITIVE).alias("pct_positive"),
    )
    return profile.withColumn("sentiment", labels.share_band(F.col("pct_positive"))).orderBy("rating")


def monthly_trend(df: DataFrame, min_reviews: int = MIN_MONTH_REVIEWS) -> DataFrame:
    """AGG4, FLT7, PRJ11, WIN2: reviews per month and label, months with fewer than five labelled reviews left out."""
    dated = df.filter(F.col("review_date").isNotNull() & F.col("model_label").isNotNull())
    monthly = dated.groupBy(F.date_trunc("month", "review_date").alias("month"), "model_label").agg(
        _count().alias("count")
    )
    total = F.sum("count").over(Window.partitionBy("month"))
    return (
        monthly.withColumn("_total", total)
        .filter(F.col("_total") >= min_reviews)
        .drop("_total")
        .orderBy("month", "model_label")
    )


def topic_profile(df: DataFrame) -> DataFrame:
    """AGG5: size, mean rating and label percentages per topic, smallest topic first."""
    known = df.filter(F.col("dominant_topic").isNotNull() & F.col("topic_label").isNotNull())
    return (
        known.groupBy("dominant_topic", "topic_label")
        .agg(
            _count().alias("count"),
            F.bround(F.avg("rating"), 2).alias("avg_rating"),
            F.bround(share(F.col("model_label") == labels.POSITIVE) * 100, 1).alias("pct_positive"),
            F.bround(share(F.col("model_label") == labels.NEGATIVE) * 100, 1).alias("pct_negative"),
        )
        .orderBy("count", "dominant_topic")
    )


def topic_hotspots(df: DataFrame) -> DataFrame:
    """AGG6: positive and negative rows per topic, most negative topic first."""
    known = df.filter(F.col("topic_label").isNotNull() & F.col("model_label").isNotNull())
    # Conditional counts give the pivoted columns, absent labels as zero, in a single shuffle.
    counted = known.groupBy("topic_label").agg(
        *(F.count_if(F.col("model_label") == label).alias(label) for label in (labels.NEGATIVE, labels.POSITIVE))
    )
    total = F.col(labels.POSITIVE) + F.col(labels.NEGATIVE)
    return (
        counted.withColumn("total", total)
        .withColumn("pct_negative", percent(F.col(labels.NEGATIVE), F.col("total")))
        .withColumn("pct_positive", percent(F.col(labels.POSITIVE), F.col("total")))
        .orderBy(F.desc("pct_negative"), "topic_label")
    )


def topic_rating_ci(df: DataFrame) -> DataFrame:
    """AGG7, PRJ10: mean rating per topic with its 95 % interval, best topic first."""
    known = df.filter(F.col("topic_label").isNotNull())
    stats = known.groupBy("topic_label").agg(
        F.avg("rating").alias("_mean"), sample_stddev(F.col("rating")).alias("std_rating"), F.count("rating").alias("n")
    )
    return (
        stats.withColumn("avg_rating", F.bround("_mean", 3))
        .withColumn("ci", F.bround(F.col("std_rating") * 1.96 / F.sqrt("n"), 3))
        .withColumn("band", labels.rating_band(F.col("avg_rating")))
        .select("topic_label", "avg_rating", "std_rating", "n", "ci", "band")
        .orderBy(F.desc("avg_rating"), "topic_label")
    )


def kpis(df: DataFrame, approximate_topics: bool = False) -> DataFrame:
    """AGG8, AGG23: headline figures in one pass. Coherence is a measured value; the caller adds it."""
    from opinionloom.operators.agreement import binary_agreement

    topics = F.approx_count_distinct("dominant_topic") if approximate_topics else F.countDistinct("dominant_topic")
    return df.agg(
        _count().alias("total"),
        F.bround(share(F.col("model_label") == labels.POSITIVE) * 100, 1).alias("pct_positive"),
        F.bround(F.avg("rating"), 2).alias("avg_rating"),
        topics.alias("num_topics"),
        F.bround(share(F.col("vader_label") == F.col("model_label")) * 100, 1).alias("model_agree"),
        F.bround(binary_agreement("vader_label") * 100, 1).alias("vader_agree"),
        F.bround(binary_agreement("model_label") * 100, 1).alias("model_binary_agree"),
    )


def topic_blocks(df: DataFrame) -> DataFrame:
    """AGG9: size, share of the corpus and rating histogram (a map) per topic."""
    cells = df.filter(F.col("dominant_topic").isNotNull()).groupBy("dominant_topic", "rating").agg(_count().alias("n"))
    blocks = cells.groupBy("dominant_topic").agg(
        F.sum("n").alias("count"),
        F.map_from_entries(
            F.sort_array(F.collect_list(F.when(F.col("rating").isNotNull(), F.struct("rating", "n"))))
        ).alias("ratings"),
    )
    total = F.sum("count").over(Window.partitionBy())
    return blocks.withColumn("pct_corpus", F.bround(F.col("count") / total * 100, 1)).orderBy("dominant_topic")


def topic_listing(df: DataFrame, width: int = 25) -> DataFrame:
    """AGG10, AGG16: rows, bar length and mean rating per topic, by topic id."""
    counted = df.filter(F.col("dominant_topic").isNotNull()).groupBy("dominant_topic").agg(
        _count().alias("count"), F.bround(F.avg("rating"), 2).alias("avg_rating")
    )
    total = F.sum("count").over(Window.partitionBy())
    return counted.withColumn("bar", F.floor(F.col("count") * width / total).cast("long")).orderBy("dominant_topic")


def topic_examples(df: DataFrame, n: int = EXAMPLES_PER_TOPIC) -> DataFrame:
    """TOPK1, WIN1, PRJ15: best-scored reviews per topic, earlier review first on a tie.

    Only the preview travels; each task forwards its own best ``n`` rows per topic, so a huge topic is never sorted
    in one place.
    """
    best = Window.partitionBy("dominant_topic").orderBy(F.desc("topic_score"), "review_id")
    narrow = df.filter(F.col("dominant_topic").isNotNull()).select(
        "dominant_topic", "review_id", "rating", "topic_score", labels.preview(F.col("review_text")).alias("preview")
    )
    return narrow.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


def _term_sources(known: DataFrame):
    """Own tokens of a review, and the words of its normalized text as a substitute."""
    own = F.expr("filter(coalesce(tokens, array()), t -> t IS NOT NULL AND t != '')")
    if "review_normalized" not in known.columns:
        return own, F.expr("cast(array() AS array<string>)")
    return own, F.expr("filter(split(coalesce(review_normalized, ''), ' +'), t -> t != '')")


def counted_terms(df: DataFrame) -> DataFrame:
    """Per topic and term: occurrences as own token, and as own token or substitute."""
    known = df.filter(F.col("topic_label").isNotNull())
    own, spare = _term_sources(known)
    # The flag is settled per review, before the words are spread out.
    reviews = known.select(
        "topic_label", (F.size(own) > 0).alias("is_own"), F.when(F.size(own) > 0, own).otherwise(spare).alias("words")
    )
    words = reviews.select("topic_label", "is_own", F.explode("words").alias("term"))
    return words.groupBy("topic_label", "term").agg(F.count_if("is_own").alias("own"), _count().alias("all"))


def topic_terms(df: DataFrame) -> DataFrame:
    """AGG20, UDF6: how often each token occurs per topic.

    A topic whose token lists are all empty falls back to the words of ``review_normalized``.
    """
    counted = written(counted_terms(df), "topic-terms")
    has_own = counted.groupBy("topic_label").agg((F.max("own") > 0).alias("has_own"))
    return (
        lookup_join(counted, has_own, "topic_label", "inner")
        .withColumn("count", F.when(F.col("has_own"), F.col("own")).otherwise(F.col("all")))
        .filter(F.col("count") > 0)
        .select("topic_label", "term", "count")
    )


def topic_term_weights(df: DataFrame, n: int = CLOUD_TERMS) -> DataFrame:
    """AGG21, TOPK3: the most frequent terms per topic, weighted relative to the topic's top term.

    Own tokens rank before substitutes, so the first ``n`` rows per topic settle both which terms lead and whether
    the topic has own tokens at all. Each task forwards its own first ``n`` rows per topic.
    """
    return term_weights(counted_terms(df), n)


def term_weights(counted: DataFrame, n: int = CLOUD_TERMS) -> DataFrame:
    """AGG21 from counts per topic and term."""
    topic = Window.partitionBy("topic_label")
    substitute = F.when(F.col("own") > 0, 0).otherwise(F.col("all"))
    order = topic.orderBy(F.desc("own"), substitute.desc(), "term")
    leading = counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    counted = leading.withColumn("has_own", F.max("own").over(topic) > 0).withColumn(
        "count", F.when(F.col("has_own"), F.col("own")).otherwise(F.col("all"))
    )
    return (
        counted.filter(F.col("count") > 0)
        .withColumn("weight", F.col("count") / F.max("count").over(topic))
        .select("topic_label", "term", "count", "rank", "weight")
    )


def top_terms(counted: DataFrame, n: int) -> DataFrame:
    """TOPK3: first ``n`` terms per topic by count, then by term."""
    order = Window.partitionBy("topic_label").orderBy(F.desc("count"), "term")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def score_rows(df: DataFrame) -> DataFrame:
    """PRJ12."""
    return df.select("vader_score", "model_label", "rating")


def score_histogram(df: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """AGG22: lexicon scores per label in equal bins over [-1, 1]; a score of exactly 1 is in the last bin."""
    slot = F.least(F.width_bucket("vader_score", F.lit(-1.0), F.lit(1.0), F.lit(bins)), F.lit(bins))
    known = df.filter(F.col("model_label").isNotNull() & F.col("vader_score").isNotNull())
    return known.groupBy("model_label", slot.cast("int").alias("bin")).agg(_count().alias("count"))


def topic_list(df: DataFrame) -> DataFrame:
    """AGG24, PRJ14: distinct topics in order, with their display names."""
    known = df.filter(F.col("topic_label").isNotNull()).select("topic_label").distinct()
    return known.withColumn("display_name", labels.pretty_label(F.col("topic_label"))).orderBy("topic_label")


def largest_topic_share(df: DataFrame) -> DataFrame:
    """AGG25: the biggest topic and its share of all rows."""
    counted = df.filter(F.col("dominant_topic").isNotNull()).groupBy("dominant_topic").agg(_count().alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    return counted.withColumn("share", F.col("count") / total).orderBy(F.desc("share"), "dominant_topic").limit(1)
