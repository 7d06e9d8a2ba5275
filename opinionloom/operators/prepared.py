"""Prepared tables that take new loads.

What the prepared tables need of a load is kept as states that can be added up: a cell per combination of rating, month,
topic and labels, with its rows and the sum of its lexicon scores; the counts of each topic's terms; a distinct sketch of
each topic's review ids; and the narrow rows of the score plot. A new month reads its own reviews only. Merged states give the
same tables as the reviews of all loads together, as all sums are sums of integers; only the distinct count is an estimate.

A load's states are written under a version of its own, and a row in ``commits`` makes the version count. So a load that
failed half-way doesn't count, and a load that is repeated replaces itself. ``compact`` adds up all loads into one.

Defined cases: null ratings, dates, topics, labels and scores are cells of their own and are left out where the table over all
reviews leaves them out. A load without rows counts as one. Other columns of the reviews are not looked at.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinionloom.functions import labels
from opinionloom.functions.numeric import percent
from opinionloom.operators import aggregates

CELL_KEYS = ("rating", "month", "dominant_topic", "topic_label", "vader_label", "model_label")
SCORE_UNITS = 10_000
COMMITS = "commits"
COMPACTED = "compacted"


def load_states(df: DataFrame) -> dict[str, DataFrame]:
    """The states of one load of master rows, by name."""
    month = F.date_trunc("month", "review_date").alias("month")
    units = F.round(F.col("vader_score") * SCORE_UNITS).cast("long")
    cells = df.groupBy(*(month if key == "month" else F.col(key) for key in CELL_KEYS)).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("vader_score").alias("scored"),
        F.coalesce(F.sum(units), F.lit(0)).cast("long").alias("units"),
    )
    known = df.filter(F.col("topic_label").isNotNull())
    ids = known.groupBy("topic_label").agg(F.hll_sketch_agg(F.col("review_id").cast("string")).alias("ids"))
    return {
        "cells": cells,
        "terms": aggregates.counted_terms(df),
        "ids": ids,
        "scores": aggregates.score_rows(df),
    }


def merge_states(states: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """States of several loads, stacked, added up to one row per key."""
    return {
        "cells": states["cells"].groupBy(*CELL_KEYS).agg(*(F.sum(c).alias(c) for c in ("n", "scored", "units"))),
        "terms": states["terms"].groupBy("topic_label", "term").agg(F.sum("own").alias("own"), F.sum("all").alias("all")),
        "ids": states["ids"].groupBy("topic_label").agg(F.hll_union_agg("ids").alias("ids")),
        "scores": states["scores"],
    }


def _path(folder: str, state: str, version: str) -> str:
    return f"{folder.rstrip('/')}/{state}/version={version}"


def _write(spark: SparkSession, states: dict[str, DataFrame], folder: str, load: str, replaces: list[str]) -> None:
    version = uuid.uuid4().hex
    for name, state in states.items():
        state.write.parquet(_path(folder, name, version))
    schema = "load string, version string, replaces array<string>, at long"
    commit = spark.createDataFrame([(load, version, replaces, time.time_ns())], schema)
    commit.coalesce(1).write.mode("append").parquet(f"{folder.rstrip('/')}/{COMMITS}")


def add_load(df: DataFrame, folder: str, load: str) -> None:
    """Take the master rows of a load, for instance a month, into the states of ``folder``; a known load is replaced.

    A load that was compacted with others can't be replaced any more.
    """
    spark = df.sparkSession
    if load in compacted_loads(spark, folder):
        raise ValueError(f"load {load} is part of a compacted state")
    _write(spark, load_states(df), folder, load, [load])


def _commits(spark: SparkSession, folder: str) -> DataFrame | None:
    path = f"{folder.rstrip('/')}/{COMMITS}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if system.exists(hadoop) else None


def _current(commits: DataFrame) -> DataFrame:
    """Of each load the last commit, unless a later compaction took the load in."""
    last = commits.groupBy("load").agg(
        F.max_by("version", "at").alias("version"), F.max_by("replaces", "at").alias("replaces"), F.max("at").alias("at")
    )
    taken = commits.filter(F.col("load") == COMPACTED).select(F.explode("replaces").alias("load"), F.col("at").alias("taken"))
    return last.join(
        taken.groupBy("load").agg(F.max("taken").alias("taken")).filter("load != 'compacted'"), "load", "left"
    ).filter("taken IS NULL OR taken < at")


def current_loads(spark: SparkSession, folder: str) -> dict[str, str]:
    """Version by load. A row per load since the last compaction comes to the driver."""
    commits = _commits(spark, folder)
    return {} if commits is None else {r["load"]: r["version"] for r in _current(commits).collect()}


def compacted_loads(spark: SparkSession, folder: str) -> set[str]:
    commits = _commits(spark, folder)
    if commits is None:
        return set()
    taken = commits.filter(F.col("load") == COMPACTED).select(F.explode("replaces").alias("load")).distinct()
    return {r["load"] for r in taken.collect()} - {COMPACTED}


def read_states(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The states of all current loads, merged."""
    versions = sorted(current_loads(spark, folder).values())
    if not versions:
        raise ValueError(f"no load in {folder}")
    names = ("cells", "terms", "ids", "scores")
    return merge_states({name: spark.read.parquet(*(_path(folder, name, v) for v in versions)) for name in names})


def compact(spark: SparkSession, folder: str) -> None:
    """Write the merged states as one load in place of the current ones; their files stay until they are cleaned up."""
    loads = current_loads(spark, folder)
    if len(loads) > 1:
        _write(spark, read_states(spark, folder), folder, COMPACTED, sorted(loads))


def _of(column: str, value: str):
    return F.sum(F.when(F.col(column) == value, F.col("n")).otherwise(0))


def _rated():
    """Rows with a rating, and the sums of ratings and of their squares."""
    rating = F.col("rating").cast("long")
    n = F.coalesce(F.sum(F.when(F.col("rating").isNotNull(), F.col("n"))), F.lit(0))
    return n, F.sum(rating * F.col("n")), F.sum(rating * rating * F.col("n"))


def sentiment_distribution(cells: DataFrame) -> DataFrame:
    """AGG1."""
    pairs = F.array(
        F.struct(F.lit(aggregates.LEXICON_MODEL).alias("model"), F.col("vader_label").alias("label")),
        F.struct(F.lit(aggregates.CLASSIFIER_MODEL).alias("model"), F.col("model_label").alias("label")),
    )
    counted = cells.select("n", F.inline(pairs)).filter(F.col("label").isNotNull()).groupBy("label", "model")
    return counted.agg(F.sum("n").alias("count")).orderBy("model", F.desc("count"), "label")


def rating_profile(cells: DataFrame) -> DataFrame:
    """AGG3."""
    profile = cells.filter(F.col("rating").isNotNull()).groupBy("rating").agg(
        F.sum("n").alias("count"),
        F.try_divide(F.sum("units"), F.sum("scored") * SCORE_UNITS).alias("avg_vader"),
        (_of("model_label", labels.POSITIVE) / F.sum("n")).alias("pct_positive"),
    )
    return profile.withColumn("sentiment", labels.share_band(F.col("pct_positive"))).orderBy("rating")


def monthly_trend(cells: DataFrame, min_reviews: int = aggregates.MIN_MONTH_REVIEWS) -> DataFrame:
    """AGG4. The limit holds for the month of all loads together."""
    dated = cells.filter(F.col("month").isNotNull() & F.col("model_label").isNotNull())
    monthly = dated.groupBy("month", "model_label").agg(F.sum("n").alias("count"))
    total = F.sum("count").over(Window.partitionBy("month"))
    kept = monthly.withColumn("_total", total).filter(F.col("_total") >= min_reviews).drop("_total")
    return kept.orderBy("month", "model_label")


def topic_profile(cells: DataFrame) -> DataFrame:
    """AGG5."""
    known = cells.filter(F.col("dominant_topic").isNotNull() & F.col("topic_label").isNotNull())
    rated, ratings, _ = _rated()
    of_all = lambda label: F.bround(_of("model_label", label) / F.sum("n") * 100, 1)
    return (
        known.groupBy("dominant_topic", "topic_label")
        .agg(
            F.sum("n").alias("count"),
            F.bround(F.try_divide(ratings, rated), 2).alias("avg_rating"),
            of_all(labels.POSITIVE).alias("pct_positive"),
            of_all(labels.NEGATIVE).alias("pct_negative"),
        )
        .orderBy("count", "dominant_topic")
    )


def topic_hotspots(cells: DataFrame) -> DataFrame:
    """AGG6."""
    known = cells.filter(F.col("topic_label").isNotNull() & F.col("model_label").isNotNull())
    counted = known.groupBy("topic_label").agg(
        *(_of("model_label", label).alias(label) for label in (labels.NEGATIVE, labels.POSITIVE))
    )
    return (
        counted.withColumn("total", F.col(labels.POSITIVE) + F.col(labels.NEGATIVE))
        .withColumn("pct_negative", percent(F.col(labels.NEGATIVE), F.col("total")))
        .withColumn("pct_positive", percent(F.col(labels.POSITIVE), F.col("total")))
        .orderBy(F.desc("pct_negative"), "topic_label")
    )


def topic_rating_ci(cells: DataFrame) -> DataFrame:
    """AGG7."""
    rated, ratings, squares = _rated()
    stats = cells.filter(F.col("topic_label").isNotNull()).groupBy("topic_label").agg(
        rated.alias("n"), ratings.cast("double").alias("_sum"), squares.cast("double").alias("_squares")
    )
    n = F.col("n").cast("double")
    spread = F.sqrt(F.try_divide(n * F.col("_squares") - F.col("_sum") * F.col("_sum"), n * (n - 1)))
    return (
        stats.withColumn("std_rating", spread)
        .withColumn("avg_rating", F.bround(F.try_divide("_sum", "n"), 3))
        .withColumn("ci", F.bround(F.col("std_rating") * 1.96 / F.sqrt("n"), 3))
        .withColumn("band", labels.rating_band(F.col("avg_rating")))
        .select("topic_label", "avg_rating", "std_rating", "n", "ci", "band")
        .orderBy(F.desc("avg_rating"), "topic_label")
    )


def distinct_reviews(states: dict[str, DataFrame]) -> DataFrame:
    """AGG23: estimated distinct review ids per topic; reviews that came with several loads count once."""
    return states["ids"].select("topic_label", F.hll_sketch_estimate("ids").alias("reviews"))


def tables_from_states(states: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """JOB4: the eight prepared tables by name, all lazy, from merged states."""
    cells = states["cells"]
    return {
        "sentiment_dist": sentiment_distribution(cells),
        "rating_dist": rating_profile(cells),
        "monthly": monthly_trend(cells),
        "topic_dist": topic_profile(cells),
        "topic_heatmap": topic_hotspots(cells),
        "avg_rating": topic_rating_ci(cells),
        "vader_scores": states["scores"],
        "wc_tokens": aggregates.term_weights(states["terms"]),
    }
