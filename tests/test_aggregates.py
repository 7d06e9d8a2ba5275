import datetime

import pytest
from pyspark.sql import functions as F

from opinionloom.operators import aggregates, agreement, quality, search

# Published rating histograms (1 to 5 stars) per topic, and the mean, interval and size they lead to.
GOLDEN = {
    "kids_tablets": ([17, 29, 105, 616, 1449], 4.557, 0.030, 2216, 4.56),
    "customer_service_issues": ([26, 31, 45, 104, 238], 4.119, 0.111, 444, 4.12),
    "apps_entertainment": ([34, 26, 115, 439, 705], 4.331, 0.049, 1319, 4.33),
    "device_features": ([214, 108, 107, 531, 1243], 4.126, 0.054, 2203, 4.13),
    "battery_value": ([492, 281, 425, 1153, 5196], 4.362, 0.026, 7547, 4.36),
    "gift_recommendations": ([34, 43, 147, 1207, 3694], 4.655, 0.018, 5125, 4.66),
    "media_camera": ([16, 9, 22, 204, 486], 4.540, 0.058, 737, 4.54),
    "kindle_ereaders": ([7, 3, 58, 487, 1591], 4.702, 0.024, 2146, 4.70),
}
COLUMNS = (
    "review_id long, rating int, review_date timestamp, dominant_topic int, topic_label string, model_label string, "
    "vader_label string, vader_score double, topic_score double, review_text string"
)


def rows(spark, *given):
    """Rows with defaults: (rating, topic label, model label, lexicon label, score, date)."""
    full = []
    for i, row in enumerate(given):
        rating, topic, model, lex, score, date = (*row, *(None,) * (6 - len(row)))
        full.append((i, rating, date, None if topic is None else ord(topic[0]) - 97, topic, model, lex, score, score, f"text {i}"))
    return spark.createDataFrame(full, COLUMNS)


@pytest.fixture(scope="module")
def golden(spark):
    cells = [
        (topic, label, star, n)
        for topic, (label, (counts, *_)) in enumerate(GOLDEN.items())
        for star, n in enumerate(counts, 1)
    ]
    table = spark.createDataFrame(cells, "dominant_topic int, topic_label string, rating int, n int")
    df = table.withColumn("i", F.explode(F.sequence(F.lit(1), "n"))).withColumn("model_label", F.lit("positive"))
    return df.drop("i", "n")


def test_published_means_and_intervals(golden):
    found = {r["topic_label"]: (r["avg_rating"], r["ci"], r["n"]) for r in aggregates.topic_rating_ci(golden).collect()}
    assert found == {label: (mean, ci, n) for label, (_, mean, ci, n, _) in GOLDEN.items()}


def test_published_topic_profile(golden):
    found = aggregates.topic_profile(golden).collect()
    assert {r["topic_label"]: (r["count"], r["avg_rating"]) for r in found} == {
        label: (n, short) for label, (_, _, _, n, short) in GOLDEN.items()
    }
    assert [r["count"] for r in found] == sorted(n for *_, n, _ in GOLDEN.values())


def test_published_blocks(golden):
    blocks = aggregates.topic_blocks(golden).collect()
    assert blocks[4]["ratings"] == {1: 492, 2: 281, 3: 425, 4: 1153, 5: 5196}
    assert [b["pct_corpus"] for b in blocks] == [10.2, 2.0, 6.1, 10.1, 34.7, 23.6, 3.4, 9.9]
    assert tuple(aggregates.largest_topic_share(golden).first())[:2] == (4, 7547)
    assert aggregates.topic_listing(golden).collect()[4]["bar"] == 7547 * 25 // 21737


def test_hotspots(spark):
    df = rows(spark, (5, "a", "positive"), (5, "b", "negative"), (5, "b", "positive"), (5, "c", "positive"),
              (5, None, "negative"), (5, "d", None), (1, "e", "negative"), (1, "e", "negative"), (1, "e", "positive"))
    assert [tuple(r) for r in aggregates.topic_hotspots(df).collect()] == [
        ("e", 2, 1, 3, 66.7, 33.3), ("b", 1, 1, 2, 50.0, 50.0), ("a", 0, 1, 1, 0.0, 100.0), ("c", 0, 1, 1, 0.0, 100.0)
    ]


def test_single_row_topic_has_no_interval(spark):
    row = aggregates.topic_rating_ci(rows(spark, (4, "a", "positive"))).first()
    assert (row["std_rating"], row["ci"], row["n"], row["band"]) == (None, None, 1, "positive")


def test_monthly_trend(spark):
    day = datetime.datetime(2018, 2, 28, 23, 59, 59)
    other = datetime.datetime(2018, 3, 1)
    df = rows(spark, *[(5, "a", "positive", None, None, day)] * 3, *[(1, "a", "negative", None, None, day)] * 2,
              *[(5, "a", "positive", None, None, other)] * 4, (5, "a", "positive"))
    month = datetime.datetime(2018, 2, 1)
    assert [tuple(r) for r in aggregates.monthly_trend(df).collect()] == [(month, "negative", 2), (month, "positive", 3)]


def test_distributions_and_profiles(spark):
    df = rows(spark, (5, "a", "positive", "positive", 0.5), (5, "a", None, "neutral", 0.0), (3, "a", "negative", "neutral", 0.1))
    counted = {(r["model"], r["label"]): r["count"] for r in aggregates.sentiment_distribution(df).collect()}
    assert counted == {("lexicon", "positive"): 1, ("lexicon", "neutral"): 2, ("classifier", "positive"): 1, ("classifier", "negative"): 1}
    assert {r["share"] for r in aggregates.sentiment_share(df).filter("model = 'classifier'").collect()} == {0.5}
    profile = {r["rating"]: tuple(r)[1:] for r in aggregates.rating_profile(df).collect()}
    assert profile == {3: (1, 0.1, 0.0, "negative"), 5: (2, 0.25, 0.5, "mixed")}
    assert tuple(aggregates.label_counts(df, "vader_label", ("positive", "negative")).first()) == (1, 0)
    assert [r["bin"] for r in aggregates.score_histogram(rows(spark, (5, "a", "positive", "positive", 1.0))).collect()] == [40]


def test_examples_break_ties_by_id(spark):
    df = rows(spark, *[(5, "a", "positive", "positive", s) for s in (0.1, 0.9, 0.9, 0.9, 0.5)], (5, "b", "positive", "positive", 0.2))
    found = aggregates.topic_examples(df).orderBy("dominant_topic", "rank").collect()
    assert [(r["dominant_topic"], r["review_id"]) for r in found] == [(0, 1), (0, 2), (0, 3), (1, 5)]


def test_topic_terms_fall_back_to_text(spark):
    df = spark.createDataFrame(
        [("a", ["x", "", "x"], "zz"), ("a", [], "ignored words"), ("b", None, "p q p"), ("b", [], None)],
        "topic_label string, tokens array<string>, review_normalized string",
    )
    assert {tuple(r) for r in aggregates.topic_terms(df).collect()} == {("a", "x", 2), ("b", "p", 2), ("b", "q", 1)}
    weights = {(r["topic_label"], r["term"]): r["weight"] for r in aggregates.topic_term_weights(df).collect()}
    assert weights == {("a", "x"): 1.0, ("b", "p"): 1.0, ("b", "q"): 0.5}


def test_agreement_rates(spark):
    df = rows(spark, (3, "a", "positive", "neutral"), (5, "a", None, "positive"), (1, "a", "negative", "positive"), (4, "a", "positive", "neutral"))
    row = agreement.agreement_report(df).first()
    assert (row["lexicon_three_way"], row["lexicon_binary"], row["model_binary"], row["lexicon_vs_model"]) == (0.5, 1 / 3, 2 / 3, 0.0)
    assert row["n_binary"] == 3
    flags = agreement.add_agreement_flag(df).orderBy("review_id").collect()
    assert [f["sentiment_agree"] for f in flags] == [False] * 4
    kpis = aggregates.kpis(df).first()
    assert (kpis["total"], kpis["pct_positive"], kpis["vader_agree"], kpis["model_binary_agree"]) == (4, 50.0, 33.3, 66.7)


def test_audit(spark):
    df = rows(spark, *[(r, "abcdefgh"[r % 8], "positive", "positive", 0.9) for r in (1, 3, 4, 5)], (9, "a", "odd", None, 0.5))
    found = {r["metric"]: (r["value"], r["passed"]) for r in quality.audit(df, coherence=0.3).collect()}
    assert found["rating_outside_1_5"] == (1.0, False)
    assert found["unknown_model_label"] == (1.0, False)
    assert found["unknown_vader_label"] == (1.0, False)
    assert found["unused_topics"] == (3.0, False)
    assert found["coherence"] == (0.3, True)
    assert found["null_text"] == (0.0, True)
    allowed = spark.createDataFrame([("positive",), ("negative",)], "model_label string")
    assert [r[0] for r in quality.values_outside(df, "model_label", allowed).collect()] == ["odd"]
    assert [r[0] for r in quality.values_missing(df, "model_label", allowed).collect()] == ["negative"]


def test_search(spark):
    df = rows(spark, (5, "a", "positive", "positive", 0.5), (1, "b", "negative", "negative", -0.5), (3, "a", "negative", "neutral", 0.0))
    df = df.unionByName(df.limit(1).withColumn("review_text", F.lit(None).cast("string")).withColumn("review_id", F.lit(9).cast("long")))
    ids = lambda **f: sorted(r["review_id"] for r in search.search(df, **f).collect())
    assert ids() == [0, 1, 2, 9]
    assert ids(topics=["b"]) == [1]
    assert ids(sentiments=["negative"]) == [1, 2]
    assert ids(ratings=[3, 5]) == [0, 2, 9]
    assert ids(term="  TEXT [12] ") == [1, 2]
    assert ids(term="text [12]", literal=True) == []
    assert ids(topics=["a"], sentiments=["negative"], ratings=[3], term="Text") == [2]
    assert tuple(search.search_summary(search.search(df, term="no such")).first()) == (0, None, None, None)
    many = spark.range(700).select(F.col("id").alias("review_id"), F.lit(5).alias("rating"), F.lit("x").alias("review_text"))
    assert [r["review_id"] for r in search.search_results(many).collect()] == list(range(500))
    assert search.search_results(df, friendly=True).columns == ["Rating", "Sentiment", "Lexicon score", "Topic", "Review"]
