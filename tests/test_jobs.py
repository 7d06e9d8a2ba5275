import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from opinionloom.functions import arrow_lists
from opinionloom.operators import classify, topics
from opinionloom.plans import jobs
from opinionloom.schemas import schema_differences
from opinionloom.sinks import tables

GOOD = "great tablet with an excellent screen and wonderful battery life for reading books"
BAD = "terrible battery that broke quickly and poor useless charger with awful support"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The whole chain, from a CSV file to the master table."""
    folder = tmp_path_factory.mktemp("stages")
    lines = ["reviews.text,reviews.rating,reviews.date,name,reviews.title,reviews.username"]
    for i in range(40):
        good = i % 2 == 0
        lines.append(f'"{GOOD if good else BAD} number{i}",{5 if good else 1},2017-0{1 + i % 3}-01T00:00:00.000Z,p{i},t,u')
    lines.append("short,5,,,,")
    (folder / "raw").mkdir()
    (folder / "raw" / "reviews.csv").write_text("\n".join(lines) + "\n")
    path = lambda name: str(folder / name)
    raw = jobs.ingest_job(spark, path("raw"), path("reviews_raw"), min_bytes=100)
    processed = jobs.preprocess_job(spark, path("reviews_raw"), path("reviews_processed"))
    sentiment = jobs.sentiment_job(spark, path("reviews_processed"), path("reviews_sentiment"), path("sentiment_report"))
    master, score = jobs.topic_job(
        spark, (path("missing"), path("reviews_sentiment")), path("reviews_topics"), path("topic_report"), path("model"),
        k=2, passes=5, no_below=2, no_above=0.9,
    )
    return folder, raw, processed, sentiment, master, score


def report_rows(folder):
    return [json.loads(line) for file in Path(folder).glob("*.json") for line in file.read_text().splitlines()]


def test_every_stage_fits_its_schema(stages):
    _, raw, processed, sentiment, master, _ = stages
    for name, table in (("raw", raw), ("processed", processed), ("sentiment", sentiment), ("topics", master)):
        assert schema_differences(table, name) == []
        assert table.count() == 40


def test_labels_follow_the_text(stages):
    *_, sentiment, _, _ = stages
    wrong = sentiment.filter("star_sentiment != vader_label OR star_sentiment != model_label OR NOT sentiment_agree")
    assert wrong.count() == 0
    assert classify.mean_confidence(sentiment).first()[0] > 0.5


def test_reports_and_charts(stages, spark):
    folder, *_, master, score = stages
    figures = {(r["section"], r["metric"]): r["value"] for r in report_rows(folder / "sentiment_report")}
    assert figures[("overall", "total")] == 40.0
    assert figures[("classifier", "agreement")] == 1.0
    topic_rows = report_rows(folder / "topic_report")
    assert sum(r["count"] for r in topic_rows) == 40
    assert all(len(r["examples"]) <= 3 and "(" in r["keywords"] for r in topic_rows)
    assert -1 <= score <= 1
    assert jobs.kpis_with_coherence(master, score).first()["coherence"] == score
    prepared = jobs.prepared_tables(master)
    written = tables.write_chart_tables({n: prepared[n] for n in ("rating_dist", "vader_scores", "wc_tokens")}, str(folder / "charts"))
    assert len(written) == 3 and spark.read.parquet(written[1]).count() == 40
    assert {r["rating"] for r in report_rows(written[0])} == {1, 5}
    other = tables.write_chart_tables({"rating_dist": prepared["rating_dist"]}, str(folder / "other"), as_parquet=["rating_dist"])
    assert spark.read.parquet(other[0]).count() == 2


def test_saved_model_is_reused(stages, spark):
    folder = stages[0]
    assert topics.TopicModel.exists(spark, str(folder / "model"))
    assert not topics.TopicModel.exists(spark, str(folder / "other"))


def test_caller_model_is_loaded_once_per_task(spark):
    df = spark.createDataFrame([(1, "fine"), (2, " "), (3, None)], "review_id long, review_clean string").coalesce(1)

    def load():
        return lambda texts: [("POSITIVE" if t == "average product" else "NEGATIVE", 0.123456) for t in texts]

    rows = classify.classify_with(df, load, batch_rows=2).orderBy("review_id").collect()
    assert [(r["model_label"], r["model_confidence"]) for r in rows] == [("negative", 0.1235), ("positive", 0.1235), ("positive", 0.1235)]
    assert "_text" not in rows[0].asDict()


def test_words_are_not_cut_off(spark):
    df = spark.createDataFrame([("w " * 600 + "end",)], "review_clean string")
    assert df.select(F.size(classify.model_words("review_clean"))).first()[0] == 601


def test_word_odds(spark):
    rows = [(i, f"{'good fine' if i % 2 else 'bad poor'} thing{i}", 5 if i % 2 else 1) for i in range(40)] + [(40, None, 3), (41, "good bad", None)]
    df = spark.createDataFrame(rows, "review_id long, review_clean string, rating int")
    model = classify.fit_word_odds(df.filter("review_id < 20"))
    scored = {r.review_id: r for r in classify.score_by_words(df, model).collect()}
    assert all(scored[i].model_label == ("positive" if i % 2 else "negative") for i in range(40))
    assert scored[40].model_confidence == 0.5 and len(scored) == 42
    empty = classify.fit_word_odds(df.filter("review_id < 0"))
    assert {r.model_confidence for r in classify.score_by_words(df, empty).collect()} == {0.5}


def test_words_of_a_model_are_looked_up_in_place(spark, monkeypatch):
    texts = [f"good w{i % 7} rare{i}" if i % 2 else f"bad w{i % 5} rare{i}" for i in range(40)]
    rows = [(i, texts[i], 5 if i % 2 else 1) for i in range(40)] + [(None, "good good", 5), (50, None, 1)]
    df = spark.createDataFrame(rows, "review_id long, review_clean string, rating int").repartition(3).localCheckpoint()
    model = classify.fit_word_odds(df.filter("review_id < 20"))
    key = lambda r: (str(r.review_id), r.review_clean or "", r.model_label, r.model_confidence)
    whole = classify.score_by_words(df, model)
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
    twice = df.unionAll(df)
    want, want_twice = sorted(map(key, whole.collect())), sorted(map(key, classify.score_by_words(twice, model).collect()))
    assert len({k[3] for k in want}) > 2
    for bound, least in ((150, 2), (0, None)):  # the frequent words in place, all words joined
        monkeypatch.setattr(arrow_lists, "DICTIONARY_BYTES", bound)
        assert (classify.least_uses(model.terms) or 0) >= 2 if least else classify.least_uses(model.terms) is None
        assert sorted(map(key, classify.score_by_words(df, model).collect())) == want
        assert sorted(map(key, classify.score_by_words(twice, model).collect())) == want_twice
