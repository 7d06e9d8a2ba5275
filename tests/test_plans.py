import re

import pytest

from opinionloom.operators import aggregates, search, topics
from opinionloom.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def snapshot(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "master")
    catalogue.master(spark, FOLDER).write.parquet(path)
    return spark.read.parquet(path)


# queries of a model that is applied in Arrow batches
IN_BATCHES = ("lda", "classifier", "callers_model", "tagged_tokens")


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if not n.startswith(IN_BATCHES)])
def test_no_python_and_no_cross_join(spark, name):
    plan = physical(catalogue.QUERIES[name](spark, FOLDER))
    assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|CartesianProduct", plan)


def test_text_is_cleaned_once(spark):
    plan = physical(catalogue.master(spark, FOLDER))
    assert len(re.findall(r"dollars", plan)) == 1


def test_aggregates_read_only_their_columns(snapshot):
    for table, columns in (
        (aggregates.topic_hotspots(snapshot), {"topic_label", "model_label"}),
        (aggregates.rating_profile(snapshot), {"rating", "vader_score", "model_label"}),
        (aggregates.topic_rating_ci(snapshot), {"topic_label", "rating"}),
    ):
        read = re.search(r"ReadSchema: struct<([^>]*)>", physical(table)).group(1)
        assert {c.split(":")[0] for c in read.split(",")} == columns


def test_filters_reach_the_files(snapshot):
    plan = physical(search.search(snapshot, ["en"], ["positive"], [1, 2], "the"))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan).group(1)
    assert all(part in pushed for part in ("topic_label", "model_label", "rating"))


def test_top_k_is_limited_before_the_shuffle(snapshot):
    for table in (aggregates.topic_examples(snapshot), aggregates.topic_term_weights(snapshot)):
        plan = physical(table)
        assert plan.index("Final") < plan.index("Exchange hashpartitioning") < plan.rindex("Partial")


def test_aggregates_are_partial_before_the_shuffle(snapshot):
    assert "partial_count" in physical(topics.document_frequency(topics.topic_input(snapshot)))
    assert physical(aggregates.topic_hotspots(snapshot)).count("Exchange hashpartitioning") == 1
