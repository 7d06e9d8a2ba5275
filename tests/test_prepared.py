import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from opinionloom.operators import prepared
from opinionloom.plans.jobs import prepared_tables

SCHEMA = (
    "review_id long, rating int, review_date timestamp, dominant_topic int, topic_label string, vader_label string, "
    "model_label string, vader_score double, tokens array<string>, review_normalized string, extra string"
)


def rows(n, seed):
    rng = random.Random(seed)
    some = lambda *values: rng.choice([*values, None])
    out = []
    for i in range(n):
        topic = some(0, 1, 2, 2, 2)
        words = [rng.choice("abcdefgh") * 3 for _ in range(rng.randrange(6))]
        out.append((
            seed * 10_000 + i, some(1, 2, 3, 4, 5), some(*(dt.datetime(2020, m, 3, 4) for m in range(1, 13))), topic,
            None if topic is None else some(f"t{topic}"), some("positive", "neutral", "negative"), some("positive", "negative"),
            some(*(round(rng.uniform(-1, 1), 4) for _ in range(5))), some(words, []), some("aaa zzz", ""), "x",
        ))
    return out


def listed(df):
    return sorted(map(str, df.collect()))


def same(spark, folder, everything):
    found = prepared.tables_from_states(prepared.read_states(spark, folder))
    want = prepared_tables(everything)
    assert found.keys() == want.keys()
    for name in want:
        assert found[name].columns == want[name].columns
        assert found[name].dtypes == want[name].dtypes, name
        assert listed(found[name]) == listed(want[name]), name


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "states")


def test_loads_add_up_to_the_whole(spark, folder):
    parts = [rows(n, seed) for seed, n in enumerate((300, 1, 0, 170))]
    for i, part in enumerate(parts):
        prepared.add_load(spark.createDataFrame(part, SCHEMA), folder, f"load-{i}")
    everything = spark.createDataFrame(sum(parts, []), SCHEMA)
    same(spark, folder, everything)
    prepared.compact(spark, folder)
    assert list(prepared.current_loads(spark, folder)) == [prepared.COMPACTED]
    same(spark, folder, everything)
    late = rows(60, 9)
    prepared.add_load(spark.createDataFrame(late, SCHEMA), folder, "late")
    prepared.compact(spark, folder)
    same(spark, folder, spark.createDataFrame(sum(parts, late), SCHEMA))
    with pytest.raises(ValueError, match="load-1"):
        prepared.add_load(everything, folder, "load-1")


def test_a_repeated_load_replaces_itself_and_a_failed_one_does_not_count(spark, folder):
    first, second = (spark.createDataFrame(rows(80, s), SCHEMA) for s in (1, 2))
    prepared.add_load(first, folder, "a")
    prepared.add_load(second, folder, "b")
    prepared.add_load(first, folder, "b")
    same(spark, folder, first.unionAll(first))
    broken = second.withColumn("vader_score", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        prepared.add_load(broken, folder, "b")
    same(spark, folder, first.unionAll(first))


def test_reviews_of_several_loads_count_once_in_the_sketch(spark, folder):
    first = spark.createDataFrame(rows(400, 3), SCHEMA)
    prepared.add_load(first, folder, "a")
    prepared.add_load(first.filter("rating > 2"), folder, "b")
    found = {r["topic_label"]: r["reviews"] for r in prepared.distinct_reviews(prepared.read_states(spark, folder)).collect()}
    want = {r["topic_label"]: r["count"] for r in first.filter("topic_label is not null").groupBy("topic_label").count().collect()}
    assert found.keys() == want.keys()
    assert all(abs(found[t] - want[t]) <= 0.03 * want[t] + 1 for t in want)


def test_no_load(spark, folder):
    assert prepared.current_loads(spark, folder) == {}
    with pytest.raises(ValueError, match="no load"):
        prepared.read_states(spark, folder)


def test_a_new_load_reads_only_itself(spark, folder, tmp_path):
    spark.createDataFrame(rows(50, 5), SCHEMA).write.parquet(str(tmp_path / "month"))
    month = spark.read.parquet(str(tmp_path / "month"))
    for name, state in prepared.load_states(month).items():
        plan = state._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "extra" not in plan.split("ReadSchema")[1], name
        assert name == "scores" or "partial_" in plan, name
