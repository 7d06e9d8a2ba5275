import re

from pyspark.sql import functions as F

from opinionloom.operators import sampling


def strata(spark, partitions):
    sizes = {1: 1, 2: 10, 3: 1000, 4: 3000}
    rows = [(i, rating) for rating, n in sizes.items() for i in range(rating * 10_000, rating * 10_000 + n)]
    return spark.createDataFrame(rows, "review_id long, rating int").repartition(partitions)


def test_exact_quotas_under_any_partitioning(spark):
    draws = []
    for partitions in (1, 7):
        drawn = sampling.stratified_sample(strata(spark, partitions), 200)
        draws.append(sorted(map(tuple, drawn.collect())))
    assert draws[0] == draws[1]
    counts = {r: sum(1 for _, x in draws[0] if x == r) for r in (1, 2, 3, 4)}
    assert counts == {1: 1, 2: 1, 3: 200 * 1000 // 4011, 4: 200 * 3000 // 4011}


def test_draw_is_the_ranking_of_all_rows(spark):
    df = strata(spark, 3)
    ranked = sorted((r["k"], r["review_id"]) for r in df.filter("rating = 4").select("review_id", sampling.draw_key("review_id").alias("k")).collect())
    expected = {i for _, i in ranked[: 200 * 3000 // 4011]}
    assert {r["review_id"] for r in sampling.stratified_sample(df, 200).filter("rating = 4").collect()} == expected


def test_repeated_ids_still_fill_the_quota(spark):
    df = spark.range(3000).select(F.lit(7).cast("long").alias("review_id"), (F.col("id") % 2).cast("int").alias("rating"))
    assert sampling.stratified_sample(df, 100).count() == 100


def test_small_table_is_kept(spark):
    df = strata(spark, 2)
    assert sampling.stratified_sample(df, 5000).count() == 4011
    assert sampling.simple_sample(df, 5).count() == 5
    assert [r["review_id"] for r in sampling.head(df, 2).collect()] == [10_000, 20_000]


def test_rows_without_a_stratum_are_never_drawn(spark):
    df = strata(spark, 2).union(spark.createDataFrame([(1, None), (2, None)], "review_id long, rating int"))
    for cap in (200, 5000):
        drawn = sampling.stratified_sample(df, cap)
        assert drawn.filter("rating is null").count() == 0
    assert sampling.stratified_sample(df.filter("rating is null"), 5).count() == 0


def test_only_the_last_bucket_of_a_stratum_is_ranked(spark):
    plan = sampling.stratified_sample(strata(spark, 3), 200)._jdf.queryExecution().optimizedPlan().toString()
    ranked = plan[plan.index("row_number") :]
    assert re.search(r"_bucket#\d+ = _last#\d+\._bucket", ranked[: ranked.index("LocalRelation") if "LocalRelation" in ranked else None])
