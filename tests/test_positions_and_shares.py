import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from opinionloom.operators import calibration, coherence, heavy, positional


def test_rows_are_numbered_in_order(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(500), i) for i in range(3000)] + [(None, -1)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    for partitions in (None, 1, 13):
        found = positional.numbered(df, ["a", "b"], partitions=partitions).collect()
        want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        assert [tuple(r)[:2] for r in sorted(found, key=lambda r: r["position"])] == want
        assert sorted(r["position"] for r in found) == list(range(3001))
    plan = positional.numbered(df, ["a"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window ") == 1 and "_n" in plan.split("Window ")[1][:80]  # the sizes of the ranges, not the rows


def test_equal_rows_get_places_of_their_own(spark):
    df = spark.range(2000).select(F.lit(1).alias("same"))
    assert sorted(r["position"] for r in positional.numbered(df, ["same"]).collect()) == list(range(2000))
    assert positional.numbered(df.limit(0), ["same"]).count() == 0


def test_tables_side_by_side(spark):
    left = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "l int, x string")
    right = spark.createDataFrame([(9.5,), (7.5,)], "r double")
    rows = lambda how: sorted((r["position"], r["x"], r["r"]) for r in positional.positional_join(left, right, ["l"], ["r"], how).collect())
    assert rows("inner") == [(0, "a", 7.5), (1, "b", 9.5)] and rows("left") == [(0, "a", 7.5), (1, "b", 9.5), (2, "c", None)]


@pytest.mark.parametrize("k", [1, 2, 5, 40])
def test_heavy_terms_are_exact(spark, k, monkeypatch):
    monkeypatch.setattr(heavy, "BATCH_WORDS", 50)
    rng = random.Random(k)
    docs = [[f"w{min(int(rng.paretovariate(0.4)), 3000)}" for _ in range(30)] + ([None] if i % 9 == 0 else []) for i in range(300)]
    docs += [["often"] * 400, [], None]
    df = spark.createDataFrame([(d,) for d in docs], "tokens array<string>").repartition(6)
    counts = Counter(w for d in docs for w in d or [] if w is not None)
    want = {w: n for w, n in counts.items() if n * k >= counts.total()}
    assert {r["term"]: r["n"] for r in heavy.heavy_terms(df, k).collect()} == want


def test_counters_stay_few_and_fall_short_by_less_than_a_share():
    rng = random.Random(4)
    for k in (1, 3, 10):
        counters, true = Counter(), Counter()
        for _ in range(200):
            batch = Counter(rng.choices("abcdefghijklmnop", [1 / (i + 1) for i in range(16)], k=20))
            true.update(batch)
            counters = heavy.cut(counters + batch, k)
            assert len(counters) <= k
            assert all(true[t] - counters[t] <= true.total() / (k + 1) and counters[t] <= true[t] for t in true)


def test_heavy_terms_of_an_empty_table(spark):
    assert heavy.heavy_terms(spark.createDataFrame([], "tokens array<string>"), 5).count() == 0


def rising_fit(cells):
    """The least-squares rising fit by its formula."""
    mean = lambda a, b: sum(r for _, r, _ in cells[a : b + 1]) / sum(n for _, _, n in cells[a : b + 1])
    return {
        c: max(min(mean(a, b) for b in range(i, len(cells))) for a in range(i + 1)) for i, (c, _, _) in enumerate(cells)
    }


def test_pools_equal_the_formula():
    rng = random.Random(2)
    for _ in range(200):
        cells = [(c, right, right + rng.randrange(5) or 1) for c in sorted(rng.sample(range(30), rng.randrange(1, 12))) for right in [rng.randrange(6)]]
        found = {c: r / n for c, (r, n) in calibration.pool_adjacent_violators(cells).items()}
        assert found == pytest.approx(rising_fit(cells))


def test_calibration_lowers_the_error_on_held_out_rows(spark):
    rng = random.Random(3)
    rows = [(s, rng.random() < s * s) for s in (0.5 + 0.5 * rng.random() for _ in range(8000))]  # too sure of itself
    df = spark.createDataFrame([(i, s, r) for i, (s, r) in enumerate(rows)], "id int, s double, r boolean")
    values = calibration.fit_calibration(df.filter("id % 2 = 0"), F.col("s"), F.col("r"))
    assert values == sorted(values) and len(values) == calibration.CELLS and values[0] is not None
    held = df.filter("id % 2 = 1").withColumn("c", calibration.calibrated(F.col("s"), values))
    before, after = (calibration.calibration_error(held, F.col(c), F.col("r")) for c in ("s", "c"))
    assert before > 0.1 and after < 0.04


def test_calibration_without_rows_and_at_the_ends(spark):
    df = spark.createDataFrame([(1.0, True), (0.0, False), (None, True), (0.5, None)], "s double, r boolean")
    values = calibration.fit_calibration(df, F.col("s"), F.col("r"), 10)
    assert values == [0.0] * 9 + [1.0]
    assert [r["c"] for r in df.select(calibration.calibrated(F.col("s"), values).alias("c")).collect()] == [1.0, 0.0, None, 0.0]
    assert calibration.fit_calibration(df.limit(0), F.col("s"), F.col("r"), 3) == [None] * 3


def test_coherence_plan_has_no_window(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c"])], "review_id long, topic_tokens array<string>")
    words = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c")], "topic int, term string")
    plan = coherence.topic_coherence(docs, words)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
