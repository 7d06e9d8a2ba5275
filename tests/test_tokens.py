from pyspark.sql import functions as F

from opinionloom import wordlists
from opinionloom.functions import lookups
from opinionloom.operators import tokens


def table(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "review_id long, review_clean string")


def test_stop_lemma_and_length_rules(spark):
    df = table(spark, "The batteries LOVED 4K a_b ox tablets tablets", "one two it", None)
    rows = tokens.normalize_reviews(df).collect()
    assert [(r["review_id"], r["tokens"], r["review_normalized"], r["token_count"]) for r in rows] == [
        (0, ["battery", "love", "tablet", "tablet"], "battery love tablet tablet", 4)
    ]


def test_lemma_in_the_stop_list_is_dropped(spark):
    df = table(spark, "bought sturdy rather camera stand")
    assert tokens.normalize_reviews(df).first()["tokens"] == ["sturdy", "camera", "stand"]


def test_joined_tables_give_the_same_tokens(spark):
    df = table(spark, "The batteries loved tablets tablets kids", "bought sturdy camera stand ox", "games games games")
    stops = spark.createDataFrame([(w,) for w in tokens.stop_words()], "term string")
    lemmas = spark.createDataFrame(list(wordlists.LEMMAS.items()), "form string, lemma string")
    joined = tokens.normalize_by_join(df, stops, lemmas)
    assert sorted(map(tuple, joined.select("review_id", "tokens").collect())) == sorted(
        map(tuple, tokens.normalize_reviews(df).select("review_id", "tokens").collect())
    )
    passed_as_tables = tokens.normalize_reviews(df, stops=stops, lemmas=lemmas)
    assert passed_as_tables.count() == joined.count()


def test_long_tables_take_the_join(spark, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_INLINE_ROWS", 3)
    stops = spark.createDataFrame([(w,) for w in tokens.stop_words()], "term string")
    plan = tokens.normalize_reviews(table(spark, "sturdy camera stand"), stops=stops)
    assert plan.first()["tokens"] == ["sturdy", "camera", "stand"]
    assert "posexplode" in plan._jdf.queryExecution().optimizedPlan().toString()


def test_stop_unions(spark):
    assert tokens.stop_words(["b", "a"], ["b"]) == ["a", "b"]
    one = spark.createDataFrame([("a",), ("b",)], "term string")
    assert tokens.stop_word_table(one, one).count() == 2


def test_token_text_and_slices(spark):
    df = spark.createDataFrame([("['a','', 'b']",), ('["c"]',), ("d  e",)], "t string")
    parsed = [r["p"] for r in df.select(tokens.parse_token_text(F.col("t")).alias("p")).collect()]
    assert parsed == [["a", "b"], ["c"], ["d", "e"]]
    assert df.select(tokens.first_tokens(F.split(F.lit("a b c"), " "), 2).alias("x")).first()["x"] == ["a", "b"]


def test_token_stats(spark):
    df = spark.createDataFrame([(3,), (5,)], "token_count int")
    assert tuple(tokens.token_stats(df).first()) == (2, 4.0, 3, 5)


def test_texts_move_before_they_are_words_and_of_long_tables_only_rare_words(spark, monkeypatch):
    rows = [(1, "big cats ran the cats 4x ox"), (2, "the the cats ran big ran"), (None, "cats ran cats"), (4, None), (5, "x y mice or not")]
    df = spark.createDataFrame(rows, "review_id long, review_clean string")
    stops = spark.createDataFrame([("the",), ("go",)], "term string")
    lemmas = spark.createDataFrame([("cats", "cat"), ("ran", "run"), ("big", "go"), ("ran", "rush"), ("mice", "mouse")], "form string, lemma string")
    placed = tokens.normalize_by_join(df, stops, lemmas)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(review_id" in plan[plan.index("posexplode") :] and plan.count("hashpartitioning(review_id") <= 2
    both = [df, df.unionAll(df)]
    found = [sorted((r.review_id, r.tokens) for r in tokens.normalize_by_join(d, stops, lemmas).collect()) for d in both]
    assert found[0] == [(1, ["cat", "run", "cat"]), (2, ["cat", "run", "run"])]
    cut, by_use = [], tokens._by_use
    monkeypatch.setattr(tokens, "_by_use", lambda *a: (cut.append(by_use(*a)), cut[-1])[1])
    for bound in (220, 0):
        monkeypatch.setattr(lookups, "BROADCAST_BYTES", bound)
        again = [sorted((r.review_id, r.tokens) for r in tokens.normalize_by_join(d, stops, lemmas).collect()) for d in both]
        assert again == found
    assert [t.count() > 0 for t in cut[0]] == [True, True] and cut[2][0].count() == 0
