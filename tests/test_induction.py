import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from opinionloom.functions import arrow_lists, lookups
from opinionloom.operators import induction, lexicon

SEEDS = {"good": 20, "fine": 10, "bad": -25, "unseen": 7}


def corpus(n=300, seed=1):
    """Reviews of two moods; each mood has words of its own beside common ones."""
    rng = random.Random(seed)
    own = {1: ["good", "fine", "bright", "tasty"], -1: ["bad", "torn", "stale"]}
    return [[rng.choice(own[mood] if rng.random() < 0.4 else [f"c{rng.randrange(40)}"]) for _ in range(12)] for mood in (1, -1) for _ in range(n)]


def plain(docs, seeds, rounds, min_pairs=induction.MIN_PAIRS):
    pairs = Counter()
    for words in docs:
        for i, x in enumerate(words or []):
            pairs.update(tuple(sorted((x, y))) for y in words[i + 1 : i + 1 + induction.WINDOW] if x != y)
    ends = Counter()
    for (a, b), n in pairs.items():
        ends[a] += n
        ends[b] += n
    graph = {}
    for (a, b), n in pairs.items():
        ratio = n * ends.total() // (ends[a] * ends[b])
        if n >= min_pairs and ratio >= 2:
            graph.setdefault(a, {})[b] = graph.setdefault(b, {})[a] = ratio.bit_length() - 1
    start = {}
    for sign in (1, -1):
        parts = {t: max(sign * seeds.get(t, 0), 0) for t in graph}
        start[sign] = {t: p * (induction.MASS // 1000) // max(sum(parts.values()), 1) * 1000 for t, p in parts.items()}
    masses = start
    for _ in range(rounds):
        masses = {
            sign: {
                t: sum(m[b] // sum(graph[b].values()) * w for b, w in graph[t].items()) // 100 * induction.KEEP_PERCENT
                + start[sign][t] // 100 * (100 - induction.KEEP_PERCENT)
                for t in graph
            }
            for sign, m in masses.items()
        }
    score = {t: masses[1][t] * 2000 // (masses[1][t] + masses[-1][t]) - 1000 for t in graph if masses[1][t] + masses[-1][t]}
    return {t: s for t, s in score.items() if abs(s) >= induction.MIN_SCORE or t in seeds}, {t: len(e) for t, e in graph.items()}


def table(spark, docs):
    return spark.createDataFrame([(d, "x") for d in docs], "tokens array<string>, term string").repartition(5)


@pytest.mark.parametrize("broadcast", [lookups.BROADCAST_BYTES, 0])
def test_equals_a_plain_version(spark, monkeypatch, broadcast):
    monkeypatch.setattr(lookups, "BROADCAST_BYTES", broadcast)
    docs = [*corpus(60), [], None, ["alone"], ["bad", "bad"], [None, "good", None]]
    found = {r["term"]: r for r in induction.induced_lexicon(table(spark, docs), SEEDS, rounds=2).collect()}
    want, links = plain([[w for w in d if w] if d else d for d in docs], SEEDS, 2)
    assert {t: r["score"] for t, r in found.items() if r["score"] is not None} == want
    assert all(r["links"] == links.get(t, 0) and r["induced"] == (t not in SEEDS) for t, r in found.items())
    assert {t: found[t]["valence_tenths"] for t in SEEDS} == SEEDS


def test_words_of_a_mood_are_found_and_common_ones_are_not(spark):
    rows = {r["term"]: r for r in induction.induced_lexicon(table(spark, corpus()), SEEDS).collect()}
    assert {t for t, r in rows.items() if r["valence_tenths"] > 0} == {"good", "fine", "bright", "tasty", "unseen"}
    assert {t for t, r in rows.items() if r["valence_tenths"] < 0} == {"bad", "torn", "stale"}


def test_the_result_is_a_lexicon(spark):
    words = induction.induced_lexicon(table(spark, corpus()), SEEDS).select("term", "valence_tenths")
    texts = spark.createDataFrame([(1, "tasty and bright"), (2, "torn, stale"), (3, "c1 c2")], "review_id int, review_clean string")
    scored = lexicon.score_reviews(texts, lexicon=lexicon.Lexicon(terms=words))
    assert {r["review_id"]: r["vader_label"] for r in scored.collect()} == {1: "positive", 2: "negative", 3: "neutral"}


def test_empty_corpus_and_repeated_seeds(spark):
    seeds = spark.createDataFrame([("good", 20), ("good", 5), (None, 1)], "term string, valence_tenths int")
    rows = induction.induced_lexicon(table(spark, corpus()).limit(0), seeds).collect()
    assert [tuple(r) for r in rows] == [("good", 5, None, 0, False)]


def test_only_hot_words_are_salted(spark):
    words = spark.range(9000).select(F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).otherwise("hot").alias("w"), "id")
    words = words.unionAll(spark.createDataFrame([(None, -1)], "w string, id long"))
    names = spark.range(9000).select(F.col("id").cast("string").alias("w"), "id").withColumnRenamed("id", "n")
    names = names.unionAll(spark.createDataFrame([("hot", -5)], "w string, n long"))
    assert lookups.hot_words(words, "w", 8) == ["hot"]
    joined = lookups.salted_join(words, names, "w", ["id"], "left", salts=8)
    assert sorted((r["id"], r["n"]) for r in joined.filter("w is not null").collect()) == [
        (i, i if i % 3 else -5) for i in range(9000)
    ]
    assert joined.filter("w is null").count() == 1 and joined.count() == 9001
    assert lookups.salted_join(words, names, "w", ["id"], salts=8).count() == 9000


def test_pairs_move_as_numbers_and_a_long_dictionary_as_words(spark, monkeypatch):
    docs = table(spark, [*corpus(40), ["bad", "torn", "bad", "torn", "bad"], [None, "good", None], ["alone"]])
    by_words, moved = induction.pair_counts, []
    monkeypatch.setattr(induction, "pair_counts", lambda *a: (moved.append(a), by_words(*a))[1])
    numbered = sorted(map(tuple, induction.text_graph(docs, min_pairs=3).collect()))
    assert numbered and not moved
    monkeypatch.setattr(arrow_lists, "DICTIONARY_BYTES", 0)
    assert sorted(map(tuple, induction.text_graph(docs, min_pairs=3).collect())) == numbered and moved


def test_the_bound_of_a_word_holds(spark):
    rng = random.Random(3)
    docs = [[rng.choice("aabcdefgh") for _ in range(rng.randrange(30))] for _ in range(40)]
    pairs = Counter()
    for words in docs:
        for i, x in enumerate(words):
            pairs.update(tuple(sorted((x, y))) for y in words[i + 1 : i + 1 + induction.WINDOW] if x != y)
    ends = Counter()
    for (a, b), n in pairs.items():
        ends.update({a: n, b: n})
    found = {r["term"]: r for r in induction.word_figures(table(spark, docs)).collect()}
    assert {t: r["ends"] for t, r in found.items()} == ends
    assert all(found[w]["most"] >= n for pair, n in pairs.items() for w in pair)
