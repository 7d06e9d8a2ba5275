import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinionloom import wordlists
from opinionloom.operators import lemmas, tagging


def english(spark):
    """The word lists of the package and regular forms of some of their words."""
    words = {*wordlists.LEMMAS, *wordlists.LEMMAS.values(), *wordlists.LEXICON, *wordlists.ENGLISH_STOP_WORDS, *wordlists.BOOSTERS}
    words |= set("walk walks walked walking talk talks talked talking cry cries cried city cities party parties bake bakes baked baking".split())
    words |= set("story stories carry carries carried help helps helped helping move moves moved moving smile smiles smiled smiling".split())
    return spark.createDataFrame([(w, 3) for w in sorted(words) if re.fullmatch("[a-z]+", w)], "term string, n long")


def test_rules_and_lemmas_of_regular_english(spark):
    vocabulary = english(spark)
    rules = lemmas.lemma_rules(vocabulary, min_support=3)
    found = {(r["suffix"], r["ending"]): r["support"] for r in rules.collect()}
    assert {("s", ""), ("ed", ""), ("ing", ""), ("ing", "e"), ("ies", "y")} <= found.keys()
    table = dict(map(tuple, lemmas.lemma_table(vocabulary, rules).collect()))
    judged = {form: table[form] == lemma for form, lemma in wordlists.LEMMAS.items() if form in table}
    assert len(judged) > 45 and sum(judged.values()) / len(judged) >= 0.9
    assert table["stories"] == "story" and table["baking"] == "bake" and table["walked"] == "walk" and "the" not in table


def test_rules_by_definition(spark):
    words = ["aaab", "aaac", "aaa", "aaabc", "bbbb", "bbbbc", "bbbc", "bbb", "ccccab", "cccc"]
    table = spark.createDataFrame([(w, 1) for w in words], "term string, n long")
    expected = {}
    for word in words:
        for k in range(1, min(4, len(word) - 3) + 1):
            stem, suffix = word[:-k], word[-k:]
            for ending in ("", "c"):
                if suffix != ending and stem + ending in words:
                    expected[suffix, ending] = expected.get((suffix, ending), 0) + 1
    found = lemmas.lemma_rules(table, endings=("", "c"), min_support=1, min_percent=0).collect()
    assert {(r["suffix"], r["ending"]): r["support"] for r in found} == expected
    assert lemmas.lemma_rules(table, endings=("", "c"), min_support=1, min_percent=0, max_rules=1).count() == 1
    assert lemmas.lemma_rules(table, endings=("", "c"), min_support=99).count() == 0


def test_viterbi_equals_all_sequences():
    rng = np.random.default_rng(2)
    for case in range(40):
        k = int(rng.integers(1, 4))
        sizes = rng.integers(0, 6, 5)
        starts = np.concatenate(([0], np.cumsum(sizes)))
        emitted = rng.integers(-3 if case % 2 else -900, 0, (starts[-1], k))  # small numbers give ties
        first, follows = rng.integers(-900, 0, k), rng.integers(-900, 0, (k, k))
        if case % 2:
            first, follows = first // 300, follows // 300
        found = tagging.viterbi(starts, emitted, first, follows)
        for a, b in zip(starts[:-1], starts[1:]):
            total = lambda path: first[path[0]] + sum(emitted[a + i][t] for i, t in enumerate(path)) + sum(follows[x, y] for x, y in zip(path, path[1:]))
            paths = list(itertools.product(range(k), repeat=b - a)) if b > a else []
            if paths:
                most = max(map(total, paths))
                assert tuple(found[a:b]) == min((p for p in paths if total(p) == most), key=lambda p: p[::-1])


def test_context_settles_open_words(spark):
    texts = ["The nation is very famous. She is walking with the manager.", "They talked slowly! The movement is useful", "the blorf is careful"] * 5
    df = spark.createDataFrame(list(enumerate(texts)) + [(99, None), (98, "... \n 12 !")], "review_id long, review_text string")
    rows = tagging.sentences(df, "review_text")
    assert rows.filter("review_id >= 98").count() == 0
    tagger = tagging.train_tagger(rows)
    found = {(r["term"], r["tag"]) for r in tagging.tagged_tokens(rows, tagger).collect()}
    # an unknown word between an article and a verb
    assert {("the", "DET"), ("nation", "NOUN"), ("slowly", "ADV"), ("blorf", "NOUN"), ("is", "VERB"), ("careful", "ADJ")} <= found
    assert all(len({tag for w, tag in found if w == term}) == 1 for term in ("the", "is", "nation"))


def test_one_long_sentence(spark):
    rows = spark.createDataFrame([(1, 0, ["the", "walking"] * 20_000)], "review_id long, sentence int, words array<string>")
    found = tagging.tagged_tokens(rows, tagging.train_tagger(rows)).groupBy("term", "tag").agg(F.count("*").alias("n")).collect()
    assert sorted(map(tuple, found)) == [("the", "DET", 20_000), ("walking", "VERB", 20_000)]


@pytest.mark.parametrize("word, tag", [("the", "DET"), ("quickly", "ADV"), ("running", "VERB"), ("sing", None), ("blorf", None)])
def test_weak_labels(spark, word, tag):
    df = spark.createDataFrame([(word,)], "w string")
    assert df.select(F.expr(tagging.weak_label_sql("w")).alias("t")).first()["t"] == tag
