import pytest

from opinionloom.operators import lexicon
from opinionloom.operators.lexicon import Lexicon, score_by_join, score_reviews

# Texts and the compound score the published rules give with valences of 1.9 (good), -2.5 (bad), 3.2 (best).
CASES = [
    ("good", 0.4404),
    ("very good", 0.4927),
    ("not good", -0.3412),
    ("not very good", -0.3865),
    ("barely good", 0.3832),
    ("GOOD day it is", 0.5622),
    ("VERY good day", 0.6028),
    ("GOOD", 0.4404),
    ("good but bad", -0.5859),
    ("never so good", 0.5777),
    ("without doubt best", 0.6369),
    ("_good_ thing", 0.4404),
    ("bad", -0.5423),
    ("no good", -0.3412),
    ("no big good", -0.3412),
    ("no bad or good", 0.1139),
    ("least good", -0.3412),
    ("at least good", 0.4404),
    ("it was kind of good", 0.3832),
    ("well this is the bomb bad", 0.6124),
    ("nothing here", -0.0),
    ("", 0.0),
    (None, 0.0),
]


def table(spark):
    return spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "review_id long, review_clean string")


def test_known_scores(spark):
    rows = score_reviews(table(spark)).orderBy("review_id").collect()
    assert [r["vader_score"] for r in rows] == [expected for _, expected in CASES]
    for row in rows:
        score = row["vader_score"]
        assert -1 <= score <= 1
        assert row["vader_label"] == ("positive" if score >= 0.05 else "negative" if score <= -0.05 else "neutral")


def test_lexicon_as_a_joined_table_scores_the_same(spark, monkeypatch):
    expected = score_reviews(table(spark)).orderBy("review_id").collect()
    assert score_by_join(table(spark), Lexicon()).orderBy("review_id").collect() == expected
    terms = spark.createDataFrame(list(Lexicon().terms.items()), "term string, valence_tenths int")
    assert score_reviews(table(spark), lexicon=Lexicon(terms=terms)).orderBy("review_id").collect() == expected
    monkeypatch.setattr(lexicon, "table_to_dict", lambda terms: None)
    assert score_reviews(table(spark), lexicon=Lexicon(terms=terms)).orderBy("review_id").collect() == expected


def test_missing_text_column_is_named(spark):
    with pytest.raises(ValueError, match="review_clean"):
        score_reviews(spark.range(1))
