import html
import random
import re
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from opinionloom.functions.entities import decode_entities
from opinionloom.functions.text import clean_text, strip_space
from opinionloom.operators.clean import clean_reviews

FIXTURES = [
    (None, ""),
    ("", ""),
    ("   ", ""),
    ("Nice <br><b>really</b> nice", "Nice really nice"),
    ("see https://x.org/p?id=1 now", "see now"),
    ("mail me@x.org today", "mail today"),
    ("paid $49.99 then 20 Dollars", "paid then"),
    ("love \U0001f60d it é", "love it"),
    ("4K and MP3 but 4.5 stars, a_b", "4K and MP3 but stars a_b"),
    ("a &amp;lt; b", "a b"),
    ("x &lt;b&gt; y", "x y"),
    ("@@x.y @a.b a@b", "a b a b"),
    ("1 2 3 a 4 5", "a"),
    ("now &copy; then &#169; and &zzz; end", "now then and end"),
    ("a &amp;copy; b &amp;#38; c", "a b c"),
    ("www.shop.example/x?y=1 fine", "fine"),
    ("(https://a.b)next one", "one"),
    ("cost $1,000.50 or 3dollars or 7 DOLLAR each", "cost or or each"),
    ("x_1 1_x 22 3rd", "x_1 1_x 3rd"),
    ("one\ttwo\nthree\u00a0four\u3000five", "one two three four five"),
    ("<p>open < not closed", "open not closed"),
    ("tag <a\nhref='x'>over lines</a>", "tag over lines"),
    ("it's rock'n'roll!!!", "it s rock n roll"),
    ("caf\u00e9 \u0663 ok", "caf ok"),
]


def random_texts(n):
    rng = random.Random(7)
    pieces = (
        "& &amp &amp; &am &#39; &#x27; &#0; &#128; &#55296; &#1114112; &#99999999999999; &#0000000065; &#64976; &#xD; "
        "&copyx &notit; &notin; &fjlig; &nbsp; a; # &#; &#x; http:// https://x.org/p?a=1 www. a@b.c @ @@ . a 9 $ $4.99 "
        "3dollar DOLLARS _ 4K - < > '"
    ).split(" ")
    pieces += [" ", "\n", "\t", "\x0b", "\x1c", "\x1f", "\x85", " ", " ", "​", "٣", "20 dollars", "é"]
    pieces += ["&" + name for name in rng.sample(sorted(html5), 40)]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(n)]


def test_cleaning_fixtures(spark):
    df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(FIXTURES)], "i int, t string")
    found = [row["c"] for row in df.select("i", clean_text("t").alias("c")).orderBy("i").collect()]
    assert found == [expected for _, expected in FIXTURES]


def test_properties_on_random_text(spark):
    texts = random_texts(5000)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", clean_text("t").alias("c"), strip_space("t").alias("s"), decode_entities("t").alias("d")).collect()
    for row in rows:
        assert re.fullmatch(r"([A-Za-z0-9_]+( [A-Za-z0-9_]+)*)?", row["c"])
        assert not any(word.isdecimal() for word in row["c"].split(" "))
        assert row["s"] == row["t"].strip()
        assert row["d"] == html.unescape(row["t"])


def test_every_named_entity(spark):
    texts = [f"&{name}" for name in html5] + [f"&{name}z" for name in html5]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    wrong = [r["t"] for r in df.select("t", decode_entities("t").alias("d")).collect() if r["d"] != html.unescape(r["t"])]
    assert wrong == []


@pytest.mark.parametrize("unit", ["a", "9", "@", "a@", "<", "&", "$", "a9_", "<a"])
def test_long_runs_stay_fast(spark, unit):
    df = spark.createDataFrame([(unit * 20_000,)], "t string")
    assert df.select(clean_text("t").alias("c")).count() == 1
    assert df.select(F.length(clean_text("t")).alias("n")).first()["n"] >= 0


def test_short_cleaned_rows_are_dropped(spark):
    df = spark.createDataFrame([(1, "0123456789 1"), (2, "abcdefghij"), (3, "abcdefghijk")], "review_id long, review_text string")
    assert [r["review_id"] for r in clean_reviews(df).collect()] == [3]
    with pytest.raises(ValueError, match="review_text"):
        clean_reviews(df.drop("review_text"))
