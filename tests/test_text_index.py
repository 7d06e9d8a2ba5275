import random
import re

import pytest
from pyspark.sql import functions as F

from opinionloom.operators import search, text_index
from opinionloom.plans import catalogue

PARTS = ["battery", "Battery", "life", "straße", "ſound", "KELVIN K", "İstanbul", "ısland", "a.b", "c++", "x|y", "\n", "  ", "12", "", "the"]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(PARTS, k=rng.randrange(8))), rng.randrange(1, 6)) for i in range(1, 600)]
    rows += [(600, None, 1), (None, "battery of nobody", 2), (601, "an extraordinary word", 3), (602, "battery" * 5000, 4), (7, "battery again", 5)]
    df = spark.createDataFrame(rows, "review_id long, review_text string, rating int").withColumn("topic_label", F.lit("t")).withColumn("model_label", F.lit("m"))
    path = str(tmp_path_factory.mktemp("index") / "index")
    text_index.build_index(df, path, bucket_rows=40)
    return df, path


def same(df, path, spark, **how):
    plain = search.search(df, **how)
    if how.get("term", "").strip():
        plain = plain.filter("review_id is not null")
    key = lambda r: tuple((v is None, str(v)) for v in r)
    found = text_index.search_index(spark, path, **how)
    if not (how.get("term", "").strip()):
        return sorted(map(tuple, found.collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)
    return sorted(map(tuple, found.filter("review_id is not null").collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)


PATTERNS = [
    "battery", "BATTERY life", "batt|xtraord", "sound", "kelvin k", "istanbul", "island", "straße", "bat+ery", "batte?ry", "bat{2}ery",
    "ba.*life", "^the", r"\bthe\b", r"a\.b", "[bc]attery", "(battery|life) the", "nothing like it", "", "  ", "li", "x{0}the", r"c\+\+", "the +", "l(?=ife)",
]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_index_finds_what_a_scan_finds(spark, indexed, pattern):
    assert same(*indexed, spark, term=pattern)


def test_literal_terms_and_other_filters(spark, indexed):
    assert same(*indexed, spark, term="x|y", literal=True) and same(*indexed, spark, term="c++", literal=True)
    assert same(*indexed, spark, term="battery", ratings=[2, 3]) and same(*indexed, spark, ratings=[2])
    assert text_index.search_index(spark, indexed[1], term="c++", literal=True).count() > 50


def test_every_required_run_is_in_every_match():
    rng = random.Random(9)
    texts = ["".join(rng.choice("abc ") for _ in range(30)) for _ in range(300)]
    for _ in range(800):
        pattern = "".join(rng.choice(["a", "b", "c", "ab", "abc", "+", "?", "*", "{2}", "{0,1}", ".", "[ab]", "|", " ", r"\ "]) for _ in range(rng.randrange(1, 7)))
        try:
            tested = re.compile(pattern)
        except re.error:
            continue
        wanted = text_index.required_grams(pattern)
        for text in texts if wanted else ():
            if tested.search(text):
                held = set(text_index.grams_of(text.encode()).tolist())
                assert any(grams <= held for grams in wanted), (pattern, text)


def test_only_the_buckets_of_candidates_are_read(spark, indexed):
    df, path = indexed
    found = text_index.search_index(spark, path, term="extraordinary")
    assert found.count() == 1
    files = lambda d: {f for f in d.inputFiles() if "/rows/" in f}
    assert len(files(spark.read.parquet(f"{path}/rows"))) >= 15
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket#\d+ = \d+", plan) or re.search(r"PartitionFilters: \[[^]]*bucket#\d+ IN", plan)
    lists = spark.read.parquet(f"{path}/lists")
    assert lists.agg(F.max("n")).first()[0] <= 70 and lists.filter("gram = 0").count() == 0


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "review_id long, review_text string, rating int, topic_label string, model_label string")
    text_index.build_index(df, str(tmp_path / "i"))
    assert text_index.required_grams("battery") == [{text_index.gram(t) for t in ("bat", "att", "tte", "ter", "ery")}]


def test_lists_hold_each_review_once_and_move_as_lists(spark, tmp_path, monkeypatch):
    texts = [(i, f"text {i % 13} of some words" if i % 9 else None) for i in range(300)] + [(7, "again"), (None, "nobody")]
    df = spark.createDataFrame(texts, "review_id long, review_text string")
    monkeypatch.setattr(text_index, "LIST_ROWS", 20)
    text_index.build_index(df, str(tmp_path / "i"), bucket_rows=100)
    lists = spark.read.parquet(str(tmp_path / "i" / "lists"))
    found = {}
    for r in lists.collect():
        assert r.n == len(r.steps) and r.steps[1:] == [s for s in r.steps[1:] if s > 0]
        found.setdefault(r.gram, []).extend(sum(r.steps[: k + 1]) for k in range(r.n))
    want = {}
    for i, text in texts:
        for g in {text_index.gram(text[k : k + 3]) for k in range(len(text) - 2)} if text and i is not None else ():
            want.setdefault(g, set()).add(i)
    assert {g: sorted(ids) for g, ids in found.items()} == {g: sorted(ids) for g, ids in want.items()}


def test_the_index_query_keeps_only_what_it_searches_and_shows(spark, monkeypatch):
    built = []

    def stop(df, path):
        built.append(df.columns)
        raise InterruptedError

    monkeypatch.setattr(text_index, "build_index", stop)
    with pytest.raises(InterruptedError):
        catalogue.search_rows_indexed(spark, "/root/testdata/sf0.001")
    assert built == [["review_id", *search.HEADINGS]]
