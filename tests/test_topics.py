import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opinionloom.functions import arrow_lists
from opinionloom.operators import coherence, topics, variational

DOCS = [
    ["battery", "life", "battery", "charge"],
    ["screen", "life", "charge"],
    ["battery", "screen", "sound", "sound", "sound"],
]


def documents(spark, docs):
    return spark.createDataFrame(list(enumerate(docs)), "review_id long, topic_tokens array<string>")


def brute_force_coherence(docs, topic, window):
    """c_v by its definition: every window spelled out."""
    windows = [set(d[s : s + window]) for d in docs for s in range(max(len(d) - window, 0) + 1)]
    p = lambda *words: sum(all(w in seen for w in words) for seen in windows) / len(windows)

    def npmi(a, b):
        if not p(a) or not p(b):
            return 0.0
        joint = p(a, b) + 1e-12
        return math.log(joint / (p(a) * p(b))) / -math.log(joint)

    vectors = [[npmi(a, b) for b in topic] for a in topic]
    total = [sum(column) for column in zip(*vectors)]
    length = lambda v: math.sqrt(sum(x * x for x in v))
    return sum(
        sum(x * y for x, y in zip(v, total)) / (length(v) * length(total)) if length(v) and length(total) else 0.0 for v in vectors
    ) / len(topic)


@pytest.mark.parametrize("window", [2, 3, 110])
def test_coherence_equals_its_definition(spark, window):
    docs = DOCS + [["life"] * 3 + ["x"] * 4 + ["battery", "y", "charge"]]
    sets = {1: ["battery", "life", "charge"], 2: ["screen", "sound", "unseen"]}
    words = spark.createDataFrame([(t, w) for t, ws in sets.items() for w in ws], "topic int, term string")
    found = {r["topic"]: r["coherence"] for r in coherence.topic_coherence(documents(spark, docs), words, window=window).collect()}
    for topic, listed in sets.items():
        assert found[topic] == pytest.approx(brute_force_coherence(docs, listed, window), abs=1e-9)


def test_vocabulary_rules(spark):
    df = documents(spark, DOCS)
    rows = [tuple(r) for r in topics.vocabulary(df, no_below=2, no_above=1.0).collect()]
    assert rows == [("battery", 0, 2), ("charge", 1, 2), ("life", 2, 2), ("screen", 3, 2)]
    assert topics.vocabulary(df, no_below=1, no_above=0.5).select("term").collect() == [("sound",)]
    assert [r["term"] for r in topics.vocabulary(df, no_below=1, no_above=1.0, keep_n=2).collect()] == ["battery", "charge"]
    bag = {tuple(r) for r in topics.bag_of_words(df, topics.vocabulary(df, no_below=2, no_above=1.0)).collect()}
    assert (0, 0, 2) in bag and len(bag) == 8


def test_topic_input_keeps_tokens(spark):
    df = spark.createDataFrame([(1, ["battery", "good", "screen", "sound"]), (2, ["good", "great", "screen"])], "review_id long, tokens array<string>")
    rows = topics.topic_input(df).collect()
    assert [(r["review_id"], r["tokens"], r["topic_tokens"]) for r in rows] == [
        (1, ["battery", "good", "screen", "sound"], ["battery", "screen", "sound"])
    ]


def test_dominant_topic_takes_the_first_maximum(spark):
    df = spark.createDataFrame([([0.2, 0.4, 0.4],), ([0.0, 0.0],), (None,)], "d array<double>")
    assert [r["t"] for r in df.select(topics.dominant_topic(F.col("d")).alias("t")).collect()] == [1, 0, 0]


def test_fit_assign_save_load(spark, tmp_path):
    docs = [["battery", "charge", "power"]] * 12 + [["book", "read", "page"]] * 12 + [["unknown", "words", "only"]]
    df = documents(spark, docs)
    folder = str(tmp_path / "model")
    model = topics.load_or_fit(df, folder, k=2, passes=10, no_below=5)
    labels = spark.createDataFrame([(0, "first")], "dominant_topic int, topic_label string")
    rows = topics.assign_topics(df, model, labels).orderBy("review_id").collect()
    assert len({r["dominant_topic"] for r in rows[:12]}) == 1
    assert rows[0]["dominant_topic"] != rows[12]["dominant_topic"]
    assert (rows[24]["dominant_topic"], rows[24]["topic_score"]) == (0, 0.0)
    assert {r["topic_label"] for r in rows} == {"first", "topic_1"}
    assert all(0 <= r["topic_score"] <= 1 and len(r["topic_keywords"].split()) == 5 for r in rows)
    again = topics.assign_topics(df, topics.load_or_fit(df, folder, k=2, passes=10, no_below=5), labels).orderBy("review_id").collect()
    assert again == rows
    assert topics.topic_keywords(spark, model, 3).count() == 6


def test_long_dictionary_keeps_every_term(spark):
    terms = [f"term{i:05d}" for i in range(12_000)]
    df = documents(spark, [terms[i : i + 100] for i in range(0, 12_000, 100)])
    table = spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, term_id int")
    assert topics.bag_of_words(df, table).count() == 12_000


def plain_digamma(x):
    total = 0.0
    while x < 60:
        total -= 1 / x
        x += 1
    return total + math.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4)


def plain_trigamma(x):
    total = 0.0
    while x < 60:
        total += 1 / x**2
        x += 1
    return total + 1 / x + 1 / (2 * x**2) + 1 / (6 * x**3) - 1 / (30 * x**5)


def plain_newton(prior, n, logs, rate):
    d, t = plain_digamma, plain_trigamma
    g = [n * (d(sum(prior)) - d(a) + m) for a, m in zip(prior, logs)]
    q = [-n * t(a) for a in prior]
    c = n * t(sum(prior))
    b = sum(x / y for x, y in zip(g, q)) / (1 / c + sum(1 / y for y in q))
    moved = [a - rate * (x - b) / y for a, x, y in zip(prior, g, q)]
    return moved if min(moved) > 0 else prior


def plain_fit(chunks, weights, alpha, eta, passes, corpus):
    """Online variational inference, a document, term and topic at a time."""
    k, size, step = len(weights), len(weights[0]), 0
    log_shares = lambda row: [plain_digamma(x) - plain_digamma(sum(row)) for x in row]
    for _ in range(passes):
        for docs in chunks:
            beta = [[math.exp(x) for x in log_shares(row)] for row in weights]
            sums, logs = [[0.0] * size for _ in range(k)], [0.0] * k
            for doc in docs:
                gamma = [a + sum(doc.values()) / k for a in alpha]
                for _ in range(variational.MOST_ROUNDS):
                    theta = [math.exp(x) for x in log_shares(gamma)]
                    norm = {w: sum(theta[t] * beta[t][w] for t in range(k)) for w in doc}
                    new = [alpha[t] + theta[t] * sum(n * beta[t][w] / norm[w] for w, n in doc.items()) for t in range(k)]
                    change = sum(abs(a - b) for a, b in zip(new, gamma)) / k
                    gamma = new
                    if change < variational.CHANGE:
                        break
                theta = [math.exp(x) for x in log_shares(gamma)]
                for w, n in doc.items():
                    norm = sum(theta[t] * beta[t][w] for t in range(k))
                    for t in range(k):
                        sums[t][w] += n * theta[t] * beta[t][w] / norm
                logs = [a + b for a, b in zip(logs, log_shares(gamma))]
            rate = (1 + step) ** -0.5
            scale = corpus / len(docs)
            weights = [[(1 - rate) * x + rate * (e + scale * s) for x, s, e in zip(row, own, eta)] for row, own in zip(weights, sums)]
            alpha = plain_newton(alpha, len(docs), [x / len(docs) for x in logs], rate)
            rows = [log_shares(row) for row in weights]
            eta = plain_newton(eta, k, [sum(column) / k for column in zip(*rows)], rate)
            step += 1
    return weights, alpha, eta


def test_training_equals_a_plain_version(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(12)]
    docs = [list(rng.choice(words[:7] if i % 2 else words[4:], 9)) for i in range(60)] + [["unknown"], []]
    df = documents(spark, [[str(w) for w in d] for d in docs])
    chunk_of = {r["review_id"]: r["c"] for r in df.select("review_id", F.pmod(F.xxhash64("review_id"), F.lit(3)).alias("c")).collect()}
    chunks = [[Counter(words.index(w) for w in d if w in words) for i, d in enumerate(docs) if chunk_of[i] == c] for c in range(3)]
    first = variational.start(words, 3, 7)
    found = variational.fit(df.repartition(5), first, 4, 3, "topic_tokens", "review_id")
    weights, alpha, eta = plain_fit([[d for d in c if d] for c in chunks], first.weights.tolist(), [1 / 3] * 3, [1 / 3] * 12, 4, 60)
    assert np.abs(found.weights - weights).max() < 1e-6
    assert np.abs(found.alpha - alpha).max() < 1e-6 and np.abs(found.eta - eta).max() < 1e-6
    assert np.ptp(found.alpha) > 1e-3 and np.ptp(found.eta) > 1e-3  # both priors were learned
    assert variational.digamma(np.array([0.1, 1.0, 30.0])) == pytest.approx([plain_digamma(x) for x in (0.1, 1.0, 30.0)], abs=1e-10)


def test_training_finds_the_topics_it_was_made_from(spark):
    rng = np.random.default_rng(1)
    themes = [[f"{t}{i}" for i in range(30)] for t in "abcd"]
    docs = [[str(w) for w in rng.choice(themes[i % 4], 20)] for i in range(400)]
    df = documents(spark, docs)
    model = topics.fit_topics(df, k=4, no_below=1)
    found = {r["review_id"]: r["dominant_topic"] for r in topics.assign_topics(df, model).collect()}
    most = [Counter(t for i, t in found.items() if i % 4 == theme).most_common(1)[0] for theme in range(4)]
    assert len({t for t, _ in most}) == 4 and sum(n for _, n in most) > 380


def test_a_pass_reads_each_document_once(spark, monkeypatch):
    df = documents(spark, [["a", "b"], ["b", "c"], ["c", "a"]] * 40)
    seen, counted = [], variational.expected_counts
    monkeypatch.setattr(variational, "expected_counts", lambda counts, *rest: (seen.append(counts.count()), counted(counts, *rest))[1])
    topics.fit_topics(df, k=2, passes=3, no_below=1, no_above=1.0, chunks=4)
    assert len(seen) == 12 and sum(seen) == 3 * 120


def test_models_are_reused_only_for_the_same_rows_and_options(spark, tmp_path, monkeypatch):
    df = documents(spark, [["a", "b"], ["b", "c"], ["c", "a"]] * 5)
    fits, fit = [], topics.fit_topics
    monkeypatch.setattr(topics, "fit_topics", lambda *a, **b: fits.append(1) or fit(*a, **b))
    options = {"k": 2, "passes": 1, "no_below": 1, "no_above": 1.0}
    topics.load_or_fit(df, str(tmp_path), **options)
    topics.load_or_fit(df.orderBy(F.desc("review_id")).repartition(3), str(tmp_path), **options)
    assert len(fits) == 1  # another order
    topics.load_or_fit(df.union(df.limit(1)), str(tmp_path), **options)
    assert len(fits) == 2  # another row
    topics.load_or_fit(df, str(tmp_path), **{**options, "k": 3})
    assert len(fits) == 3


def test_many_topic_words_take_the_joined_path(spark, monkeypatch):
    docs = DOCS + [["life"] * 3 + ["x"] * 4 + ["battery", "y", "charge"]]
    sets = {1: ["battery", "life", "charge"], 2: ["screen", "sound", "unseen"], 3: ["life", "sound"]}
    words = spark.createDataFrame([(t, w) for t, ws in sets.items() for w in ws], "topic int, term string")
    short = {r["topic"]: r["coherence"] for r in coherence.topic_coherence(documents(spark, docs), words, window=3).collect()}
    monkeypatch.setattr(coherence, "MAX_INLINE_ROWS", 2)
    long = {r["topic"]: r["coherence"] for r in coherence.topic_coherence(documents(spark, docs), words, window=3).collect()}
    assert long == pytest.approx(short, abs=1e-12)


def test_inference_equals_a_plain_version_and_keeps_little(monkeypatch):
    rng = np.random.default_rng(3)
    sizes = np.append(rng.integers(0, 40, 500), 900)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    terms = rng.integers(0, 1000, starts[-1])
    counts, topics_of, alpha = rng.integers(1, 4, len(terms)) * 1.0, rng.random((4, 1000)), np.full(4, 0.25)
    seen, refined = [], variational._refined
    monkeypatch.setattr(variational, "TOGETHER", 2048)
    monkeypatch.setattr(variational, "_refined", lambda gamma, beta, *a: (seen.append(beta.shape), refined(gamma, beta, *a))[1])
    found, _ = variational.infer(starts, terms, counts, topics_of, alpha)
    assert sum(n for n, *_ in seen) == (sizes > 0).sum() and all(n * length <= 2048 for n, length, _ in seen)
    for d, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
        gamma, beta = alpha + counts[a:b].sum() / 4, topics_of[:, terms[a:b]]
        for _ in range(variational.MOST_ROUNDS if b > a else 0):
            theta = np.exp(variational.expected_log(gamma))
            moved = alpha + theta * (beta @ (counts[a:b] / (theta @ beta)))
            done, gamma = np.abs(moved - gamma).mean() < variational.CHANGE, moved
            if done:
                break
        assert np.abs(found[d] - gamma).max() < 1e-8


def test_parts_of_lists_are_bounded():
    lists = pa.array([["a"] * n for n in (3, 0, 9, 1, 1, 1)] + [None], pa.list_(pa.string()))
    assert list(arrow_lists.parts(lists, 3, 4)) == [(0, 2), (2, 1), (3, 3), (6, 1)]
