import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from opinionloom.llm import decontamination, quality_classifier, quality_rules, queries, token_counts

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from oracle_check import compare, oracle_connection  # noqa: E402

MODEL = f"{queries.TOKENIZERS}/piece_bpe_32k.model"
SMALL = "/root/testdata/sf0.001"


# ---- token counts


def test_counts_equal_the_library_s():
    library, own, pick = sentencepiece.SentencePieceProcessor(model_file=MODEL), token_counts.Counter(MODEL), random.Random(1)
    texts = ["", " ", "  ", "   a", "a  b", "a   b  ", "\n\n x", "▁a▁▁b", "日本語テスト", "<s> <unk> <0x0A>", "\x00", "🙂🙂 a🙂", "x" * 5000, "-=" * 3000]
    texts += ["".join(pick.choice("ab ▁\n\té日🙂<>s0 .the") for _ in range(pick.randint(0, 60))) for _ in range(2000)]
    assert [own.count(t) for t in texts] == [len(library.encode(t)) for t in texts]


def test_token_rows(spark, messy, empty, monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").union(messy.select("doc_id", "text"))
    want = Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in documents.collect())
    rows = token_counts.count_tokens(documents, MODEL).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in rows)
    assert token_counts.count_tokens(empty, MODEL).count() == 0
    monkeypatch.setattr(token_counts, "REMEMBERED", 1)
    own = token_counts.Counter(MODEL)
    assert [own.count(t) for t in ("a b c", "c b a")] == [3, 3]


# ---- quality rules


def repeated_by_hand(words):
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    return len({p for places in windows.values() if len(places) > 1 for i in places for p in range(i, i + 8)})


def test_repeated_words_equal_brute_force():
    pick = random.Random(3)
    for _ in range(300):
        words = [pick.choice([b"a", b"b", b"c"]) for _ in range(pick.randint(0, 60))]
        assert quality_rules.repeated_words(words) == repeated_by_hand(words)
    assert quality_rules.repeated_words([b"w"] * 50_000) == 50_000


@pytest.mark.parametrize("most", [1, 3])
def test_rules_equal_sql_where_the_limits_bind(spark, most):
    folder = "/root/testdata/sf0.01"
    judged = lambda s, d: quality_rules.judge(s.read.parquet(f"{d}/documents.parquet"), max_docs=most).select(
        "doc_id", *quality_rules.COUNTS, "base_failed", "kept"
    )
    verdict, _ = compare(spark, oracle_connection(folder), folder, judged, queries.quality_sql(most))
    assert verdict.startswith("ok")


def prose(i, n=40):
    return " ".join(f"w{i}x{j}" for j in range(n))


def template_tables():
    boiler = "Terms of use apply to\tEVERYTHING here"
    rows = [(i, f"{prose(i)}\nterms of use apply to everything here", "a") for i in range(15)]
    rows += [(100 + i, f"{boiler}\n{prose(100 + i)}", "a") for i in range(15)]
    rows += [(200, "\n".join([boiler] * 8 + [prose(200, 21)]), "a")]  # mostly boilerplate
    rows += [(300 + i, prose(300) + "\n" + prose(301), "a") for i in range(60)]  # exact copies
    near = [prose(400 + k) for k in range(6)]
    rows += [(400 + i, "\n".join([*near, prose(9000 + i, 5)]), "a") for i in range(60)]  # near copies
    rows += [(500 + i, f"{boiler}\n{prose(500 + i)}", "b") for i in range(15)]  # another host, too few
    template = [prose(f"t{k}", 8) for k in range(10)]
    rows += [(700 + i, "\n".join(template + [prose(f"{i}o{k}", 30) for k in range(3)]), "c") for i in range(60)]
    rows += [(800 + i, "\n".join(template[:1] + [prose(f"e{k}", 30) for k in range(3)]), None) for i in range(20)]  # at the limit
    return rows


def test_lines_of_many_documents_go_and_exact_copies_stay(spark):
    rows = template_tables()
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.text for r in quality_rules.apply_rules(documents).collect()}
    assert set(kept) == {i for i, _, _ in rows if i != 200 and not 400 <= i < 460}
    assert kept[3] == prose(3) and kept[103] == prose(103)
    assert kept[700] == "\n".join(prose(f"0o{k}", 30) for k in range(3))
    assert all(kept[i] == t for i, t, _ in rows if 300 <= i < 400 or 500 <= i < 600 or i >= 800)


def test_twin_equals_the_query_on_templates_and_copies(spark, tmp_path):
    rows = template_tables() + [(900 + i, f"{prose(77)}\n{prose(i, 60)}", "limit") for i in range(quality_rules.MAX_DOCS)]
    for extra in ([], [(990, f"{prose(77)}\none more {prose(78)}", "limit")]):  # a line at the limit, and one document beyond
        folder = tmp_path / f"with{len(extra)}"
        spark.createDataFrame(rows + extra, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{folder}/parts")
        folder.joinpath("documents.parquet").symlink_to(next(folder.joinpath("parts").glob("*.parquet")))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
        verdict, n = compare(spark, con, str(folder), queries.op6_quality_rules, queries.ORACLE_SQL["op6_quality_rules"])
        assert verdict.startswith("ok") and n == len(rows + extra)
        removed = {r.doc_id: r.removed for r in quality_rules.judge(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
        assert removed[900] == ([0] if extra else [])


def test_rules_on_messy_rows(messy, empty):
    judged = quality_rules.judge(messy)
    assert judged.count() == messy.count()
    by_key = {r.doc_id: r for r in judged.collect()}
    assert by_key[2].n_words == 0 and by_key[2].base_failed and not by_key[2].kept
    assert by_key[5].n_repeat_words == 40_000 and by_key[9].n_dup_lines == 39
    passed = quality_rules.apply_rules(messy)
    assert passed.columns == messy.columns
    assert Counter(r.doc_id for r in passed.collect()) == Counter({1: 3, 8: 1}) or Counter(
        r.doc_id for r in passed.collect()
    ) == Counter(r.doc_id for r in judged.filter("kept").collect())
    assert quality_rules.judge(empty).count() == quality_rules.apply_rules(empty).count() == 0


# ---- decontamination


def plain(text):
    return " ".join(re.findall(r"[^\W_]+", text.lower()))


def edits_by_hand(pattern, window, low, high, free):
    cells = {(0, j): 0 if free else j for j in range(len(window) + 1) if low <= j <= high}
    for i in range(1, len(pattern) + 1):
        for j in range(max(0, low + i), min(len(window), high + i) + 1):
            cells[i, j] = min(
                cells.get((i - 1, j - 1), 9**9) + (j > 0 and pattern[i - 1] != window[j - 1]),
                cells.get((i - 1, j), 9**9) + 1,
                cells.get((i, j - 1), 9**9) + 1,
            )
    return min([c for (i, _), c in cells.items() if i == len(pattern)] or [9**9])


def test_banded_alignment_equals_the_full_table():
    pick = random.Random(5)
    for _ in range(1000):
        pattern, window = ([pick.randint(1, 3) for _ in range(pick.randint(1, n))] for n in (12, 20))
        free = pick.random() < 0.6
        low, high = (pick.randint(-4, 8), 0) if free else (-pick.randint(0, 4), pick.randint(1, 8))
        high = high or low + pick.randint(1, 8)
        own, _ = decontamination.banded_end(np.array(pattern, np.uint64), np.array(window, np.uint64), low, high, free, 1 << 19)
        assert min(own, 1 << 18) == min(edits_by_hand(pattern, window, low, high, free), 1 << 18)


def test_planted_passages_within_the_budget_are_found(spark):
    pick = random.Random(3)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    hosts = [plain(r.text)[:3000] for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(40).collect()]
    index = decontamination.indexes([(*item, 1) for item in items])
    for _ in range(150):
        item_id, text = pick.choice(items)
        letters = list(plain(text))
        k = decontamination.budget(len(letters))
        for _ in range(pick.randint(0, k)):
            at = pick.randrange(len(letters))
            letters[at : at + pick.randint(0, 1)] = pick.choice(["", "q", "z"])
        host = pick.choice(hosts)
        at = pick.randrange(len(host))
        found = decontamination.search([host, host[:at] + " " + "".join(letters) + " " + host[at:], ""], index)
        assert item_id in [f[0] for f in found[1]] and not found[2]
        own = next(f for f in found[1] if f[0] == item_id)
        assert own[3] <= k and abs(own[1] - at) <= k + 2


@pytest.mark.parametrize("size", [8, 9, 10, 13, 17, 20, 25, 30, 35, 39, 40, 60])
def test_short_items_are_found_at_the_full_budget(size):
    pick = random.Random(size)
    k = decontamination.budget(size)
    assert k == size // 10
    host = " ".join("".join(pick.choice("ghijkl") for _ in range(5)) for _ in range(60))
    for _ in range(60):
        item = "".join(pick.choice("abcdef") for _ in range(size))
        letters = list(item)
        for at in pick.sample(range(size), k):
            letters[at] = "z"
        found = decontamination.search([f"{host} {''.join(letters)} {host}", host], decontamination.indexes([("i", item, 2)]))
        assert found == [[("i", len(host) + 1, len(host) + 1 + size, k)] * 2, []] or (k and len(found[0]) == 2 and not found[1])


def test_hits_equal_a_full_search_with_edits():
    pick = random.Random(8)
    for size in (9, 12, 21, 33):
        for _ in range(25):
            item = "".join(pick.choice("ab c") for _ in range(size))
            item = "x" + " ".join(item.split()) + "yyy"
            if len(item) < decontamination.LEAST_CHARS:
                continue
            text = "x" + " ".join("".join(pick.choice("ab c") for _ in range(40)).split()) + item[: pick.randrange(len(item))] + item[pick.randrange(3) :] + "y"
            k = decontamination.budget(len(item))
            least = edits_by_hand(item, text, -len(item), len(text), True)
            found = decontamination.search([text], decontamination.indexes([(1, item, 1)]))[0]
            assert bool(found) == (least <= k), (item, text)


@pytest.mark.parametrize(("item", "text", "hit"), [
    ("tiny", "a tiny one", True), ("tiny", "tiny", True), ("tiny", "destiny", False), ("a b", "x A, b.", True), ("a b", "xa b", False),
    ("7", "page 7", True), ("7", "page 77", False), ("!!", "!!", False), ("", "x", False), ("sevenof", "sevenof", True), ("sevenof", "sevenofx", False),
])
def test_the_shortest_items_are_whole_words(item, text, hit):
    found = decontamination.search(["", text, "other"], decontamination.indexes([(1, item, 1)]))
    assert bool(found[1]) == hit and not found[0] and not found[2]


def test_leaks_of_the_tables(spark, messy, empty):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    benchmark = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = [(r.item_id, plain(r.text)) for r in benchmark.collect()]
    want = {(r.doc_id, i) for r in documents.collect() for t in [plain(r.text)] for i, item in items if item in t}
    found = decontamination.contaminated(documents, benchmark)
    assert {(r.doc_id, r.item_id) for r in found.filter("edits = 0").collect()} == want
    kept = decontamination.drop_contaminated(documents, benchmark)
    assert kept.columns == documents.columns
    assert kept.count() == documents.count() - found.select("doc_id").distinct().count()
    assert decontamination.drop_contaminated(messy, benchmark).columns == messy.columns
    assert decontamination.drop_contaminated(messy, benchmark).count() == messy.count()
    assert decontamination.drop_contaminated(empty, benchmark).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, ""), (3, "tiny")], "item_id long, text string")
    assert decontamination.contaminated(messy, nothing).count() == 0
    assert decontamination.contaminated(messy, nothing.filter("item_id > 5")).count() == 0
    long = messy.filter("length(text) > 100").limit(1).selectExpr("doc_id item_id", "text")
    assert decontamination.contaminated(messy, long).filter("edits = 0").count() >= 1


def test_items_in_blocks_give_the_same_leaks(spark, monkeypatch):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    benchmark = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    whole = sorted(map(tuple, decontamination.contaminated(documents, benchmark).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 4000)
    assert sorted(map(tuple, decontamination.contaminated(documents, benchmark).collect())) == whole


# ---- quality classifier


def test_held_out_accuracy(spark):
    rows = queries.op9_quality_classifier(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = rows.filter("held_out").join(labels, "doc_id").select("quality", "score", "predicted").collect()
    assert len(held) > 500
    for label in (0, 1):
        own = [r for r in held if r.quality == label]
        assert sum(r.predicted == label for r in own) > 0.95 * len(own)


def test_scores_equal_all_pairs_of_cosines():
    pick = np.random.default_rng(1)
    vectors = quality_classifier.weighted(pick.poisson(0.02, (80, quality_classifier.TERMS)))
    labels = pick.integers(0, 2, 60)
    space = quality_classifier.Space(vectors[:60], labels)
    scores = space.scores(vectors)
    for row, score in zip(vectors, scores, strict=True):
        place = space.project(row[None])[0].astype(np.float64)
        near = [float(place @ other.astype(np.float64)) for other in space.labelled]
        best = sorted(range(60), key=lambda i: -near[i])[: quality_classifier.NEIGHBOURS]
        weights = [max(near[i], 0) ** quality_classifier.SHARPNESS for i in best]
        assert abs(score - sum(w * labels[i] for w, i in zip(weights, best, strict=True)) / sum(weights)) < 1e-3


def test_classifier_on_messy_rows(spark, messy, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (9, None), (None, 1), (8, 1), (77, 1)], "doc_id long, quality int")
    space = quality_classifier.fit(messy, labels, "doc_id", "text", "quality", F.lit(True))
    assert sorted(space.labels) == [0, 0, 1]
    scores = quality_classifier.score(messy, space)
    assert scores.count() == messy.count()
    assert all(abs(r.score - 1 / 3) < 1e-9 for r in scores.filter("doc_id in (2, 3, 4)").collect())
    assert quality_classifier.score(empty, space).count() == 0
    none = quality_classifier.fit(messy, labels.filter("doc_id = 77"), "doc_id", "text", "quality", F.lit(True))
    assert {r.score for r in quality_classifier.score(messy, none).collect()} == {0.5}
