import re
from collections import Counter

import corpus_pipeline
from opinionloom.llm import decontamination, quality_rules, secrets
from opinionloom.session import written
from tests.llm.test_simhash import fingerprint_by_hand, groups_by_hand
from tests.llm.test_text_operators import plain, repeated_by_hand

FOLDER = "/root/testdata/sf0.001"


def base_passes(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return len(words) >= 20 and 100 * repeated_by_hand(words) <= 30 * len(words)


def test_every_stage_against_its_own_input(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, inputs = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        docs = written(stage(spark, docs, FOLDER), name)
        assert name == "best_fit_packing" or docs.columns == columns
    rows = {name: {r.doc_id: r for r in frame.collect()} for name, frame in inputs.items()}

    passed = rows["simhash_near_dedup"]
    assert set(passed) <= {k for k, r in rows["quality_rules"].items() if base_passes(r.text)}
    judged = {r.doc_id: r.kept for r in quality_rules.judge(inputs["quality_rules"]).collect()}
    assert set(passed) == {k for k, kept in judged.items() if kept}
    assert all(r.n_chars == len(r.text) for r in passed.values())

    keys = sorted(passed)
    groups = groups_by_hand([fingerprint_by_hand(passed[k].text) for k in keys], 2)
    assert set(rows["benchmark_decontamination"]) == {keys[g] for g in set(groups)}

    items = [plain(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    dirty = {k for k, r in rows["benchmark_decontamination"].items() if any(i in plain(r.text) for i in items)}
    clean = set(rows["secret_scans"])
    assert clean <= set(rows["benchmark_decontamination"]) - dirty
    assert len(rows["benchmark_decontamination"]) - len(clean) <= len(dirty) + 1

    assert set(rows["best_fit_packing"]) == clean
    changed = {k for k in clean if rows["best_fit_packing"][k].text != rows["secret_scans"][k].text}
    found = {r.doc_id for r in secrets.scan_secrets(inputs["secret_scans"]).filter("size(spans) > 0").collect()}
    assert changed == found
    assert secrets.scan_secrets(inputs["best_fit_packing"]).filter("size(base) > 0").count() == 0

    packed = docs.collect()
    assert {r.doc_id for r in packed} == clean
    assert max(Counter((r.doc_id, r.piece) for r in packed).values()) == 1


def test_run_is_the_stages_in_a_row(spark):
    packed = corpus_pipeline.run(spark, FOLDER)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert packed.count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "best_fit_packing",
    ]


def test_stages_on_messy_and_empty_tables(spark, messy, empty):
    for table in (messy, empty):
        docs = table.withColumn("n_chars", table["doc_id"])
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, FOLDER), name)
            assert name == "best_fit_packing" or docs.columns == columns
        assert (docs.count() > 0) == (table is messy)


def test_budget_of_edits_is_a_tenth():
    assert decontamination.budget(200) == 20 and decontamination.budget(12) == 1 and decontamination.budget(7) == 0
