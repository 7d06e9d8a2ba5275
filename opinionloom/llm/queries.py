"""The operators of this folder as registered queries, with DuckDB twins where SQL can say the same."""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionloom.llm import (
    alignment,
    decontamination,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    secrets,
    simhash,
    spelling,
    token_counts,
    token_files,
    warc,
)
from opinionloom.llm import spans as S
from opinionloom.llm.url_filter import judge_urls
from opinionloom.session import shared_folder
from opinionloom.sources.tables import read_table

#: Folder of the tokenizer files; every worker must have it.
TOKENIZERS = os.path.dirname(public_tokenizers.path("word_bpe_49k.json"))

# Host, path and verdict of the url rules.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def op1_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(read_table(spark, folder, "pages"), rules)


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, folder, "documents")).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op4_packing(spark: SparkSession, folder: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return packing.pack(read_table(spark, folder, "documents"), f"{tokenizers}/word_bpe_49k.json")


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(read_table(spark, folder, "pages"), path)
    return (
        warc.read_archives(spark, path, payloads=False)
        .filter("gap is null")
        .select(
            F.col("record_id").cast("long").alias("page_id"),
            "payload_bytes",
            "payload_digest",
            "record_type",
            F.col("refers_to").cast("long").alias("refers_to"),
        )
    )


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judge(read_table(spark, folder, "documents"))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op7_token_counts(spark: SparkSession, folder: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, folder, "documents"), f"{tokenizers}/piece_bpe_32k.model")


def _span_digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return found.select(
        "doc_id",
        *(S.count_kind(F.col("base"), kind).alias(f"n_{kind}") for kind in kinds),
        F.sha2(S.listed(F.col("base")), 256).alias("base_sha256"),
        S.listed(F.col("spans")).alias("spans"),
    )


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    return _span_digest(pii.find_personal_data(read_table(spark, folder, "documents")), pii.KINDS)


def op9_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    space = quality_classifier.fit(documents, read_table(spark, folder, "labels"), "doc_id", "text", "quality", ~held_out)
    return quality_classifier.score(documents, space).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality_classifier.PASS).cast("int").alias("predicted")
    )


def op10_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return _span_digest(secrets.scan_secrets(read_table(spark, folder, "documents")), secrets.KINDS)


def op11_token_files(spark: SparkSession, folder: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_token_files(read_table(spark, folder, "documents"), path, f"{tokenizers}/word_bpe_49k.json")
    return token_files.read_digests(spark, path)


def op12_alignment(spark: SparkSession, folder: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    files = (f"{tokenizers}/byte_bpe_50k.json", f"{tokenizers}/piece_bpe_32k.model")
    return alignment.score_alignment(read_table(spark, folder, "documents"), *files)


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(read_table(spark, folder, "documents"))


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_decontamination": op2_decontamination,
    "op3_simhash": op3_simhash,
    "op4_packing": op4_packing,
    "op5_warc": op5_warc,
    "op6_quality_rules": op6_quality_rules,
    "op7_token_counts": op7_token_counts,
    "op8_pii": op8_pii,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_secret_scans": op10_secret_scans,
    "op11_token_files": op11_token_files,
    "op12_alignment": op12_alignment,
    "op13_spelling": op13_spelling,
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op5_warc"] = """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT payload_digest, min(page_id) AS first FROM payloads WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM payloads LEFT JOIN firsts USING (payload_digest)
"""

WORD = r"[^\x20\x09-\x0D]+"


def quality_sql(max_docs: int = quality_rules.MAX_DOCS) -> str:
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS line_no, doc_id, source, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT line_no, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place
  FROM (SELECT line_no, regexp_extract_all(text, '{WORD}') AS w FROM docs)
), windows AS (
  SELECT line_no, place, count(*) OVER run AS size, string_agg(word, ' ') OVER run AS content
  FROM words
  WINDOW run AS (PARTITION BY line_no ORDER BY place ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)
), again AS (
  SELECT line_no, place FROM windows WHERE size = 8
  QUALIFY count(*) OVER (PARTITION BY line_no, content) > 1
), covered AS (
  SELECT line_no, count(DISTINCT place + k) AS n_repeat_words FROM again, range(8) AS t(k) GROUP BY line_no
), word_counts AS (
  SELECT line_no, count(*) AS n_words, sum(length(word)) AS word_chars FROM words GROUP BY line_no
), lines AS (
  SELECT line_no, source, text, unnest(l) AS line, unnest(range(len(l))) AS place
  FROM (SELECT line_no, source, text, string_split(text, chr(10)) AS l FROM docs)
), own_lines AS (
  SELECT *, md5(array_to_string(regexp_extract_all(lower(line), '{WORD}'), ' ')) AS normal,
    len(regexp_extract_all(line, '{WORD}')) AS size,
    row_number() OVER (PARTITION BY line_no, line ORDER BY place) AS nth
  FROM lines WHERE regexp_matches(line, '{WORD}')
), repeated AS (
  SELECT line_no, count(*) FILTER (nth > 1) AS n_dup_lines FROM own_lines GROUP BY line_no
), shared AS (
  SELECT source, normal FROM own_lines GROUP BY source, normal HAVING count(DISTINCT text) > {max_docs}
), lost AS (
  SELECT line_no, sum(size) AS lost FROM own_lines JOIN shared USING (source, normal) GROUP BY line_no
), counts AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM docs LEFT JOIN word_counts USING (line_no) LEFT JOIN repeated USING (line_no)
    LEFT JOIN covered USING (line_no) LEFT JOIN lost USING (line_no)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words - lost >= {quality_rules.LEAST_LEFT} * n_words AS kept
FROM judged
"""


ORACLE_SQL["op6_quality_rules"] = quality_sql()

ORACLE_SQL["op1_url_filters"] = """
WITH rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), urls AS (
  SELECT page_id, row_number() OVER () AS line,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), fits AS (
  SELECT line, rule_host || rule_path AS rule, rule_verdict,
    row_number() OVER (PARTITION BY line ORDER BY length(rule_host || rule_path) DESC) AS place
  FROM urls JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM urls LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (line)
"""
