"""Quality rules: shape counts of each text, and lines that many documents of a host share.

Lines are normalised (lower case, runs of white space as one blank), hashed, and counted per host by distinct documents.
Lines above the limits are removed; a document that loses most of its words with them is rejected, as is one that fails
the base rules on repetition and length.

A line is above the limits if more than ``MAX_DOCS`` distinct documents of the host hold it. Documents with the same text are
one, so a text that was copied thousands of times doesn't make its lines boilerplate; near copies are documents of their own.

Defined cases: a null text has no words and fails the base rules; a null host is a host of its own; repeated rows give
repeated result rows, and count as one document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinionloom.functions.binding import column
from opinionloom.llm.arrow_text import in_python, slices, utf8
from opinionloom.session import written

SYMBOLS = b"#*$%&|<>"
WINDOW_WORDS = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
MAX_DOCS = 20
#: A document that keeps less than this share of its words is depleted.
LEAST_LEFT = 0.5

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def repeated_words(words: list[bytes], window: int = WINDOW_WORDS) -> int:
    """How many words lie in a window of ``window`` words that occurs twice or more in the text."""
    if len(words) <= window:
        return 0
    names: dict[bytes, int] = {}
    codes = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    if len(names) == len(words):
        return 0
    # name runs of 1, 2, 4, ... words by pairs of names; the last pair overlaps where the window is no power of two
    size = 1
    while size < window:
        step = min(size, window - size)
        pairs = codes[: len(codes) - step] * (int(codes.max()) + 1) + codes[step:]
        codes = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        size += step
    again = np.bincount(codes)[codes] > 1
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, np.flatnonzero(again), 1)
    np.add.at(marks, np.flatnonzero(again) + window, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def line_hash(words: list[bytes]) -> int:
    """The first 63 bits of the MD5 of a normalised line."""
    return int.from_bytes(hashlib.md5(b" ".join(words)).digest()[:8], "big") >> 1


def measure(text: bytes) -> tuple[int, int, int, int, int, list[int], list[int], list[int]]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a text, and hash, words and number of each line
    that has a word."""
    raw = np.frombuffer(text, np.uint8)
    chars = int(((raw & 0xC0) != 0x80).sum() - _IS_SPACE[raw].sum())
    symbols = int(_IS_SYMBOL[raw].sum())
    words = text.split()
    seen: set[bytes] = set()
    repeats, hashes, sizes, places = 0, [], [], []
    lowered = text.decode().lower().encode().split(b"\n")
    for place, (line, own) in enumerate(zip(text.split(b"\n"), map(bytes.split, lowered), strict=True)):
        if own:
            repeats += line in seen
            seen.add(line)
            hashes.append(line_hash(own))
            sizes.append(len(own))
            places.append(place)
    return len(words), chars, symbols, repeats, repeated_words(words), hashes, sizes, places


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measured(documents: DataFrame, key: str, text: str, host: str) -> DataFrame:
    source = documents.select(
        F.col(key).alias("key"), F.col(host).alias("host"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text")
    )
    kind = source.schema["key"].dataType.simpleString()
    lists = "hashes array<long>, sizes array<int>, places array<int>"

    def run(batches):
        for batch in slices(batches, "text"):
            columns = list(zip(*(measure(t) for t in utf8(batch.column("text"))), strict=True))
            arrays = [batch.column("key"), batch.column("host"), batch.column("text_key")]
            arrays += [pa.array(c, pa.int64()) for c in columns[:5]]
            arrays += [pa.array(columns[5], pa.list_(pa.int64()))] + [pa.array(c, pa.list_(pa.int32())) for c in columns[6:]]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "host", "text_key", *COUNTS, "hashes", "sizes", "places"])

    schema = f"key {kind}, host string, text_key long, {', '.join(c + ' long' for c in COUNTS)}, {lists}"
    return in_python(source.withColumn("host", F.col("host").cast("string")), run, schema)


def frequent_lines(measured: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """Rows ``(host, line)`` of lines above the limit.

    Distinct (host, line, text) come first, so that a line of a third of all rows is never in one group.
    """
    lines = measured.select("host", "text_key", F.explode(F.array_distinct("hashes")).alias("line")).distinct()
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("texts"))
    return counts.filter(F.col("texts") > max_docs).select("host", "line")


def judge(
    documents: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = MAX_DOCS
) -> DataFrame:
    """Rows ``(key, text_key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed, kept)``;
    ``removed`` has the numbers of the text's lines above the limits."""
    measured = written(_measured(documents, key, text, host), "measured")
    frequent = written(frequent_lines(measured, max_docs), "frequent-lines").select(F.col("host").alias("h"), F.col("line").alias("l"))
    lines = measured.select("key", "host", "text_key", F.explode(F.arrays_zip("hashes", "sizes", "places")).alias("z")).select(
        "key", "host", "text_key", F.col("z.hashes").alias("line"), F.col("z.sizes").alias("size"), F.col("z.places").alias("place")
    )
    # the result is per (host, text): rows that repeat a text share it
    lost = (
        lines.join(frequent, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")), "left_semi")
        .groupBy("key", "host", "text_key", "place")
        .agg(F.first("size").alias("size"))
        .groupBy(F.col("key").alias("k"), F.col("host").alias("h"), F.col("text_key").alias("t"))
        .agg(F.sum("size").alias("lost"), F.sort_array(F.collect_list("place")).alias("removed"))
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    same = F.col("key").eqNullSafe(F.col("k")) & F.col("host").eqNullSafe(F.col("h")) & (F.col("text_key") == F.col("t"))
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    return measured.join(lost, same, "left").select(
        F.col("key").alias(key),
        F.col("host"),
        "text_key",
        *COUNTS,
        failed.alias("base_failed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
        (~failed & (left >= LEAST_LEFT * F.col("n_words"))).alias("kept"),
    )


def apply_rules(
    documents: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = MAX_DOCS
) -> DataFrame:
    """The documents that pass, without their lines above the limits; texts that lose no line stay as they are."""
    verdicts = written(judge(documents, key, text, host, max_docs), "verdicts")
    changed = verdicts.filter((~F.col("kept")) | (F.size("removed") > 0))
    marks = changed.groupBy(F.col(key).alias("_k"), F.col("host").alias("_h"), F.col("text_key").alias("_t")).agg(
        F.first("removed").alias("_removed"), F.first("kept").alias("_kept")
    )
    same = (
        documents[key].eqNullSafe(marks["_k"])
        & documents[host].cast("string").eqNullSafe(marks["_h"])
        & (F.xxhash64(documents[text]) == marks["_t"])
    )
    removed = marks["_removed"]
    shortened = F.array_join(
        F.filter(F.split(documents[text], "\n", -1), lambda line, i: ~F.array_contains(removed, i)), "\n"
    )
    new_text = F.when(F.size(removed) > 0, shortened).otherwise(documents[text])
    return (
        documents.join(marks, same, "left")
        .filter(F.coalesce(marks["_kept"], F.lit(True)))
        .select(*(new_text.alias(c) if c == text else documents[column(c)] for c in documents.columns))
    )
