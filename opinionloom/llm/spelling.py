"""Spelling variants: words one edit apart, found by signatures of their letters.

A word's letters are a binary vector with a dimension for every (letter, how often it came before). Words one edit apart differ
in at most two dimensions: in exactly two if a letter is replaced, in one if a letter is inserted or deleted. The
dimensions are dealt into parts by a hash. Vectors that differ in ``k`` of ``n`` parts at most agree on some ``n - k`` parts
together, so every choice of ``n - k`` parts gives a signature, the hash of what the word has there (partition and
enumerate). Words that share a signature are candidates; whether they are one edit apart is then checked exactly.

Many words are made of the same letters in another order. So a signature also holds the length of the shorter word and one half
of the word as it is: one edit leaves the letters before its place or those behind it unchanged, thus the first half or
the last. Signatures are 64-bit hashes; two that are equal by chance cost a check and nothing else.

The signature of words of one length is joined with itself; that of words of different lengths has one role for the shorter
and one for the longer word.

Defined cases: a null or empty text has no words. Repeated rows count each. A null key is an empty one in the hash that
decides about deletions. An empty table gives no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinionloom.llm.arrow_text import in_python, slices, utf8
from opinionloom.session import written

LEAST_LENGTH = 7
LEAST_COUNT = 2
#: Of so many (document, word) pairs one loses a letter.
DELETED = 31
#: A word's form is so many times as frequent.
RATIO = 10
#: Parts of the dimensions, for words of one length (two dimensions differ) and of different lengths (one does).
PARTS = (4, 2)
SLICE_BYTES = 16 << 20
_LETTERS = "A-Za-zÀ-ÿ"


def misspelled(key: str, word: str) -> str:
    """The word, without one letter if the hash of key and word says so."""
    h = zlib.crc32(f"{key}:{word}".encode())
    if h % DELETED:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def count_words(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
) -> DataFrame:
    """Rows ``(word, n)``: words of the texts, some without a letter, that are long and frequent enough.

    Every task counts what it reads, slice by slice, before anything is shuffled.
    """
    source = documents.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text"))
    long_runs = re.compile(f"[{_LETTERS}]{{{least_length},}}")

    def run(batches):
        for batch in slices(batches, "text", SLICE_BYTES):
            total: Counter[str] = Counter()
            for name, body in zip(batch.column("key").to_pylist(), utf8(batch.column("text")), strict=True):
                # bytes.lower leaves all but A-Z alone
                own = Counter(long_runs.findall(body.lower().decode()))
                start = zlib.crc32(f"{name}:".encode())
                for word, n in own.items():
                    if zlib.crc32(word.encode(), start) % DELETED == 0:
                        word = misspelled(name, word)
                        if len(word) < least_length:
                            continue
                    total[word] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"]
            )

    counted = in_python(source, run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers (the finaliser of splitmix64)."""
    x = values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(values: np.ndarray) -> np.ndarray:
    """Sums, modulo 2**64, of the first 0, 1, 2, ... values; the sum of a run is a difference of two."""
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))


def signatures(words: list[str], parts: tuple[int, int] = PARTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of each word, a row per word: to meet words of its length, longer words, shorter words."""
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    rows = np.repeat(np.arange(n), lengths)
    at = (np.arange(len(letters)) - starts[rows]).astype(np.uint64)
    from_end = (ends[rows] - 1 - np.arange(len(letters))).astype(np.uint64)
    # dimensions: each letter with its number among equal letters of the word
    order = np.lexsort((letters, rows))
    same = np.ones(len(letters), bool)
    same[1:] = (letters[order][1:] != letters[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    firsts = np.flatnonzero(same)
    number = np.arange(len(letters)) - np.repeat(firsts, np.diff(np.append(firsts, len(letters))))
    dimensions = _mixed(letters[order] << np.uint64(32) | number.astype(np.uint64))
    prefix = _sums(_mixed(letters << np.uint64(32) | at))
    suffix = _sums(_mixed(letters << np.uint64(32) | from_end))

    def halves(length: np.ndarray) -> list[np.ndarray]:
        """Hashes of the first half and of the last, as a word of this length (or its neighbour) has them."""
        half = length // 2
        return [prefix[starts + half] - prefix[starts], suffix[ends] - suffix[ends - (length - half)]]

    def signed(n_parts: int, k: int, roles: list[np.ndarray]) -> list[np.ndarray]:
        sums = np.zeros((n, n_parts), np.uint64)
        np.add.at(sums, (rows[order], (_mixed(dimensions) % np.uint64(n_parts)).astype(np.int64)), dimensions)
        out: list[list[np.ndarray]] = [[] for _ in roles]
        for number_of, chosen in enumerate(combinations(range(n_parts), n_parts - k)):
            base = np.full(n, k * 1000 + number_of, np.uint64)
            for part in chosen:
                base = _mixed(base ^ sums[:, part])
            for own, length in zip(out, roles, strict=True):
                tagged = _mixed(base ^ length.astype(np.uint64))
                own += [_mixed(tagged ^ _mixed(half + np.uint64(side))) for side, half in enumerate(halves(length))]
        return [np.stack(own, 1).view(np.int64) for own in out]

    (same_length,) = signed(parts[0], 2, [lengths])
    shorter, longer = signed(parts[1], 1, [lengths, lengths - 1])
    return same_length, shorter, longer


def near_words(words: DataFrame, word: str = "word", parts: tuple[int, int] = PARTS) -> DataFrame:
    """Rows ``(word, near)`` for every ordered pair of distinct words exactly one insertion, deletion or replacement apart."""
    kinds = ("same_length", "shorter", "longer")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                found = signatures(batch.column("word").to_pylist(), parts)
                lists = [pa.array(list(s), pa.list_(pa.int64())) for s in found]
                yield pa.RecordBatch.from_arrays([batch.column("word"), *lists], ["word", *kinds])

    source = words.filter(F.length(word) > 0).select(F.col(word).alias("word")).distinct()
    signed = written(in_python(source, run, f"word string, {', '.join(f'{k} array<long>' for k in kinds)}"), "signatures")

    def role(kind: str, name: str) -> DataFrame:
        return signed.select(F.explode(kind).alias("signature"), F.col("word").alias(name))

    equal = role("same_length", "u").join(role("same_length", "v"), "signature").filter("u < v")
    unequal = role("shorter", "u").join(role("longer", "v"), "signature")
    one_edit = F.levenshtein("u", "v", 1) == 1
    pairs = equal.filter(one_edit).union(unequal.filter(one_edit)).select("u", "v").distinct()
    both = F.array(*(F.struct(F.col(a).alias("word"), F.col(b).alias("near")) for a, b in (("u", "v"), ("v", "u"))))
    return pairs.select(F.inline(both))


def variant_groups(words: DataFrame, ratio: int = RATIO, parts: tuple[int, int] = PARTS) -> DataFrame:
    """Rows ``(word, form, root, n, n_near, form_n)`` for rows ``(word, n)`` of distinct words.

    The form is the near word of largest ``n`` (ties: the smallest) if it is ``ratio`` times as frequent; the root is where
    the forms lead. Each step multiplies ``n`` by ``ratio``, and a round follows twice as many steps as the one before, so
    a few rounds do. No word has more near words than there are edits of it.
    """
    words = words.select("word", "n")
    near = near_words(words, parts=parts).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best")
    )
    form = F.when(-F.col("best.order") >= ratio * F.col("n"), F.col("best.near"))
    judged = written(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form.alias("form"),
            F.when(form.isNotNull(), -F.col("best.order")).alias("form_n"),
        ),
        "variants",
    )
    roots = written(judged.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        followed = written(
            roots.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), "further"), "roots"
        )
        if followed.filter("further is not null").isEmpty():
            break
        roots = followed.drop("further")
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The words of all documents with their forms: rows ``(word, form, root, n, n_near, form_n)``."""
    return variant_groups(written(count_words(documents, key, text), "words"))
