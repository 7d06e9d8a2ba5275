"""Word classes by a hidden Markov model that is trained on weak labels.

Words of the closed classes have their class from a table, others from a suffix where it says enough; the rest stays open. The
labelled words of all sentences give counts of class pairs and of what is observed with each class: the word
itself in a closed class, otherwise its last letters. Logarithms of the smoothed counts, in whole thousandths, are the
model: a table of a few classes, and one row per observed ending, which the number of possible endings bounds. A sentence
gets the sequence of classes with the largest sum (Viterbi); among equal sums the one with the earliest class at the last
place where they differ, and so on towards the front.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionloom import wordlists
from opinionloom.functions.lookups import inline_map
from opinionloom.session import python_tasks

ENDING = 3
SCALE = 1000
SENTENCE_END = r"[.!?\n]+"


def sentences(df: DataFrame, text_col: str, id_col: str = "review_id") -> DataFrame:
    """Rows ``(id, sentence, words)``: lower-case words of plain letters, sentences without one left out."""
    parts = df.select(F.col(id_col), F.posexplode(F.split(F.lower(F.col(text_col)), SENTENCE_END)).alias("sentence", "_text"))
    words = F.regexp_extract_all("_text", F.lit("[a-z]+"), F.lit(0))
    return parts.select(id_col, "sentence", words.alias("words")).filter(F.size("words") > 0)


def weak_label_sql(word: str) -> str:
    """Class of a closed word, else of the longest telling suffix, else null."""
    closed = inline_map(wordlists.CLOSED_CLASSES, "string")(word)
    suffixes = sorted(wordlists.SUFFIX_CLASSES.items(), key=lambda s: (-len(s[0]), s[0]))
    tests = " ".join(f"WHEN length({word}) > {len(s) + 2} AND endswith({word}, '{s}') THEN '{tag}'" for s, tag in suffixes)
    return f"coalesce({closed}, CASE {tests} END)"


def observation_sql(word: str) -> str:
    """The word itself in a closed class, otherwise a hyphen and its last letters."""
    closed = inline_map(wordlists.CLOSED_CLASSES, "string")(word)
    return f"CASE WHEN {closed} IS NOT NULL THEN {word} ELSE '-' || right({word}, {ENDING}) END"


@dataclass
class Tagger:
    """Scores in thousandths: of a first class, of a class after another, and of an observation with each class."""

    tags: list[str]
    first: np.ndarray
    follows: np.ndarray
    observed: dict[str, list[int]]
    unknown: np.ndarray

    def tag(self, words_col: str) -> Column:
        """The classes of a word list, as a column."""
        names = list(self.observed)
        scores = np.array([self.observed[n] for n in names], np.int64).reshape(-1, len(self.tags))
        known = python_tasks(SparkSession.active()).broadcast((self.tags, self.first, self.follows, names, scores, self.unknown))

        @F.arrow_udf("array<string>")
        def tagged(lists: pa.Array) -> pa.Array:
            tags, first, follows, names, scores, unknown = known.value
            flat = lists.flatten()
            at = pc.fill_null(pc.index_in(flat, value_set=pa.array(names, flat.type)), len(names)).to_numpy(zero_copy_only=False)
            emitted = np.concatenate((scores, unknown[None]))[at]
            starts = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
            found = viterbi(starts, emitted, first, follows)
            return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(tags, pa.string()).take(pa.array(found)))

        return tagged(F.expr(f"transform({words_col}, w -> {observation_sql('w')})"))


def viterbi(starts: np.ndarray, emitted: np.ndarray, first: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Best classes of sequences ``starts[i]:starts[i + 1]``; all sequences take a step together, longest first."""
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    begin, left = starts[:-1][order], sizes[order]
    back = np.zeros(emitted.shape, np.int8)
    best = np.zeros(len(emitted), np.int64)
    scores = first + emitted[begin]
    last = np.zeros((len(order), len(first)), np.int64)
    for step in range(1, int(left.max(initial=0)) + 1):
        n = int(np.searchsorted(-left, -step, side="left"))  # those longer than the steps done
        last[n : len(scores)] = scores[n:]
        if not n:
            break
        paths = scores[:n, :, None] + follows
        back[begin[:n] + step] = paths.argmax(1)
        scores = paths.max(1) + emitted[begin[:n] + step]
    if len(order):
        tag = last.argmax(1)
        ends = begin + left - 1
        for step in range(int(left.max())):
            n = int(np.searchsorted(-left, -step, side="left"))
            best[ends[:n] - step] = tag[:n]
            tag = back[ends[:n] - step, tag[:n]].astype(np.int64)
    return best


def label_counts(sentence_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weakly labelled words counted: rows ``(before, tag, n)``, where ``before`` is null at the start of a sentence and pairs
    with an open word are left out, and rows ``(observation, tag, n)``."""
    labelled = F.expr(f"transform(words, w -> named_struct('o', {observation_sql('w')}, 't', {weak_label_sql('w')}))")
    rows = sentence_rows.select(labelled.alias("w"))
    pairs = rows.select(F.explode(F.expr("transform(w, (x, i) -> named_struct('i', i, 'before', get(w, i - 1).t, 'tag', x.t))")).alias("p"))
    pairs = pairs.select("p.*").filter("tag IS NOT NULL AND (i = 0 OR before IS NOT NULL)")
    follows = pairs.groupBy("before", "tag").agg(F.count(F.lit(1)).alias("n"))
    seen = rows.select(F.explode("w").alias("x")).select(F.col("x.o").alias("observation"), F.col("x.t").alias("tag"))
    return follows, seen.filter("tag IS NOT NULL").groupBy("observation", "tag").agg(F.count(F.lit(1)).alias("n"))


def train_tagger(sentence_rows: DataFrame) -> Tagger:
    """Fit the model; the counts that come to the driver are bounded by the classes, closed words and possible endings."""
    follows, seen = label_counts(sentence_rows)
    tags = sorted({*wordlists.CLOSED_CLASSES.values(), *wordlists.SUFFIX_CLASSES.values()})
    place = {t: i for i, t in enumerate(tags)}
    k = len(tags)
    counts = np.zeros((k + 1, k))
    for r in follows.collect():
        counts[k if r["before"] is None else place[r["before"]], place[r["tag"]]] = r["n"]
    rows = seen.collect()
    names = sorted({r["observation"] for r in rows})
    totals = np.zeros(k)
    own = {name: [0] * k for name in names}
    for r in rows:
        own[r["observation"]][place[r["tag"]]] = r["n"]
        totals[place[r["tag"]]] += r["n"]

    def score(n: float, of: float, among: int) -> int:
        return round(SCALE * math.log((n + 1) / (of + among)))

    moves = np.array([[score(n, row.sum(), k) for n in row] for row in counts], np.int64)
    observed = {name: [score(n, totals[i], len(names) + 1) for i, n in enumerate(ns)] for name, ns in own.items()}
    unknown = np.array([score(0, totals[i], len(names) + 1) for i in range(k)], np.int64)
    return Tagger(tags, moves[k], moves[:k], observed, unknown)


def tagged_tokens(sentence_rows: DataFrame, tagger: Tagger, id_col: str = "review_id") -> DataFrame:
    """Rows ``(id, sentence, pos, term, tag)``."""
    both = sentence_rows.withColumn("_tags", tagger.tag("words"))
    return both.select(id_col, "sentence", F.posexplode(F.arrays_zip("words", "_tags")).alias("pos", "_w")).select(
        id_col, "sentence", "pos", F.col("_w.words").alias("term"), F.col("_w._tags").alias("tag")
    )
