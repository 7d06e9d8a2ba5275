"""A sentiment lexicon for the corpus at hand: labels spread from seed words over a graph of words that go together.

Two words go together where one stands at most ``WINDOW`` tokens after the other. An edge is kept if the pair is seen ``min_pairs``
times and more and at least twice as often as chance would have it; its weight is the whole bits of that ratio (pointwise
mutual information, cut to an integer). Positive and negative seeds hold a mass each, in proportion to their valence and
equal in sum. In every round a word hands its masses on to its neighbours in proportion to the edges' weights, and a part of
what arrives goes back to the seeds (random walks with restart). A word's score is how far one mass outweighs the other, so
that frequent words that go with everything stay near zero.

Of the pairs, which are many times the tokens, only numbers move: a first pass over the tokens gives for every word its pairs and
a bound for those with any one other word. Words whose bound is below ``min_pairs`` have no edge; the others are numbered and
given to every task, which counts pairs of numbers part by part before they are shuffled. Where their dictionary is
longer than ``arrow_lists.DICTIONARY_BYTES``, pairs of words are counted instead.

All figures are integers: the result doesn't depend on partitions. The graph is joined edge by edge with the words' masses; hubs
are hot keys of that join, which ``word_join`` broadcasts or salts. Every round is written, so a lost executor costs a re-read.

Defined cases: null token lists are empty; a word next to itself is no pair; seeds that aren't in the graph have no mass but stay in the
lexicon; without a seed of one sign all scores point the other way; an empty corpus gives the seeds alone.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinionloom.functions import arrow_lists
from opinionloom.functions.arrow_lists import parts, places
from opinionloom.functions.lookups import one_row_per_key, word_join
from opinionloom.session import python_tasks, written

WINDOW = 5
MIN_PAIRS = 5
ROUNDS = 4
#: Sum of the seeds' masses of each sign; times the bits of a weight it stays within a long.
MASS = 10**15
#: Percent of the arriving mass that stays; the rest goes back to the seeds.
KEEP_PERCENT = 85
SCORE_UNITS = 1000
MIN_SCORE = 300
#: Token lists, and tokens, whose pairs are counted at a time in a task.
PART_DOCS, PART_TOKENS = 20_000, 1 << 21
#: Pairs, repeats included, that a task is meant to add up.
TASK_PAIRS = 8_000_000
#: Valence of a word all of whose mass has one sign, in tenths.
TOP_VALENCE = 30


def pair_counts(df: DataFrame, tokens_col: str = "tokens", window: int = WINDOW) -> DataFrame:
    """Rows ``(a, b, n)`` with ``a < b``: how often the two stand within ``window`` tokens of each other."""
    ahead = f"slice({tokens_col}, i + 2, {window})"
    pairs = (
        f"flatten(transform(sequence(0, size({tokens_col}) - 2), i -> transform({ahead}, "
        f"w -> struct(least(w, {tokens_col}[i]) AS a, greatest(w, {tokens_col}[i]) AS b))))"
    )
    listed = df.filter(F.size(F.coalesce(F.col(tokens_col), F.array())) > 1).select(F.inline(F.expr(pairs)))
    return listed.filter("a != b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def word_graph(pairs: DataFrame, min_pairs: int = MIN_PAIRS) -> DataFrame:
    """Rows ``(a, b, weight)`` in both directions from written pair counts."""
    both = pairs.select(F.inline(F.expr("array(struct(a, b, n), struct(b AS a, a AS b, n))")))
    ends = written(both.groupBy("a").agg(F.sum("n").alias("ends")).withColumnRenamed("a", "term"), "word-ends")
    total = ends.agg(F.sum("ends")).first()[0] or 0
    often = pairs.filter(F.col("n") >= min_pairs)
    of = lambda side: ends.select(F.col("term").alias(side), F.col("ends").alias(f"ends_{side}"))
    known = word_join(word_join(often, of("a"), "a", ["b"]), of("b"), "b", ["a"])
    return _edges(known, total)


def _edges(known: DataFrame, total: int) -> DataFrame:
    """Edges in both directions from pairs ``(a, b, n, ends_a, ends_b)``."""
    exact = lambda name: F.col(name).cast("decimal(19,0)")
    weighed = (
        known.select("a", "b", (exact("n") * F.lit(total).cast("decimal(19,0)")).alias("up"),
                     (exact("ends_a") * exact("ends_b")).alias("down"))
        .withColumn("weight", F.expr("length(bin(up div down)) - 1"))
        .filter("weight >= 1")
    )
    return weighed.select(F.inline(F.expr("array(struct(a, b, weight), struct(b AS a, a AS b, weight))")))


def _near(codes: np.ndarray, docs: np.ndarray, k: int) -> np.ndarray:
    """Which tokens pair with the one ``k`` behind them."""
    a, b = codes[:-k], codes[k:]
    return (docs[:-k] == docs[k:]) & (a != b) & (a >= 0) & (b >= 0)


def word_figures(df: DataFrame, tokens_col: str = "tokens", window: int = WINDOW) -> DataFrame:
    """Rows ``(term, ends, most)``: in how many pairs a word stands, and a bound for its pairs with any one other word.

    Of one token's neighbours no word is met more often than once and once for each that is also among the ``2 * window`` tokens
    before it.
    """
    python_tasks(df.sparkSession)

    def run(batches):
        for batch in batches:
            for at, n in parts(batch.column("tokens"), PART_DOCS, PART_TOKENS):
                lists = batch.column("tokens").slice(at, n)
                docs = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
                named = lists.flatten().dictionary_encode()
                codes = named.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                ends, again = np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
                for k in range(1, min(2 * window, len(codes) - 1) + 1):
                    again[k:] |= (codes[:-k] == codes[k:]) & (docs[:-k] == docs[k:])
                    if k <= window:
                        near = _near(codes, docs, k)
                        ends[:-k] += near
                        ends[k:] += near
                before = np.concatenate(([0], np.cumsum(again)))
                place = np.arange(len(codes))
                repeats = before[np.minimum(place + window + 1, len(codes))] - before[np.maximum(place - window, 0)]
                known, size = codes >= 0, len(named.dictionary)
                sums = [
                    np.bincount(codes[known], weights=v[known], minlength=size).astype(np.int64)
                    for v in (ends, np.minimum(ends, 1 + repeats))
                ]
                yield pa.RecordBatch.from_arrays([named.dictionary, *map(pa.array, sums)], ["term", "ends", "most"])

    source = df.select(F.col(tokens_col).alias("tokens")).filter(F.size(F.coalesce("tokens", F.array())) > 1)
    figures = source.mapInArrow(run, "term string, ends long, most long")
    return figures.groupBy("term").agg(F.sum("ends").alias("ends"), F.sum("most").alias("most")).filter("ends > 0")


def numbered_pairs(df: DataFrame, known, total: int, tokens_col: str = "tokens", window: int = WINDOW) -> DataFrame:
    """Rows ``(pair, n)`` over the words of a dictionary: the pair's smaller place times ``2 ** 32`` and the larger one.

    What a task has counted holds hardly a pair twice, so it is not counted again before the shuffle.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-total // (2 * TASK_PAIRS)))

    def run(batches):
        for batch in batches:
            lists = batch.column("tokens")
            codes = places(lists.flatten(), known.value[0])
            docs = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            for at, n in parts(lists, PART_DOCS, PART_TOKENS):
                begin, end = np.searchsorted(docs, (at, at + n))
                own, doc, found = codes[begin:end], docs[begin:end], []
                for k in range(1, min(window, len(own) - 1) + 1):
                    near = _near(own, doc, k)
                    a, b = own[:-k][near], own[k:][near]
                    found.append(np.minimum(a, b) << 32 | np.maximum(a, b))
                pairs = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
                first = np.flatnonzero(np.diff(pairs, prepend=-1))
                counts = np.diff(np.append(first, len(pairs)))
                for part in range(0, len(first), 1 << 18):
                    rows = slice(part, part + (1 << 18))
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[first[rows]]), pa.array(counts[rows].astype(np.int32))], ["pair", "n"])

    source = df.select(F.col(tokens_col).alias("tokens")).filter(F.size(F.coalesce("tokens", F.array())) > 1)
    return source.mapInArrow(run, "pair long, n int").repartition(tasks, "pair").groupBy("pair").agg(F.sum("n").alias("n"))


def numbered_graph(df: DataFrame, words: DataFrame, total: int, tokens_col: str, window: int, min_pairs: int) -> DataFrame:
    """The graph of ``word_graph`` from token lists and the words that can have an edge, ``(term, ends)``."""
    known = arrow_lists.dictionary(words.select("term", "ends"))
    often = numbered_pairs(df, known, total, tokens_col, window).filter(F.col("n") >= min_pairs)

    def run(batches):
        terms, ends = known.value[0], known.value[1].to_numpy(zero_copy_only=False)
        for batch in batches:
            pairs, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "n"))
            a, b = pairs >> 32, pairs & 0xFFFFFFFF
            # a little less than the limit, which is tested on whole numbers
            near = n * float(total) >= 1.99 * ends[a].astype(np.float64) * ends[b]
            a, b = a[near], b[near]
            columns = [terms.take(pa.array(a)), terms.take(pa.array(b)), *map(pa.array, (n[near], ends[a], ends[b]))]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "n", "ends_a", "ends_b"])

    return _edges(often.mapInArrow(run, "a string, b string, n long, ends_a long, ends_b long"), total)


def text_graph(df: DataFrame, tokens_col: str = "tokens", window: int = WINDOW, min_pairs: int = MIN_PAIRS) -> DataFrame:
    """Rows ``(a, b, weight)`` in both directions for the words of token lists."""
    figures = written(word_figures(df, tokens_col, window), "word-figures")
    words = figures.filter(F.col("most") >= min_pairs).select("term", "ends")
    if arrow_lists.arrow_bytes(words) <= arrow_lists.DICTIONARY_BYTES:
        total = figures.agg(F.sum("ends")).first()[0] or 0
        return numbered_graph(df, words, total, tokens_col, window, min_pairs)
    return word_graph(written(pair_counts(df, tokens_col, window), "word-pairs"), min_pairs)


def seeded(graph: DataFrame, seeds: DataFrame) -> DataFrame:
    """Rows ``(term, links, bits, seed_up, seed_down)``: every word of the graph with its edges and its share of the seeds' mass."""
    nodes = graph.groupBy("a").agg(F.count(F.lit(1)).alias("links"), F.sum("weight").alias("bits")).withColumnRenamed("a", "term")
    known = written(nodes.join(seeds.select("term", "valence_tenths"), "term", "left"), "seeded-words")
    up = F.greatest(F.coalesce(F.col("valence_tenths"), F.lit(0)), F.lit(0)).cast("long")
    down = F.greatest(F.coalesce(-F.col("valence_tenths"), F.lit(0)), F.lit(0)).cast("long")
    sums = known.agg(F.sum(up), F.sum(down)).first()
    share = lambda part, total: F.expr(f"{part} * {MASS // 1000}L div {max(total or 0, 1)}L * 1000L")
    parts = known.withColumn("_up", up).withColumn("_down", down)
    return parts.select(
        "term", "links", "bits", share("_up", sums[0]).alias("seed_up"), share("_down", sums[1]).alias("seed_down")
    )


def spread_masses(graph: DataFrame, words: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Rows ``(term, links, up, down)`` after ``rounds`` rounds; ``graph`` and ``words`` are written tables."""
    masses = words.select("*", F.col("seed_up").alias("up"), F.col("seed_down").alias("down"))
    for turn in range(rounds):
        senders = masses.filter("up + down > 0").select(F.col("term").alias("b"), "bits", "up", "down")
        sent = word_join(graph, senders, "b", ["a"])
        arrived = sent.groupBy("a").agg(
            F.sum(F.expr("(up div bits) * weight")).alias("up"), F.sum(F.expr("(down div bits) * weight")).alias("down")
        )
        mixed = lambda sign: F.expr(
            f"coalesce({sign}, 0L) div 100 * {KEEP_PERCENT} + seed_{sign} div 100 * {100 - KEEP_PERCENT}"
        ).alias(sign)
        settled = words.join(arrived.withColumnRenamed("a", "term"), "term", "left")
        masses = written(settled.select(*words.columns, mixed("up"), mixed("down")), f"masses-{turn}")
    return masses.select("term", "links", "up", "down")


def induced_lexicon(
    df: DataFrame,
    seeds: DataFrame | Mapping[str, int],
    tokens_col: str = "tokens",
    window: int = WINDOW,
    min_pairs: int = MIN_PAIRS,
    rounds: int = ROUNDS,
    min_score: int = MIN_SCORE,
) -> DataFrame:
    """SEN1: rows ``(term, valence_tenths, score, links, induced)``: the seeds with their own valence, and the words of the corpus
    whose score of at most 1,000 is ``min_score`` away from zero.

    ``seeds`` is a lexicon: a table ``(term, valence_tenths)``, of whose repeated terms the smallest valence counts, or a
    mapping. The first two columns are a lexicon again.
    """
    spark = df.sparkSession
    if isinstance(seeds, Mapping):
        seeds = spark.createDataFrame(list(seeds.items()), "term string, valence_tenths int")
    given = one_row_per_key(seeds.select("term", F.col("valence_tenths").cast("int")))
    graph = written(text_graph(df, tokens_col, window, min_pairs), "word-graph")
    masses = spread_masses(graph, written(seeded(graph, given), "seed-masses"), rounds)
    score = F.expr(f"cast(up * {2 * SCORE_UNITS} div (up + down) - {SCORE_UNITS} AS int)")
    scored = masses.filter("up + down > 0").select("term", "links", score.alias("score"))
    strength = F.expr(f"cast(abs(score) * {TOP_VALENCE} div {SCORE_UNITS} * sign(score) AS int)")
    joined = scored.join(given, "term", "full")
    kept = joined.filter(F.col("valence_tenths").isNotNull() | (F.abs("score") >= min_score))
    return kept.select(
        "term",
        F.coalesce("valence_tenths", strength).alias("valence_tenths"),
        "score",
        F.coalesce("links", F.lit(0)).alias("links"),
        F.col("valence_tenths").isNull().alias("induced"),
    )
