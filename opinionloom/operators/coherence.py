"""Topic coherence c_v (COH1; Roeder, Both and Hinneburg 2015)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinionloom.functions.binding import bind, column
from opinionloom.functions.lookups import MAX_INLINE_ROWS, inline_map, rows_within, word_join
from opinionloom.session import written

TOP_WORDS = 20
WINDOW = 110
EPSILON = 1e-12
# Pseudo word under which the number of windows is counted.
ALL_WINDOWS = -1


def _cover_sql(positions: str, window: int) -> str:
    """How many windows hold at least one of the ascending ``positions``; windows start at 0 to ``last``.

    A word at ``p`` is in the windows that start from ``p - window + 1`` to ``p``; each position adds the part of that
    range its predecessors have not covered.
    """
    added = f"greatest(0, least(p, last) - greatest(p - {window - 1}, acc.upto + 1, 0) + 1)"
    return (
        f"aggregate({positions}, struct(bigint(0) AS n, int(-1) AS upto), "
        f"(acc, p) -> struct(acc.n + bigint({added}) AS n, least(p, last) AS upto), acc -> acc.n)"
    )


def _pair_rows_sql(words: str, size: str, window: int) -> str:
    """SQL of an array of ``(x, y, n)``: per pair of topic words of a text the number of windows with both.

    ``words`` is an array of ``(pos, code, topics)`` of the topic words of a text of ``size`` tokens.
    """
    both = _cover_sql("sort_array(concat(e.pos, f.pos))", window)
    joint = f"struct(least(e.code, f.code) AS x, greatest(e.code, f.code) AS y, e.n + f.n - {both} AS n)"
    later = "filter(slice(entries, i + 2, size(entries)), f -> arrays_overlap(f.topics, e.topics))"
    pairs = (
        "flatten(transform(entries, (e, i) -> "
        f"concat(array(struct(e.code AS x, e.code AS y, e.n AS n)), transform({later}, f -> {joint}))))"
    )
    everything = f"struct({ALL_WINDOWS} AS x, {ALL_WINDOWS} AS y, bigint(last + 1) AS n)"
    entries = (
        "transform(array_distinct(transform(words, w -> struct(w.code AS code, w.topics AS topics))), e -> "
        + bind(
            "transform(filter(words, w -> w.code = e.code), w -> w.pos)",
            "pos",
            f"struct(e.code AS code, e.topics AS topics, pos AS pos, {_cover_sql('pos', window)} AS n)",
        )
        + ")"
    )
    rows = bind(entries, "entries", f"concat(array({everything}), {pairs})")
    return bind(words, "words", bind(f"greatest({size} - {window}, 0)", "last", rows))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("x", "y").agg(F.sum("n").alias("n")).filter(F.col("n") > 0)


def window_pair_counts(
    df: DataFrame,
    words: dict[str, tuple[int, list[int]]],
    tokens_col: str = "topic_tokens",
    window: int = WINDOW,
) -> DataFrame:
    """In how many sliding windows two words of one topic occur together: ``(x, y, n)`` with ``x <= y``.

    ``words`` maps a term to its code and its topics. Windows are not spelled out: the windows with both words are
    those with the first, plus those with the second, less those with either, and each of these numbers follows from
    the word positions alone. A text yields one row per pair of topic words it holds, and pairs are summed per task
    before they are shuffled.
    """
    entry = inline_map({t: {"code": c, "topics": ts} for t, (c, ts) in words.items()}, "struct<code:int,topics:array<int>>")
    tokens = column(tokens_col)
    coded = f"transform({tokens}, (t, i) -> struct(i AS pos, {entry('t')} AS e))"
    found = f"transform(filter({coded}, w -> w.e IS NOT NULL), w -> struct(w.pos AS pos, w.e.code AS code, w.e.topics AS topics))"
    rows = _pair_rows_sql(found, f"size({tokens})", window)
    return _summed(df.filter(F.size(tokens_col) > 0).select(F.expr(f"inline({rows})")))


def window_pair_counts_joined(
    df: DataFrame, words: DataFrame, tokens_col: str = "topic_tokens", window: int = WINDOW, id_col: str = "review_id"
) -> DataFrame:
    """The same for word lists of any length: ``words`` has ``term, code, topics`` and is joined to the tokens."""
    texts = df.filter(F.size(tokens_col) > 0).select(id_col, tokens_col)
    tokens = texts.select(id_col, F.size(tokens_col).alias("size"), F.posexplode(tokens_col).alias("pos", "term"))
    found = (
        word_join(tokens, words, "term", [id_col, "pos"], "left")
        .groupBy(id_col, "size")
        .agg(F.sort_array(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("pos", "code", "topics")))).alias("found"))
    )
    return _summed(found.select(F.expr(f"inline({_pair_rows_sql('found', 'size', window)})")))


def topic_coherence(
    df: DataFrame, topic_words: DataFrame, tokens_col: str = "topic_tokens", window: int = WINDOW
) -> DataFrame:
    """Coherence per topic of ``topic_words (topic, term)``."""
    listed = topic_words.select("topic", "term").distinct()
    rows = rows_within(listed, MAX_INLINE_ROWS)
    if rows is None:
        listed = written(listed, "topic-words")
        # codes only have to differ and to have an order
        coded = listed.select("topic", "term", F.xxhash64("term").alias("code"))
        entries = coded.groupBy("term", "code").agg(F.collect_list(F.xxhash64("topic")).alias("topics"))
        counted = window_pair_counts_joined(df, entries, tokens_col, window)
        members = coded.select("topic", F.col("code").alias("word"))
    else:
        codes = {term: i for i, term in enumerate(sorted({row["term"] for row in rows}))}
        numbers = {topic: i for i, topic in enumerate(sorted({row["topic"] for row in rows}))}
        words: dict[str, tuple[int, list[int]]] = {term: (code, []) for term, code in codes.items()}
        for row in rows:
            words[row["term"]][1].append(numbers[row["topic"]])
        members = df.sparkSession.createDataFrame([(r["topic"], codes[r["term"]]) for r in rows], _member_schema(topic_words))
        counted = window_pair_counts(df, words, tokens_col, window)
    counted = written(counted, "pair-counts")
    total = F.lit(counted.filter(F.col("x") == ALL_WINDOWS).agg(F.max("n")).first()[0])
    p = counted.withColumn("p", F.col("n") / total).filter(F.col("x") != ALL_WINDOWS).select("x", "y", "p")

    single = p.filter(F.col("x") == F.col("y"))
    cells = members.withColumnRenamed("word", "i").join(members.withColumnRenamed("word", "j"), "topic")
    cells = (
        cells.withColumn("x", F.least("i", "j")).withColumn("y", F.greatest("i", "j"))
        .join(p.withColumnRenamed("p", "p_ij"), ["x", "y"], "left")
        .join(single.select(F.col("x").alias("i"), F.col("p").alias("p_i")), "i", "left")
        .join(single.select(F.col("x").alias("j"), F.col("p").alias("p_j")), "j", "left")
    )
    joint = F.coalesce("p_ij", F.lit(0.0)) + EPSILON
    npmi = F.log(joint / (F.col("p_i") * F.col("p_j"))) / -F.log(joint)
    cells = cells.select("topic", "i", "j", F.coalesce(npmi, F.lit(0.0)).alias("v"))
    sums = cells.groupBy("topic", "j").agg(F.sum("v").alias("s"))
    lengths = F.sqrt(F.sum(F.col("v") * F.col("v"))) * F.sqrt(F.sum(F.col("s") * F.col("s")))
    cosine = F.coalesce(F.try_divide(F.sum(F.col("v") * F.col("s")), lengths), F.lit(0.0))
    cosines = cells.join(sums, ["topic", "j"]).groupBy("topic", "i").agg(cosine.alias("cosine"))
    return cosines.groupBy("topic").agg(F.avg("cosine").alias("coherence"))


def _member_schema(topic_words: DataFrame) -> str:
    return f"topic {topic_words.schema['topic'].dataType.simpleString()}, word int"


def mean_coherence(per_topic: DataFrame) -> DataFrame:
    return per_topic.agg(F.avg("coherence").alias("coherence"))
