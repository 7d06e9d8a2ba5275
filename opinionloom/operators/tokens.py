"""Token lists: stop words, lemmas, length and size rules."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinionloom import wordlists
from opinionloom.functions import lookups
from opinionloom.functions.binding import column, pin
from opinionloom.functions.lookups import (
    MAX_INLINE_ROWS,
    inline_map,
    membership,
    one_row_per_key,
    rows_within,
    table_bytes,
    table_to_dict,
    word_join,
)
from opinionloom.schemas import require_columns
from opinionloom.session import written

MIN_TOKEN_CHARS = 3
MIN_TOKENS = 3
#: Words used more often are told apart no further when a word table is cut.
MOST_USES = 1_000
# A word with a digit or an underscore is not alphabetic. Possessive, so that a long word is read once.
NON_ALPHABETIC_WORD = r"(?<!\w)[a-z]*+[0-9_]\w*+"


def stop_words(*lists: Iterable[str]) -> list[str]:
    """NLP3, SET2: union of stop lists; without arguments the general English and the shop list."""
    chosen = lists or (wordlists.ENGLISH_STOP_WORDS, wordlists.SHOP_STOP_WORDS)
    return sorted(set().union(*chosen))


def stop_word_table(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """SET2 for stop lists kept as tables ``(term)``."""
    for table in tables:
        df = df.unionByName(table)
    return df.distinct()


def alphabetic_words_sql(text: str) -> str:
    """Lower-case words of a cleaned text that consist of letters only."""
    spaced = rf"regexp_replace(lower(coalesce({text}, '')), r'{NON_ALPHABETIC_WORD}', '')"
    return f"filter(split({spaced}, ' '), word -> word != '')"


def drop_words_sql(tokens: str, stops: Iterable[str], min_chars: int = MIN_TOKEN_CHARS) -> str:
    """JOIN4, ARR1: tokens outside a stop list and at least ``min_chars`` long, repeats kept."""
    return f"filter({tokens}, word -> length(word) >= {min_chars} AND NOT {membership(stops)('word')})"


def drop_words(tokens_col: str, stops: Iterable[str], min_chars: int = MIN_TOKEN_CHARS) -> Column:
    return F.expr(drop_words_sql(column(tokens_col), stops, min_chars))


def token_column(text_col: str, stops: Iterable[str], lemmas: Mapping[str, str]) -> Column:
    """Token list of a cleaned text: both the word and its lemma must be outside the stop list."""
    stops = list(stops)
    words = f"filter({alphabetic_words_sql(column(text_col))}, word -> NOT {membership(stops)('word')})"
    if lemmas:
        words = f"transform({words}, word -> coalesce({inline_map(lemmas, 'string')('word')}, word))"
    return F.expr(drop_words_sql(words, stops))


def _finish(df: DataFrame) -> DataFrame:
    return (
        df.filter(F.size("tokens") >= MIN_TOKENS)
        .withColumn("review_normalized", F.array_join("tokens", " "))
        .withColumn("token_count", F.size("tokens"))
    )


def normalize_reviews(
    df: DataFrame,
    text_col: str = "review_clean",
    stops: Iterable[str] | DataFrame | None = None,
    lemmas: Mapping[str, str] | DataFrame | None = None,
    id_col: str = "review_id",
) -> DataFrame:
    """NLP2: add ``review_normalized``, ``tokens``, ``token_count``; keep rows with three tokens or more.

    Word tables short enough to be folded into the plan are looked up in place. Longer ones are joined.
    """
    require_columns(df, [text_col])
    stops = stop_words() if stops is None else stops
    lemmas = wordlists.LEMMAS if lemmas is None else lemmas
    spark = df.sparkSession
    if isinstance(stops, DataFrame):
        rows = rows_within(stops, MAX_INLINE_ROWS)
        stop_list = None if rows is None else [row[0] for row in rows]
    else:
        stop_list = list(stops)
    lemma_map = table_to_dict(lemmas)
    if stop_list is not None and lemma_map is not None:
        return _finish(pin(df, tokens=token_column(text_col, stop_list, lemma_map)))
    stop_df = stops if isinstance(stops, DataFrame) else spark.createDataFrame([(w,) for w in stop_list], "term string")
    lemma_df = (
        lemmas if isinstance(lemmas, DataFrame) else spark.createDataFrame(list(lemmas.items()), "form string, lemma string")
    )
    return normalize_by_join(df, stop_df, lemma_df, text_col, id_col)


def normalize_by_join(
    df: DataFrame, stops: DataFrame, lemmas: DataFrame, text_col: str = "review_clean", id_col: str = "review_id"
) -> DataFrame:
    """NLP2 for word tables of any size.

    The reviews are written once, then read for their words and for the result. What becomes of a word form (dropped, or
    its lemma) is settled between the two word tables; one join then serves all words. Texts are dealt out by id before they are
    cut into words, which are many times their size. Of word tables too long to be broadcast the frequent words are, so that
    only rare words move to be joined with the rest.
    """
    terms = stops.toDF("form").filter("form is not null").distinct()
    lemma_rows = one_row_per_key(lemmas.toDF("form", "lemma"))
    bad_lemma = terms.select(F.col("form").alias("lemma"), F.lit(True).alias("_bad"))
    fates = (
        terms.withColumn("_stop", F.lit(True))
        .join(lemma_rows, "form", "full")
        .join(bad_lemma, "lemma", "left")
        .select("form", F.when(F.col("_stop").isNull() & F.col("_bad").isNull(), F.col("lemma")).alias("_fate"))
        .withColumn("_listed", F.lit(True))
    )
    settled, fates = written(df, "tokenized-text"), written(fates, "word-fates")
    texts = settled.filter(F.col(column(id_col)).isNotNull()).select(id_col, text_col).repartition(column(id_col))
    words = texts.select(id_col, F.posexplode(F.expr(alphabetic_words_sql(column(text_col)))).alias("_pos", "form"))
    known, rare = (fates, None) if table_bytes(fates) <= lookups.BROADCAST_BYTES else _by_use(words, fates)
    final = F.when(F.col("_listed"), F.col("_fate")).otherwise(F.col("form"))
    kept = F.when(F.length(final) >= MIN_TOKEN_CHARS, F.struct("_pos", final.alias("form")))
    if rare is None:
        own = words.join(F.broadcast(known), "form", "left").groupBy(id_col).agg(F.collect_list(kept).alias("_own"))
    else:
        met = F.col("_met").isNotNull()
        parts = words.join(F.broadcast(known), "form", "left").groupBy(id_col).agg(
            F.collect_list(F.when(met, kept)).alias("_own"), F.collect_list(F.when(~met, F.struct("_pos", "form"))).alias("_open")
        )
        parts = written(parts, "frequent-words")
        others = word_join(parts.select(id_col, F.inline("_open")), rare, "form", [id_col, "_pos"], "left")
        others = others.groupBy(id_col).agg(F.collect_list(kept).alias("_others"))
        all_of = F.concat("_own", F.coalesce("_others", F.expr("slice(_own, 1, 0)")))
        own = parts.join(others, id_col, "left").select(id_col, all_of.alias("_own"))
    tokens = own.select(id_col, F.transform(F.sort_array("_own"), lambda t: t["form"]).alias("tokens")).filter(F.size("tokens") > 0)
    return _finish(settled.join(tokens, id_col))


def _by_use(words: DataFrame, fates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The words that are used most with their fates, as many as may be broadcast, and of the others those with a fate."""
    used = words.groupBy("form").agg(F.count(F.lit(1)).alias("n"))
    sized = written(used.join(fates, "form", "left").withColumn("n", F.least("n", F.lit(MOST_USES))), "word-uses")
    size = F.octet_length("form") + F.coalesce(F.octet_length("_fate"), F.lit(0)) + F.lit(64)
    least, taken = MOST_USES + 1, 0
    for row in sized.groupBy("n").agg(F.sum(size).alias("bytes")).orderBy(F.desc("n")).collect():  # at most MOST_USES rows
        taken += row["bytes"]
        if taken > lookups.BROADCAST_BYTES:
            break
        least = row["n"]
    often = sized.filter(F.col("n") >= least).select("form", "_fate", "_listed", F.lit(True).alias("_met"))
    return often, sized.filter((F.col("n") < least) & F.col("_listed")).select("form", "_fate", "_listed")


def tokens_long(df: DataFrame, id_col: str = "review_id") -> DataFrame:
    """One row per token and position (UDF6)."""
    return df.select(id_col, F.posexplode("tokens").alias("pos", "term"))


def token_stats(df: DataFrame) -> DataFrame:
    """AGG17: average, smallest and largest token count."""
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("token_count").alias("avg_tokens"),
        F.min("token_count").alias("min_tokens"),
        F.max("token_count").alias("max_tokens"),
    )


def parse_token_text(text: Column) -> Column:
    """STR16, ARR3: a list written as text, or plain words; empty elements dropped."""
    parsed = F.from_json(text, "array<string>")
    return F.filter(F.coalesce(parsed, F.split(F.trim(text), r"\s+")), lambda t: t.isNotNull() & (t != ""))


def first_tokens(tokens: Column, n: int = 10) -> Column:
    """ARR2: the leading ``n`` tokens."""
    return F.slice(tokens, 1, n)
