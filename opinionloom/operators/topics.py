"""Topic model: input, dictionary, training, assignment and keywords."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinionloom import wordlists
from opinionloom.functions.binding import pin
from opinionloom.functions.labels import topic_label_or_default
from opinionloom.functions.lookups import lookup_join, word_join
from opinionloom.operators import variational
from opinionloom.operators.tokens import MIN_TOKENS, drop_words
from opinionloom.operators.variational import TopicModel
from opinionloom.session import written

NUM_TOPICS = 8
PASSES = 10
SEED = 42
MIN_DOC_FREQ = 10
MAX_DOC_SHARE = 0.85
MAX_TERMS = 10_000
LABEL_WORDS = 5
#: Updates in a pass; a pass reads every document once, whatever the number.
CHUNKS = 4
EVERY_DOCUMENT = ""


def topic_input(df: DataFrame, stops: Iterable[str] = wordlists.TOPIC_STOP_WORDS) -> DataFrame:
    """LDA1, NLP4, FLT5: add ``topic_tokens`` without the generic words; ``tokens`` itself stays as it is."""
    return pin(df, topic_tokens=drop_words("tokens", stops)).filter(F.size("topic_tokens") >= MIN_TOKENS)


def document_frequency(df: DataFrame, tokens_col: str = "topic_tokens") -> DataFrame:
    """AGG19: in how many documents each term occurs."""
    terms = df.select(F.explode(F.array_distinct(tokens_col)).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"))


def vocabulary(
    df: DataFrame,
    tokens_col: str = "topic_tokens",
    no_below: int = MIN_DOC_FREQ,
    no_above: float = MAX_DOC_SHARE,
    keep_n: int = MAX_TERMS,
) -> DataFrame:
    """LDA2, TOPK4: terms that are neither rare nor everywhere, most frequent first, numbered from 0.

    An empty marker term in every document makes the largest document frequency the corpus size, so the corpus is
    counted and its terms are counted in the same pass.
    """
    marked = df.select(F.explode(F.array_union(F.array(F.lit(EVERY_DOCUMENT)), tokens_col)).alias("term"))
    counted = marked.groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"))
    documents = counted.agg(F.max("doc_freq")).scalar()
    kept = (
        counted.filter((F.col("doc_freq") >= no_below) & (F.col("doc_freq") <= F.floor(documents * F.lit(no_above))))
        .orderBy(F.desc("doc_freq"), "term")
        .limit(keep_n + 1)
        .filter(F.col("term") != EVERY_DOCUMENT)
        .orderBy(F.desc("doc_freq"), "term")
        .limit(keep_n)
    )
    rank = F.row_number().over(Window.orderBy(F.desc("doc_freq"), "term"))
    return kept.select("term", (rank - 1).alias("term_id"), "doc_freq")


def bag_of_words(df: DataFrame, terms: DataFrame, tokens_col: str = "topic_tokens", id_col: str = "review_id") -> DataFrame:
    """LDA3, JOIN5 in long form: ``(id, term_id, n)``; unknown terms are dropped.

    A dictionary is broadcast after its size is measured, a larger one is joined with salted words; counting starts before
    the shuffle.
    """
    words = df.select(id_col, F.explode(tokens_col).alias("term"))
    known = word_join(words, written(terms.select("term", "term_id"), "dictionary"), "term", [id_col])
    return known.groupBy(id_col, "term_id").agg(F.count(F.lit(1)).alias("n"))


def dominant_topic(distribution: Column) -> Column:
    """ARG1: position of the first maximum; 0 for an empty or all-zero distribution."""
    return F.coalesce(F.array_position(distribution, F.array_max(distribution)) - 1, F.lit(0)).cast("int")


def fit_topics(
    df: DataFrame,
    k: int = NUM_TOPICS,
    passes: int = PASSES,
    seed: int = SEED,
    no_below: int = MIN_DOC_FREQ,
    no_above: float = MAX_DOC_SHARE,
    keep_n: int = MAX_TERMS,
    tokens_col: str = "topic_tokens",
    id_col: str = "review_id",
    chunks: int = CHUNKS,
) -> TopicModel:
    """LDA2 to LDA4: dictionary, word counts, online variational training with learned priors of topics and words."""
    terms = vocabulary(df, tokens_col, no_below, no_above, keep_n).orderBy("term_id").collect()
    if not terms:
        raise ValueError("no term is left in the dictionary; lower no_below")
    return variational.fit(df, variational.start([row["term"] for row in terms], k, seed), passes, chunks, tokens_col, id_col)


def training_mark(df: DataFrame, tokens_col: str = "topic_tokens", id_col: str = "review_id", **options) -> dict:
    """What a model is trained on: the options, and a fingerprint of the rows that their order doesn't change."""
    rows = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(id_col, tokens_col).cast("decimal(38,0)")).alias("h")).first()
    return {"options": {name: options[name] for name in sorted(options)}, "rows": rows["n"], "fingerprint": str(rows["h"] or 0)}


def load_or_fit(df: DataFrame, folder: str, **options) -> TopicModel:
    """SNK4: reuse saved artifacts if they were trained on the same rows with the same options, otherwise train and save."""
    spark = df.sparkSession
    mark = training_mark(df, **options)
    if TopicModel.exists(spark, folder):
        model = TopicModel.load(spark, folder)
        if model.about == mark:
            return model
    model = replace(fit_topics(df, **options), about=mark)
    model.save(spark, folder)
    return model


def topic_keywords(spark: SparkSession, model: TopicModel, n: int = 10) -> DataFrame:
    """LDA6, TOPK2: ``(dominant_topic, rank, term, weight)``; k times n rows."""
    rows = [
        (topic, rank, model.vocabulary[i], float(shares[i]))
        for topic, shares in enumerate(model.topics())
        for rank, i in enumerate(sorted(range(len(shares)), key=lambda i: (-shares[i], i))[:n], 1)
    ]
    return spark.createDataFrame(rows, "dominant_topic int, rank int, term string, weight double")


def keyword_text(keywords: DataFrame, n: int = LABEL_WORDS) -> DataFrame:
    """JOIN3: the first ``n`` keywords of each topic in one string."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "term")))
    return keywords.filter(F.col("rank") <= n).groupBy("dominant_topic").agg(
        F.array_join(F.transform(ordered, lambda w: w["term"]), " ").alias("topic_keywords")
    )


def topic_distribution(df: DataFrame, model: TopicModel, tokens_col: str = "topic_tokens") -> DataFrame:
    """Model inference: add ``topic_distribution``, an array."""
    return df.withColumn("topic_distribution", model.distribution(F.col(tokens_col)))


def assign_topics(df: DataFrame, model: TopicModel, labels: DataFrame | None = None) -> DataFrame:
    """LDA5: add ``dominant_topic``, ``topic_label``, ``topic_score``, ``topic_keywords`` by a fitted model."""
    keywords = topic_keywords(df.sparkSession, model, LABEL_WORDS)
    return assign_from_distribution(topic_distribution(df, model), keywords, labels)


def assign_from_distribution(df: DataFrame, keywords: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """JOIN2, JOIN3, ARG1, PRJ16: the same from a column ``topic_distribution`` of any origin, which is dropped.

    ``keywords`` has ``dominant_topic, rank, term``. A review without a known word gets topic 0 with score 0. The small
    label and keyword tables are broadcast after their size is known.
    """
    placed = (
        df.withColumn("dominant_topic", dominant_topic(F.col("topic_distribution")))
        .withColumn("topic_score", F.bround(F.coalesce(F.array_max("topic_distribution"), F.lit(0.0)), 4))
        .drop("topic_distribution")
    )
    if labels is None:
        labels = df.sparkSession.createDataFrame([], "dominant_topic int, topic_label string")
    described = keyword_text(keywords).join(labels, "dominant_topic", "left")
    return lookup_join(placed, described, "dominant_topic").withColumn(
        "topic_label", topic_label_or_default(F.col("topic_label"), F.col("dominant_topic"))
    )
