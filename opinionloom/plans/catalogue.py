"""Named queries over the test tables, one per operator or group of operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionloom import wordlists
from opinionloom.functions import labels
from opinionloom.functions.lookups import lookup_join
from opinionloom.functions.text import clean_text
from opinionloom.operators import (
    agreement,
    aggregates,
    calibration,
    classify,
    clean,
    coherence,
    heavy,
    induction,
    ingest,
    lemmas,
    lexicon,
    positional,
    prepared,
    quality,
    sampling,
    search,
    tagging,
    text_index,
    tokens,
    topics,
    variational,
)
from opinionloom.plans import jobs
from opinionloom.plans.jobs import kpis_with_coherence, prepared_tables
from opinionloom.session import shared_folder, spread, written
from opinionloom.sinks.tables import report_text, sentiment_report, topic_report, write_snapshot
from opinionloom.sources.csv_files import missing_as_null, read_reviews_csv
from opinionloom.sources.snapshots import read_first_snapshot
from opinionloom.sources.tables import read_table, reviews

STOPS = tuple(tokens.stop_words())
# Besides the seed table: a plain lemma, one that is too short to stay, and one that is a stop word.
LEMMAS = {**wordlists.LEMMAS, "thing": "thin", "ering": "er", "thnt": "the"}
SEED_LEXICON = lexicon.Lexicon()
# Frequent words of the test texts, so that every context rule is exercised thousands of times.
RULE_LEXICON = lexicon.Lexicon(
    terms={"best": 32, "trash": -15, "thing": 12, "tion": -7, "ment": 21, "que": -18, "and": 5, "erin": 9, "st": -26},
    boosters={"is": 293, "of": -293, "la": 293, "and": 293, "a": -293},
    negators=("the", "that", "le", "never", "without"),
    contrast="on",
    idioms={"the thing": 30, "and st": -20, "of the best": -15, "st and": 17, "and la la": 25},
    phrases={"of the": -293, "is and": 293},
)
SAMPLE_CAP = 300
SEARCH = {"topics": ("en", "fr"), "sentiments": ("positive",), "ratings": (1, 2, 4, 5), "term": "ThE[a-z]"}
COHERENCE_WORDS = 20
TOPIC_FIT = {"k": 8, "no_below": 10}
LANGUAGES = ("de", "en", "es", "fr")
TRACE_TOPICS = 4
HEAVY_SHARE = 400
GIVEN_LABELS = {0: "german", 2: "spanish"}
SMALL_CAP = 50
SMALL_LIMIT = 20
COHERENCE = 0.25

ROW_COLUMNS = ("review_id", "rating", "topic_label", "model_label", "vader_score", "vader_label")


def standard(spark: SparkSession, folder: str, names: bool = False) -> DataFrame:
    return ingest.keep_real_text(reviews(spark, folder, names).dropna(subset=["review_text", "rating"]))


def cleaned(spark: SparkSession, folder: str, names: bool = False) -> DataFrame:
    return clean.clean_reviews(standard(spark, folder, names))


def processed(spark: SparkSession, folder: str, names: bool = False) -> DataFrame:
    return tokens.normalize_reviews(cleaned(spark, folder, names), stops=STOPS, lemmas=LEMMAS)


def master(spark: SparkSession, folder: str, names: bool = False) -> DataFrame:
    """All stages; the topic score is a stand-in, the strength of the lexicon score."""
    scored = lexicon.score_reviews(processed(spark, folder, names), lexicon=SEED_LEXICON)
    flagged = agreement.add_agreement_flag(agreement.add_star_sentiment(scored))
    return flagged.withColumn("topic_score", F.abs("vader_score"))


def nullable_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The master table with a second, sparse label source in place of the model label."""
    given = read_table(spark, folder, "labels").select(
        F.col("doc_id").alias("review_id"), F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("given")
    )
    return master(spark, folder).join(given, "review_id", "left").withColumn("model_label", F.col("given")).drop("given")


RAW_TAIL = " only $9.99 or 20 dollars &amp;zzz; and &lt;b&gt;more&lt;/b&gt;"


def raw_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The test tables in the shape of the raw file: everything text, some of it unusable."""
    documents = read_table(spark, folder, "documents")
    orders = read_table(spark, folder, "orders")
    joined = documents.join(orders, F.col("doc_id") == F.col("o_orderkey"))
    no_rating = F.col("o_orderpriority") == "4-NOT SPECIFIED"
    source = F.col("source")
    return joined.select(
        F.col("doc_id").alias("review_id"),
        F.when(source == "src2", None)
        .when(source == "src5", F.concat("text", F.lit(RAW_TAIL)))
        .otherwise(F.col("text"))
        .alias("reviews.text"),
        F.when(source == "src3", None)
        .when(source == "src7", "4d")
        .when(no_rating, F.col("o_orderpriority"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", "NaN")
        .otherwise(F.concat(F.substring("o_orderpriority", 1, 1), F.lit(".7")))
        .alias("reviews.rating"),
        F.when(source == "src4", None)
        .when(source == "src8", F.date_format("o_orderdate", "MMMM d, yyyy"))
        .when(F.col("o_orderstatus") == "P", "pending")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'.000Z'"))
        .alias("reviews.date"),
        F.when(source == "src6", "N/A").when(source != "src1", source).alias("reviews.title"),
        F.col("lang").alias("unmapped"),
    )


def stop_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(word,) for word in STOPS], "term string")


def topic_documents(spark: SparkSession, folder: str) -> DataFrame:
    return topics.topic_input(processed(spark, folder))


def settled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Topic input written once, as between stages, for queries that read it more than once."""
    documents = topic_documents(spark, folder)
    return written(documents.select("review_id", "rating", "topic_label", "model_label", "topic_tokens"), "topic-documents")


def leading_terms(documents: DataFrame, n: int) -> DataFrame:
    """Stand-in for topic keywords: the most frequent terms per language."""
    words = documents.select("topic_label", F.explode("topic_tokens").alias("term"))
    counted = words.groupBy("topic_label", "term").agg(F.count(F.lit(1)).alias("count"))
    return aggregates.top_terms(counted, n)


def clean_pages(spark: SparkSession, folder: str) -> DataFrame:
    pages = spread(read_table(spark, folder, "pages"), "page_id")
    return clean.clean_reviews(pages.withColumnRenamed("html", "review_text")).select("page_id", "review_clean")


def clean_conversations(spark: SparkSession, folder: str) -> DataFrame:
    turns = spread(read_table(spark, folder, "conversations"), "conv_id")
    return turns.select("conv_id", "turn", clean_text("text").alias("review_clean"))


def lexicon_rules_joined(spark: SparkSession, folder: str) -> DataFrame:
    rows = lexicon.score_by_join(cleaned(spark, folder), RULE_LEXICON)
    return rows.select("review_id", "vader_score", "vader_label")


def normalized_by_join(spark: SparkSession, folder: str) -> DataFrame:
    lemmas = spark.createDataFrame(list(LEMMAS.items()), "form string, lemma string")
    rows = tokens.normalize_by_join(cleaned(spark, folder), stop_table(spark), lemmas)
    return rows.select("review_id", "review_normalized", "token_count")


def vocabulary_of_words(spark: SparkSession, folder: str) -> DataFrame:
    """Every lower-case word of the cleaned texts with its count, written once."""
    words = cleaned(spark, folder).select(F.expr(tokens.alphabetic_words_sql("review_clean")).alias("words"))
    return written(lemmas.word_counts(words), "word-counts")


def normalized_by_rules(spark: SparkSession, folder: str) -> DataFrame:
    counted = vocabulary_of_words(spark, folder)
    table = lemmas.lemma_table(counted, written(lemmas.lemma_rules(counted), "lemma-rules"))
    rows = tokens.normalize_reviews(cleaned(spark, folder), stops=STOPS, lemmas=table)
    return rows.select("review_id", "review_normalized", "token_count")


def tagged_tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = written(tagging.sentences(standard(spark, folder), "review_text"), "sentences")
    return tagging.tagged_tokens(rows, tagging.train_tagger(rows))


def search_rows_indexed(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    # what is searched and shown; the cleaned texts are in no result
    text_index.build_index(master(spark, folder, names=True).select("review_id", *search.HEADINGS), path)
    return search.search_results(text_index.search_index(spark, path, **SEARCH))


def topic_ratings(spark: SparkSession, folder: str) -> DataFrame:
    blocks = aggregates.topic_blocks(master(spark, folder))
    return blocks.select("dominant_topic", "count", "pct_corpus", F.explode("ratings").alias("rating", "n"))


def label_set_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Labels outside the binary domain among lexicon labels, and stop words that never occur as a token."""
    rows = master(spark, folder)
    binary = spark.createDataFrame([("positive",), ("negative",)], "vader_label string")
    outside = quality.values_outside(rows, "vader_label", binary).select(
        F.lit("outside").alias("kind"), F.col("vader_label").alias("value")
    )
    expected = spark.createDataFrame([(word,) for word in sorted(wordlists.LEXICON)], "term string")
    absent = quality.values_missing(tokens.tokens_long(rows), "term", expected).select(
        F.lit("absent").alias("kind"), F.col("term").alias("value")
    )
    return outside.unionByName(absent)


def stop_union(spark: SparkSession, folder: str) -> DataFrame:
    """Union of the three stop lists with the number of reviews each word occurs in."""
    tables = [
        spark.createDataFrame([(w,) for w in words], "term string")
        for words in (wordlists.ENGLISH_STOP_WORDS, wordlists.SHOP_STOP_WORDS, wordlists.TOPIC_STOP_WORDS)
    ]
    words = cleaned(spark, folder).select(
        F.explode(F.array_distinct(F.expr(tokens.alphabetic_words_sql("review_clean")))).alias("term")
    )
    members = written(tokens.stop_word_table(*tables), "stop-words")
    counted = lookup_join(words, members, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("reviews"))
    return members.join(counted, "term", "left").select("term", F.coalesce("reviews", F.lit(0)).alias("reviews"))


def classified(spark: SparkSession, folder: str) -> DataFrame:
    """Word odds learned without the held-out rows, applied to all."""
    rows = written(cleaned(spark, folder).select("review_id", "rating", "review_clean"), "classifier-text")
    model = classify.fit_word_odds(rows.filter(~classify.held_out()))
    return classify.score_by_words(rows, model).withColumn("held_out", classify.held_out())


def classifier_scores(spark: SparkSession, folder: str) -> DataFrame:
    return classified(spark, folder).select("review_id", "rating", "held_out", "model_label", "model_confidence")


def calibrated_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Confidences as shares of right labels, learned on half of the held-out rows and given to all."""
    rows = written(classified(spark, folder), "classified")
    right = F.when(F.col("rating") != 3, (F.col("model_label") == "positive") == (F.col("rating") >= 4))
    score = F.col("model_confidence")
    values = calibration.fit_calibration(rows.filter(F.col("held_out") & (F.col("review_id") % 2 == 0)), score, right)
    return rows.select("review_id", "model_label", "model_confidence", F.round(calibration.calibrated(score, values), 6).alias("calibrated"))


def positional_join(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by their id side by side with orders by price."""
    documents = read_table(spark, folder, "documents").select("doc_id", "n_chars")
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    joined = positional.positional_join(documents, orders, ["doc_id"], ["o_totalprice", "o_orderkey"])
    return joined.select("position", "doc_id", "o_orderkey")


def csv_records(spark: SparkSession, folder: str) -> DataFrame:
    """The documents written as CSV files with every value in quotes, and read back by their records."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    documents = read_table(spark, folder, "documents").select("doc_id", "source", "text", "lang")
    documents.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return read_reviews_csv(spark, path)


def stage_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """The raw rows as CSV files, through the ingest, preprocessing and sentiment jobs; the last snapshot read back."""
    home = f"{shared_folder(spark)}/jobs-{uuid.uuid4().hex}"
    raw = raw_columns(spark, folder)
    raw.write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{home}/raw")
    jobs.ingest_job(spark, f"{home}/raw", f"{home}/reviews_raw", min_bytes=0, every_file=True)
    jobs.preprocess_job(spark, f"{home}/reviews_raw", f"{home}/reviews_processed", stops=STOPS, lemmas=LEMMAS)
    jobs.sentiment_job(spark, f"{home}/reviews_processed", f"{home}/reviews_sentiment", f"{home}/sentiment_report", SEED_LEXICON)
    found = read_first_snapshot(spark, f"{home}/reviews_topics", f"{home}/reviews_sentiment")
    return found.select(
        F.col("review_id").cast("long").alias("review_id"), "rating", "review_date", "review_title", "review_normalized", "token_count",
        "star_sentiment", "vader_score", "vader_label", "model_label", "model_confidence", "sentiment_agree",
    )


def lda_stage(spark: SparkSession, folder: str) -> DataFrame:
    """What holds for any run of the topic job, and for a second one over its saved model: rows, labels and reports."""
    home = f"{shared_folder(spark)}/topics-{uuid.uuid4().hex}"
    write_snapshot(master(spark, folder).drop("topic_label", "dominant_topic", "topic_score"), f"{home}/reviews_sentiment")
    sources = (f"{home}/reviews_topics", f"{home}/reviews_sentiment")
    first, score = jobs.topic_job(spark, sources, f"{home}/first", f"{home}/first_report", f"{home}/model", **TOPIC_FIT)
    again, _ = jobs.topic_job(spark, sources, f"{home}/again", f"{home}/again_report", f"{home}/model", **TOPIC_FIT)
    moved = first.join(again.select("review_id", F.col("dominant_topic").alias("second")), "review_id", "left")
    reported = spark.read.json(f"{home}/again_report").agg(F.sum("count")).first()[0]
    return moved.agg(
        F.count(F.lit(1)).alias("reviews"),
        F.count_if(~F.col("dominant_topic").eqNullSafe(F.col("second"))).alias("moved"),
        F.count_if(F.col("topic_label").isNull() | ~F.col("topic_score").between(0, 1)).alias("unfit"),
        F.lit(reported).cast("long").alias("reported"),
        F.lit(-1 <= score <= 1).alias("coherent"),
    )


def _scorer() -> Callable[[list[str]], list[tuple[str, float]]]:
    """A caller's model: texts of which more than a tenth is the letter e."""
    return lambda texts: [("POSITIVE" if 10 * t.count("e") > len(t) else "NEGATIVE", min(len(t), 9999) / 10000) for t in texts]


def callers_model(spark: SparkSession, folder: str) -> DataFrame:
    scored = classify.classify_with(cleaned(spark, folder).select("review_id", "review_clean"), _scorer)
    return scored.select("review_id", "model_label", "model_confidence")


def topic_assignments_given(spark: SparkSession, folder: str) -> DataFrame:
    """Assignment from a given distribution: the share of each language's leading terms in a review."""
    documents = settled_documents(spark, folder).drop("topic_label")
    leading = leading_terms(settled_documents(spark, folder), COHERENCE_WORDS)
    topic = F.array_position(F.array(*map(F.lit, LANGUAGES)), F.col("topic_label")) - 1
    keywords = written(leading.select(topic.cast("int").alias("dominant_topic"), "rank", "term"), "leading-terms")
    words = documents.select("review_id", F.explode("topic_tokens").alias("term"))
    hits = (
        words.join(F.broadcast(keywords), "term")  # four languages of COHERENCE_WORDS terms
        .groupBy("review_id")
        .agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("dominant_topic") == t).alias(f"t{t}") for t in range(4)))
        .select("review_id", F.array(*(F.col(f"t{t}") / F.col("n") for t in range(4))).alias("topic_distribution"))
    )
    given = spark.createDataFrame(list(GIVEN_LABELS.items()), "dominant_topic int, topic_label string")
    placed = topics.assign_from_distribution(documents.join(hits, "review_id", "left"), keywords, given)
    return placed.select("review_id", "dominant_topic", "topic_label", "topic_score", "topic_keywords")


def lda_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What holds for any fit: rows, ids out of range, scores outside [0, 1], empty labels and keywords."""
    empty = lambda name: F.count_if(F.btrim(F.coalesce(F.col(name), F.lit(""))) == "")
    return _assigned(spark, folder).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.coalesce(F.col("dominant_topic").between(0, TOPIC_FIT["k"] - 1), F.lit(False))).alias("topics_outside"),
        F.count_if(~F.coalesce(F.col("topic_score").between(0, 1), F.lit(False))).alias("scores_outside"),
        empty("topic_label").alias("empty_labels"),
        empty("topic_keywords").alias("empty_keywords"),
    )


def topic_report_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The topic report, its nested columns laid flat."""
    rows = written(master(spark, folder), "master")
    topic = rows.select("topic_label", "dominant_topic").distinct()
    terms = aggregates.topic_term_weights(rows, 5).join(F.broadcast(topic), "topic_label")
    report = topic_report(rows, terms.select("dominant_topic", "rank", "term", "weight"))
    best = F.get("examples", F.lit(0))
    return report.select(
        "dominant_topic", "topic_label", "count", "pct_corpus", F.regexp_replace("keywords", r"\([0-9.]+\)", "").alias("keywords"),
        F.size("examples").alias("examples"), best["preview"].alias("best_preview"), best["topic_score"].alias("best_score"),
    )


def topic_terms_from_text(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens per topic, the token lists read back from text."""
    rows = master(spark, folder)
    return aggregates.topic_terms(rows.withColumn("tokens", tokens.parse_token_text(F.to_json("tokens"))))


def headline_figures(spark: SparkSession, folder: str) -> DataFrame:
    """Headline figures with the measured coherence of the languages' leading terms."""
    score = topic_coherence(spark, folder).agg(F.avg("coherence")).first()[0]
    figures = kpis_with_coherence(master(spark, folder), score)
    return figures.withColumn("coherence", F.bround("coherence", 4))


def prepared_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """The eight prepared tables of one written master table, by name and size."""
    bundle = prepared_tables(written(master(spark, folder), "master"))
    sizes = [table.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows") for name, table in bundle.items()]
    return reduce(DataFrame.unionByName, sizes)


# Of each prepared table: its key, label, count and figure.
PREPARED_FORMS = {
    "sentiment_dist": ("model", "label", "count", "NULL"),
    "rating_dist": ("CAST(rating AS STRING)", "sentiment", "count", "avg_vader"),
    "monthly": ("date_format(month, 'yyyy-MM')", "model_label", "count", "NULL"),
    "topic_dist": ("topic_label", "NULL", "count", "pct_positive"),
    "topic_heatmap": ("topic_label", "NULL", "total", "pct_negative"),
    "avg_rating": ("topic_label", "band", "n", "ci"),
    "vader_scores": ("CAST(rating AS STRING)", "model_label", "1", "vader_score"),
    "wc_tokens": ("topic_label", "term", "count", "weight"),
}
LATE_LOAD = "1995-01-01"


def prepared_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """The eight prepared tables after three loads, two of them compacted, in one form."""
    rows = written(master(spark, folder), "master")
    states = f"{shared_folder(spark)}/states-{uuid.uuid4().hex}"
    late = F.col("review_date") >= F.lit(LATE_LOAD).cast("timestamp")
    prepared.add_load(rows.filter(late), states, "late")
    prepared.add_load(rows.filter(~late), states, "early")
    prepared.compact(spark, states)
    prepared.add_load(rows.filter("review_date IS NULL"), states, "undated")
    tables = prepared.tables_from_states(prepared.read_states(spark, states))
    forms = [
        tables[name].selectExpr(
            f"'{name}' AS name", f"CAST({key} AS STRING) AS key", f"CAST({label} AS STRING) AS label",
            f"CAST({n} AS BIGINT) AS n", f"CAST({value} AS DOUBLE) AS value",
        )
        for name, (key, label, n, value) in PREPARED_FORMS.items()
    ]
    return reduce(DataFrame.unionByName, forms)


def lexicon_duplicate_terms(spark: SparkSession, folder: str) -> DataFrame:
    """A lexicon table with repeated terms: the smallest valence counts, folded into the plan or joined."""
    listed = [*RULE_LEXICON.terms.items(), *((term, valence + 7) for term, valence in RULE_LEXICON.terms.items())]
    table = spark.createDataFrame(listed, "term string, valence_tenths int")
    rows = lexicon.score_reviews(cleaned(spark, folder), lexicon=replace(RULE_LEXICON, terms=table))
    return rows.select("review_id", "vader_score", "vader_label")


def audited(spark: SparkSession, folder: str) -> DataFrame:
    """The audit with every column it can look at; confidence and keywords are stand-ins."""
    rows = master(spark, folder).withColumn("model_confidence", F.abs("vader_score")).withColumn("topic_keywords", F.col("topic_label"))
    return quality.audit(rows, num_topics=4, coherence=COHERENCE)


def read_as_csv(raw: DataFrame) -> DataFrame:
    """Missing-value tokens as nulls in every text column, as the CSV source gives them."""
    return raw.select(*((missing_as_null(f"`{n}`").alias(n) if kind == "string" else F.col(f"`{n}`")) for n, kind in raw.dtypes))


def lda_topics(spark: SparkSession, folder: str) -> DataFrame:
    documents = settled_documents(spark, folder)
    model = topics.fit_topics(documents, **TOPIC_FIT)
    return topics.topic_keywords(spark, model, 10)


def lda_fit_trace(spark: SparkSession, folder: str) -> DataFrame:
    """One round of inference from given topics: the weight of term ``i`` in topic ``t`` is ``1 + i * (t + 3) % 7``."""
    documents = settled_documents(spark, folder)
    terms = [r["term"] for r in topics.vocabulary(documents).orderBy("term_id").collect()]
    given = np.array([[1.0 + i * (t + 3) % 7 for i in range(len(terms))] for t in range(TRACE_TOPICS)])
    weights = variational.document_weights(documents, terms, given, np.full(TRACE_TOPICS, 1 / TRACE_TOPICS), rounds=1)
    return weights.withColumn("weight", F.round("weight", 6))


def _assigned(spark: SparkSession, folder: str) -> DataFrame:
    documents = settled_documents(spark, folder).drop("topic_label")
    return topics.assign_topics(documents, topics.fit_topics(documents, **TOPIC_FIT))


def lda_assignments(spark: SparkSession, folder: str) -> DataFrame:
    return _assigned(spark, folder).select(
        "review_id", "dominant_topic", "topic_label", "topic_score", "topic_keywords"
    )


def lda_hotspots(spark: SparkSession, folder: str) -> DataFrame:
    return aggregates.topic_hotspots(_assigned(spark, folder))


def topic_coherence(spark: SparkSession, folder: str) -> DataFrame:
    documents = settled_documents(spark, folder)
    words = leading_terms(documents, COHERENCE_WORDS).select(F.col("topic_label").alias("topic"), "term")
    per_topic = coherence.topic_coherence(documents, words)
    return per_topic.select("topic", F.bround("coherence", 6).alias("coherence"))


def _on(table: Callable[[SparkSession, str], DataFrame], operator: Callable[[DataFrame], DataFrame]):
    return lambda spark, folder: operator(table(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "reviews_base": lambda s, d: standard(s, d, names=True).select(
        "review_id", "review_text", "rating", "review_date", "product_name", "review_title", "reviewer"
    ),
    "standardized_reviews": _on(raw_columns, ingest.standardize),
    "standardized_csv": _on(raw_columns, lambda df: ingest.standardize(read_as_csv(df))),
    "clean_raw": _on(raw_columns, lambda df: df.select("review_id", clean_text("reviews.text").alias("review_clean"))),
    "drop_reasons": _on(raw_columns, lambda df: ingest.drop_counts(ingest.drop_reason(df))),
    "unparsed_dates": _on(raw_columns, ingest.unparsed_dates),
    "clean_documents": _on(cleaned, lambda df: df.select("review_id", "review_clean")),
    "clean_pages": clean_pages,
    "clean_conversations": clean_conversations,
    "dataset_profile": _on(standard, ingest.dataset_profile),
    "null_counts": lambda s, d: ingest.null_counts(standard(s, d, names=True)),
    "rating_histogram": _on(standard, ingest.rating_histogram),
    "tokens_long": _on(processed, tokens.tokens_long),
    "token_stats": _on(processed, tokens.token_stats),
    "normalized_text": _on(processed, lambda df: df.select("review_id", "review_normalized", "token_count")),
    "normalized_by_join": normalized_by_join,
    "lemma_rules": lambda s, d: lemmas.lemma_rules(vocabulary_of_words(s, d)),
    "normalized_by_rules": normalized_by_rules,
    "tagged_tokens": tagged_tokens,
    "stop_union": stop_union,
    "doc_frequency": _on(topic_documents, topics.document_frequency),
    "vocabulary": _on(settled_documents, topics.vocabulary),
    "vocabulary_small_cap": _on(settled_documents, lambda df: topics.vocabulary(df, keep_n=SMALL_CAP)),
    "bag_of_words": _on(settled_documents, lambda df: topics.bag_of_words(df, topics.vocabulary(df))),
    "lexicon_scores": _on(
        cleaned,
        lambda df: lexicon.score_reviews(df, lexicon=SEED_LEXICON).select("review_id", "vader_score", "vader_label"),
    ),
    "lexicon_rules": _on(
        cleaned,
        lambda df: lexicon.score_reviews(df, lexicon=RULE_LEXICON).select("review_id", "vader_score", "vader_label"),
    ),
    "lexicon_rules_joined": lexicon_rules_joined,
    "lexicon_duplicate_terms": lexicon_duplicate_terms,
    "induced_lexicon": _on(
        lambda s, d: written(processed(s, d).select("tokens"), "tokens"),
        lambda df: induction.induced_lexicon(df, RULE_LEXICON.terms),
    ),
    "star_agreement": _on(
        master,
        lambda df: df.select(
            "review_id", "star_sentiment", labels.star_binary(F.col("rating")).alias("star_binary"), "vader_label",
            "model_label", "sentiment_agree",
        ),
    ),
    "lexicon_vs_stars": _on(master, agreement.lexicon_vs_stars),
    "model_agreement": _on(master, agreement.model_vs_stars),
    "agreement_report": _on(master, agreement.agreement_report),
    "agreement_nullable": _on(nullable_labels, agreement.agreement_report),
    "sentiment_report": _on(master, lambda df: report_text(sentiment_report(df))),
    "sentiment_distribution": _on(master, aggregates.sentiment_distribution),
    "sentiment_share": _on(master, aggregates.sentiment_share),
    "label_counts": _on(
        master, lambda df: aggregates.label_counts(df, "vader_label", ("positive", "neutral", "negative"))
    ),
    "rating_profile": _on(master, aggregates.rating_profile),
    "rating_profile_nullable": _on(nullable_labels, aggregates.rating_profile),
    "monthly_trend": _on(master, aggregates.monthly_trend),
    "topic_profile": _on(master, aggregates.topic_profile),
    "topic_hotspots": _on(master, aggregates.topic_hotspots),
    "topic_hotspots_nullable": _on(nullable_labels, aggregates.topic_hotspots),
    "topic_rating_ci": _on(master, aggregates.topic_rating_ci),
    "kpis": _on(master, aggregates.kpis),
    "topic_blocks": topic_ratings,
    "topic_report": topic_report_rows,
    "topic_terms": topic_terms_from_text,
    "kpis_with_coherence": headline_figures,
    "prepared_tables": prepared_bundle,
    "prepared_incremental": prepared_incremental,
    "topic_listing": _on(master, aggregates.topic_listing),
    "topic_top_examples": _on(master, aggregates.topic_examples),
    "topic_term_weights": _on(master, aggregates.topic_term_weights),
    "score_rows": _on(master, lambda df: aggregates.score_rows(df)),
    "score_histogram": _on(master, aggregates.score_histogram),
    "topic_list": _on(master, aggregates.topic_list),
    "largest_topic": _on(master, aggregates.largest_topic_share),
    "label_set_diff": label_set_difference,
    "search_rows": lambda s, d: search.search_results(search.search(master(s, d, names=True), **SEARCH)),
    "search_rows_indexed": search_rows_indexed,
    "search_rows_all": lambda s, d: search.search_results(search.search(master(s, d, names=True), term="th"), limit=None),
    "search_rows_small_cap": lambda s, d: search.search_results(search.search(master(s, d, names=True), **SEARCH), SMALL_LIMIT),
    "search_rows_friendly": lambda s, d: search.search_results(search.search(master(s, d, names=True), **SEARCH), friendly=True),
    "search_summary": _on(master, lambda df: search.search_summary(search.search(df, **SEARCH))),
    "stratified_sample": _on(standard, lambda df: sampling.stratified_sample(df, SAMPLE_CAP).select("review_id", "rating")),
    "head": _on(standard, lambda df: sampling.head(df, 5).select("review_id", "rating")),
    "simple_sample": _on(standard, lambda df: sampling.simple_sample(df, 5).select("review_id", "rating")),
    "quality_audit": audited,
    "classifier_scores": classifier_scores,
    "calibrated_scores": calibrated_scores,
    "positional_join": positional_join,
    "csv_records": csv_records,
    "stage_jobs": stage_jobs,
    "callers_model": callers_model,
    "heavy_terms": _on(lambda s, d: written(processed(s, d).select("tokens"), "tokens"), lambda df: heavy.heavy_terms(df, HEAVY_SHARE)),
    "classifier_agreement": lambda s, d: agreement.model_vs_stars(classified(s, d).filter("held_out")),
    "topic_assignments_given": topic_assignments_given,
    "lda_audit": lda_audit,
    "lda_fit_trace": lda_fit_trace,
    "lda_stage": lda_stage,
    "lda_topics": lda_topics,
    "lda_assignments": lda_assignments,
    "lda_hotspots": lda_hotspots,
    "topic_coherence": topic_coherence,
}
