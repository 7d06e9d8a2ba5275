"""Classifier sentiment (SEN2)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinionloom.functions import arrow_lists, labels
from opinionloom.functions.lookups import word_join
from opinionloom.operators.sampling import draw_key
from opinionloom.schemas import require_columns
from opinionloom.session import written

# Text an empty review is replaced by, rows per scoring batch of a caller's model.
PLACEHOLDER = "average product"
BATCH_ROWS = 32
#: Log odds are held as whole millionths, so a score doesn't depend on the order in which words are added up.
UNITS = 1_000_000
#: Logistic regression is fitted on at most this many labelled rows, those with the smallest draw keys.
MAX_LABELLED = 2_000_000
#: Words used more often are told apart no further when the dictionary of a model is cut.
MOST_USES = 1_000
HELD_OUT = ("0", "1", "2")


def model_text(text_col: str):
    """PRJ18: the text, or the placeholder where it is null or blank."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.when(F.btrim(text) == "", PLACEHOLDER).otherwise(text)


def model_words(text_col: str) -> Column:
    """All words of the text; nothing is cut off."""
    return F.split(F.lower(model_text(text_col)), r"\s+")


def held_out(id_col: str = "review_id") -> Column:
    """Three sixteenths of the rows, by a hash of the id alone: never trained on, only scored."""
    return F.substring(F.md5(F.concat(F.lit("held out:"), F.col(id_col).cast("string"))), 1, 1).isin(*HELD_OUT)


def _target(label_col: str | None) -> Column:
    label = F.col(label_col) if label_col else labels.star_binary(F.col("rating"))
    return F.when(label == labels.POSITIVE, 1).when(label == labels.NEGATIVE, 0)


@dataclass(frozen=True)
class WordOdds:
    """A multinomial word-count model: ``term, units`` (log odds in millionths), ``uses`` (how often it was seen) and the odds of an
    empty text."""

    terms: DataFrame
    prior: int


def fit_word_odds(df: DataFrame, text_col: str = "review_clean", label_col: str | None = None) -> WordOdds:
    """SEN2: word counts per label with add-one smoothing; one aggregate over the words of the labelled rows.

    The label is the given one, or the star label without the 3-star rows.
    """
    require_columns(df, [text_col])
    known = df.withColumn("_target", _target(label_col)).filter(F.col("_target").isNotNull())
    classes = known.agg(F.count_if(F.col("_target") == 1).alias("yes"), F.count_if(F.col("_target") == 0).alias("no")).first()
    words = known.select("_target", F.explode(model_words(text_col)).alias("term"))
    counts = written(
        words.groupBy("term").agg(F.sum("_target").alias("yes"), F.sum(1 - F.col("_target")).alias("no")), "word-counts"
    )
    total = counts.agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"), F.count(F.lit(1)).alias("terms")).first()
    yes = (F.col("yes") + 1) / F.lit(float((total.yes or 0) + total.terms))
    no = (F.col("no") + 1) / F.lit(float((total.no or 0) + total.terms))
    prior = round(math.log((classes.yes + 1) / (classes.no + 1)) * UNITS)
    units = F.round(F.log(yes / no) * UNITS).cast("long").alias("units")
    return WordOdds(counts.select("term", units, (F.col("yes") + F.col("no")).alias("uses")), prior)


def least_uses(terms: DataFrame) -> int | None:
    """From how many uses on the words of a model fit into the dictionary of a task: 0 if all do, None if not even the most frequent."""
    texts = F.octet_length("term") + F.lit(16)
    sizes = terms.groupBy(F.least("uses", F.lit(MOST_USES)).alias("uses")).agg(F.sum(texts).alias("bytes"))
    least, taken = None, 0
    for row in sizes.orderBy(F.desc("uses")).collect():  # at most MOST_USES + 1 rows
        taken += row["bytes"]
        if taken > arrow_lists.DICTIONARY_BYTES:
            return least
        least = row["uses"]
    return least and 0


def _units_of(known, all_words: bool):
    """A function of word lists: the sum of the units of the words of a dictionary, and the other words if some are in no dictionary."""

    @F.arrow_udf("struct<units: long, rest: array<string>>")
    def units_of(lists: pa.Array) -> pa.Array:
        terms, units = known.value[0], np.append(known.value[1].to_numpy(zero_copy_only=False), 0)
        done = []
        for at, n in arrow_lists.parts(lists, len(lists)):
            part = lists.slice(at, n)
            words, rows = part.flatten(), pc.list_parent_indices(part).to_numpy(zero_copy_only=False)
            at_ = arrow_lists.places(words, terms)
            sums = np.concatenate(([0], np.cumsum(units[at_])))
            starts = np.searchsorted(rows, np.arange(n + 1))
            other = (at_ < 0) & (not all_words)
            ends = pa.array(np.concatenate(([0], np.cumsum(other)))[starts].astype(np.int32))
            rest = pa.ListArray.from_arrays(ends, words.filter(pa.array(other)))
            done.append(pa.StructArray.from_arrays([pa.array(np.diff(sums[starts])), rest], ["units", "rest"]))
        return pa.concat_arrays(done) if done else pa.array([], pa.struct({"units": pa.int64(), "rest": pa.list_(pa.string())}))

    return units_of


def score_by_words(
    df: DataFrame, model: WordOdds, text_col: str = "review_clean", id_col: str = "review_id"
) -> DataFrame:
    """SEN2: add ``model_label`` and ``model_confidence``; words the model doesn't know count nothing.

    The words of the model that are used most are a dictionary of every task; of the reviews only words that aren't in it move to be
    joined with the rest of the model. If it is whole, and ids don't repeat, nothing moves.
    """
    words = model_words(text_col)
    least = least_uses(model.terms) if "uses" in model.terms.columns else None
    if least is None:
        listed = df.select(id_col, F.explode(words).alias("term"))
        sums = word_join(listed, model.terms.select("term", "units"), "term", [id_col]).groupBy(id_col).agg(F.sum("units").alias("_units"))
        return _labelled(df.join(sums, id_col, "left"), model.prior)
    whole = least == 0
    units_of = _units_of(arrow_lists.dictionary(model.terms.filter(F.col("uses") >= least).select("term", "units")), whole)
    if whole and not arrow_lists.ids_repeat(df, id_col):
        units = F.when(F.col(id_col).isNotNull(), units_of(words)["units"])
        others = [name for name in df.columns if name != id_col]
        return _labelled(df.select(id_col, *others, units.alias("_units")), model.prior)
    found = written(df.select(id_col, units_of(words).alias("found")).select(id_col, "found.*"), "word-units")
    rare = model.terms.filter(F.col("uses") < least).select("term", F.col("units").alias("own"))
    joined = word_join(found.select(id_col, F.explode("rest").alias("term")), rare, "term", [id_col])
    parts = found.select(id_col, "units").unionAll(joined.select(id_col, "own"))
    return _labelled(df.join(parts.groupBy(id_col).agg(F.sum("units").alias("_units")), id_col, "left"), model.prior)


def _labelled(df: DataFrame, prior: int) -> DataFrame:
    units = F.coalesce("_units", F.lit(0)) + F.lit(prior)
    return (
        df.withColumn("model_label", F.when(units >= 0, labels.POSITIVE).otherwise(labels.NEGATIVE))
        .withColumn("model_confidence", F.bround(1 / (1 + F.exp(-F.abs(units) / UNITS)), 4))
        .drop("_units")
    )


def train_classifier(
    df: DataFrame,
    text_col: str = "review_clean",
    label_col: str | None = None,
    features: int = 1 << 16,
    iterations: int = 20,
    most: int = MAX_LABELLED,
    id_col: str = "review_id",
) -> PipelineModel:
    """Logistic regression on hashed words, on at most ``most`` labelled rows; many passes over these."""
    require_columns(df, [text_col])
    known = df.select(id_col, model_words(text_col).alias("_words"), _target(label_col).cast("double").alias("_target"))
    known = known.filter(F.col("_target").isNotNull()).orderBy(draw_key(id_col), id_col).limit(most)
    stages = [
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features),
        IDF(inputCol="_counts", outputCol="_features"),
        LogisticRegression(
            featuresCol="_features", labelCol="_target", probabilityCol="_probability",
            rawPredictionCol="_raw", predictionCol="_prediction", maxIter=iterations, regParam=0.01,
        ),
    ]
    return Pipeline(stages=stages).fit(written(known.select("_words", "_target"), "labelled"))


def classify_reviews(df: DataFrame, model: PipelineModel, text_col: str = "review_clean") -> DataFrame:
    """Add ``model_label`` and ``model_confidence``; a narrow pass."""
    scored = model.transform(df.withColumn("_words", model_words(text_col)))
    confidence = F.bround(F.array_max(vector_to_array("_probability")), 4)
    return (
        scored.withColumn("model_label", F.when(F.col("_prediction") == 1.0, labels.POSITIVE).otherwise(labels.NEGATIVE))
        .withColumn("model_confidence", confidence)
        .drop("_words", "_counts", "_features", "_raw", "_probability", "_prediction")
    )


def classify_with(
    df: DataFrame,
    load_scorer: Callable[[], Callable[[list[str]], list[tuple[str, float]]]],
    text_col: str = "review_clean",
    batch_rows: int = BATCH_ROWS,
) -> DataFrame:
    """UDF4: labels from a caller's model. ``load_scorer`` runs once per task; its result maps texts to
    ``(label, score)`` pairs, ``batch_rows`` at a time."""
    prepared = df.withColumn("_text", model_text(text_col))
    schema = T.StructType(
        df.schema.fields
        + [T.StructField("model_label", T.StringType()), T.StructField("model_confidence", T.DoubleType())]
    )

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load_scorer()
        for frame in frames:
            texts = frame.pop("_text").tolist()
            results = [r for i in range(0, len(texts), batch_rows) for r in scorer(texts[i : i + batch_rows])]
            frame["model_label"] = [label.lower() for label, _ in results]
            frame["model_confidence"] = [round(float(value), 4) for _, value in results]
            yield frame

    return prepared.mapInPandas(score, schema)


def mean_confidence(df: DataFrame) -> DataFrame:
    """AGG26."""
    return df.agg(F.avg("model_confidence").alias("avg_confidence"))
