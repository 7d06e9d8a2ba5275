"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text is a vector of hashed terms: its words and their shapes (case, digits, signs), and how often a word follows itself.
Of at most ``MAX_LABELLED`` labelled texts (those of the smallest key hash) term weights and a truncated singular value
decomposition are learned. The labelled vectors in that space are broadcast; every document's cosine with all of them is
computed exactly, in blocks, and the labels of its nearest neighbours are weighted by similarity.

The broadcast is bounded by ``MAX_LABELLED`` x ``RANK`` and ``TERMS`` x ``RANK`` numbers whatever the corpus.

Defined cases: a null or wordless text has no similarity to anything and gets the share of label 1 among the labelled
texts; without any labelled text all scores are 0.5. Of several labels of one key the smallest counts, null labels are
left out. Neighbours as near as the last one all vote. Rows repeat as given; the result doesn't depend on their order.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinionloom.llm.arrow_text import in_python, slices
from opinionloom.session import written

MAX_LABELLED = 4000
TERMS = 4096
SHAPES = 1024  # the first of the term buckets are for shapes; bucket 0 counts words that repeat the one before
RANK = 64
NEIGHBOURS = 25
SHARPNESS = 8
ROWS = 1000
PASS = 0.3
SEED = 7


def term_counts(texts: pa.Array) -> np.ndarray:
    """Counts of the term buckets, one row per text."""
    words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = words.flatten().dictionary_encode()
    names = coded.dictionary
    shapes = names
    for pattern, sign in ((r"\p{Ll}+", "a"), (r"\p{Lu}+", "A"), (r"[0-9]+", "0")):
        shapes = pc.replace_substring_regex(shapes, pattern, sign)
    shapes = pc.utf8_slice_codeunits(shapes, 0, 6)
    plain = pc.utf8_lower(pc.replace_substring_regex(names, r"[^\p{L}]+", ""))
    shape_of = np.array([1 + zlib.crc32(s) % (SHAPES - 1) for s in shapes.cast(pa.binary()).to_pylist()], np.int64)
    word_of = np.array([SHAPES + zlib.crc32(s) % (TERMS - SHAPES) for s in plain.cast(pa.binary()).to_pylist()], np.int64)
    empty = np.array([not s for s in names.to_pylist()], bool)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    real = ~empty[codes] if len(codes) else np.zeros(0, bool)
    codes, rows = codes[real], rows[real]
    again = np.flatnonzero((codes[1:] == codes[:-1]) & (rows[1:] == rows[:-1])) + 1
    cells = np.concatenate((rows * TERMS + shape_of[codes], rows * TERMS + word_of[codes], rows[again] * TERMS))
    return np.bincount(cells, minlength=len(texts) * TERMS).reshape(len(texts), TERMS)


def weighted(counts: np.ndarray) -> np.ndarray:
    """Square roots of the shares of a text's words."""
    words = counts[:, SHAPES:].sum(axis=1, keepdims=True)
    return np.sqrt(counts / np.maximum(words, 1)).astype(np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    sizes = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, sizes, out=np.zeros_like(rows), where=sizes > 1e-12)


class Space:
    """Term weights, the latent-semantic projection, and the labelled texts in it."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray):
        self.labels = labels.astype(np.float64)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        if len(labels):
            held = (vectors > 0).sum(axis=0)
            self.idf = np.log((1 + len(labels)) / (1 + held)).astype(np.float32) + 1
            self.axes = leading_axes(unit(vectors * self.idf), RANK)
            self.labelled = self.project(vectors)

    def project(self, vectors: np.ndarray) -> np.ndarray:
        return unit(unit(vectors * self.idf) @ self.axes)

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        out = np.full(len(vectors), self.prior)
        if not len(self.labels) or not len(vectors):
            return out
        places = self.project(vectors)
        near = places @ self.labelled.T
        k = min(NEIGHBOURS, near.shape[1])
        least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
        weights = np.where(near >= least, np.maximum(near, 0), 0).astype(np.float64) ** SHARPNESS
        total = weights.sum(axis=1)
        some = (total > 0) & (places != 0).any(axis=1)
        out[some] = np.round(np.clip((weights @ self.labels)[some] / total[some], 0, 1), 9)
        return out


def leading_axes(rows: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start."""
    rank = min(rank, *rows.shape)
    basis = np.random.default_rng(SEED).standard_normal((rows.shape[1], min(rank + 16, *rows.shape))).astype(np.float32)
    for _ in range(6):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    _, _, turned = np.linalg.svd(rows @ basis, full_matrices=False)
    return (basis @ turned.T)[:, :rank].astype(np.float32)


def _texts(batches, most_rows: int = ROWS):
    for batch in slices(batches, "text"):
        for at in range(0, batch.num_rows, most_rows):
            yield batch.slice(at, most_rows)


def fit(
    documents: DataFrame, labels: DataFrame, key: str, text: str, label: str, usable: Column, most: int = MAX_LABELLED
) -> Space:
    """Learn from at most ``most`` labelled documents for which ``usable`` (a condition on ``labels``) holds."""
    chosen = written(
        labels.filter(usable & F.col(label).isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(F.min(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("key"), "key")
        .limit(most),
        "labelled",
    )
    # one text per key: of repeated keys the one with the smallest hash
    source = (
        documents.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "key")
        .groupBy("key", "label")
        .agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        .select("label", "text", F.xxhash64("key").alias("place"))
    )

    def run(batches):
        for batch in _texts(batches):
            vectors = weighted(term_counts(batch.column("text")))
            cells = [np.flatnonzero(row) for row in vectors]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("place"),
                    batch.column("label"),
                    pa.array(cells, pa.list_(pa.int32())),
                    pa.array([row[c] for row, c in zip(vectors, cells, strict=True)], pa.list_(pa.float32())),
                ],
                ["place", "label", "cells", "weights"],
            )

    rows = in_python(source, run, "place long, label int, cells array<int>, weights array<float>").toArrow()
    rows = rows.sort_by("place").combine_chunks()
    vectors = np.zeros((rows.num_rows, TERMS), np.float32)
    for i, (cells, weights) in enumerate(zip(rows.column("cells"), rows.column("weights"), strict=True)):
        vectors[i, cells.values.to_numpy()] = weights.values.to_numpy()
    return Space(vectors, rows.column("label").to_numpy())


def score(documents: DataFrame, space: Space, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(key, score)``."""
    shipped = documents.sparkSession.sparkContext.broadcast(space)
    source = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        for batch in _texts(batches):
            scores = shipped.value.scores(weighted(term_counts(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(scores)], ["key", "score"])

    kind = source.schema["key"].dataType.simpleString()
    return in_python(source, run, f"key {kind}, score double").withColumnRenamed("key", key)
