"""Topic model training by online variational inference, with learned priors for topics and for words.

The corpus is dealt into a fixed number of chunks by a hash of the document id and written once as word counts, a folder per
chunk. Each update reads one chunk: the tasks infer the topics of its documents and sum the expected word counts, partial sums
are added up per term, and the driver holds no more than ``k`` numbers for each of the dictionary's terms (``keep_n`` bounds
them). So a pass reads the corpus once at any size, and the number of jobs is ``passes`` times ``chunks``.

After each update both priors take a Newton step towards the likelihood of what was inferred: the topic prior from the chunk's
documents, the word prior from the topics.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionloom.functions.arrow_lists import parts
from opinionloom.session import python_tasks, shared_folder

OFFSET, DECAY = 1.0, 0.5
MOST_ROUNDS = 50
CHANGE = 1e-3
#: Documents inferred at a time in a task.
BATCH_DOCS = 2_000
#: Documents are refined together that take so many terms, each as many as the longest; a longer one goes alone.
TOGETHER = 1 << 18


def digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence to 8 and more, then the asymptotic series."""
    x = np.asarray(x, np.float64)
    shift = 1 / x
    for step in range(1, 8):
        shift += 1 / (x + step)
    x = x + 8
    r = 1 / (x * x)
    series = r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r * (1 / 132)))))
    return np.log(x) - shift - 0.5 / x - series


def trigamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift = np.where(low, shift + 1 / np.where(low, x * x, 1), shift)
        x = np.where(low, x + 1, x)
    r = 1 / (x * x)
    return shift + 1 / x + r / 2 + r / x * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r * (1 / 30))))


def expected_log(weights: np.ndarray) -> np.ndarray:
    """Expected logarithms of Dirichlet variables, a distribution per row."""
    logs = digamma(np.concatenate((weights, weights.sum(-1, keepdims=True)), -1))
    return logs[..., :-1] - logs[..., -1:]


def newton_step(prior: np.ndarray, n: float, mean_logs: np.ndarray, rate: float) -> np.ndarray:
    """One damped Newton step of a Dirichlet prior towards ``n`` observed distributions with these mean logarithms.

    The Hessian is a diagonal and a constant, so its inverse costs no more than the gradient. A step out of the positive
    numbers is not taken.
    """
    gradient = n * (digamma(prior.sum()) - digamma(prior) + mean_logs)
    constant, diagonal = n * trigamma(prior.sum()), -n * trigamma(prior)
    shift = (gradient / diagonal).sum() / (1 / constant + (1 / diagonal).sum())
    moved = prior - rate * (gradient - shift) / diagonal
    return moved if (moved > 0).all() else prior


def infer(
    starts: np.ndarray, terms: np.ndarray, counts: np.ndarray, exp_topics: np.ndarray, alpha: np.ndarray,
    rounds: int = MOST_ROUNDS, change: float = CHANGE,
) -> tuple[np.ndarray, np.ndarray]:
    """Topic weights of documents, and the weight of each document's topics for each of its terms.

    Document ``d`` has the terms ``starts[d]:starts[d + 1]``. All documents start from equal weights; one whose mean change falls
    below ``change`` is left as it is. Documents of like size are refined together, so few that a round stays in the
    processor's caches.
    """
    sizes = np.diff(starts)
    total = np.add.reduceat(np.append(counts, 0.0), starts[:-1]) * (sizes > 0)
    gamma = alpha + (total / len(alpha))[:, None]
    beta = exp_topics[:, terms].T
    order = np.argsort(sizes, kind="stable")[np.count_nonzero(sizes == 0) :]
    at = 0
    while at < len(order):
        n = len(order) - at
        while n > 1 and n * sizes[order[at + n - 1]] > TOGETHER:
            n = max(1, min(n - 1, TOGETHER // sizes[order[at + n - 1]]))
        own = order[at : at + n]
        at += n
        within = np.arange(sizes[own[-1]]) < sizes[own][:, None]
        places = np.where(within, starts[own][:, None] + np.arange(within.shape[1]), 0)
        # a place behind a document's terms counts nothing
        gamma[own] = _refined(gamma[own], beta[places], np.where(within, counts[places], 0.0), alpha, rounds, change)
    theta = np.repeat(np.exp(expected_log(gamma)), sizes, axis=0)
    shares = theta * beta
    return gamma, shares / np.maximum(shares.sum(1, keepdims=True), 1e-100)


def _refined(gamma: np.ndarray, beta: np.ndarray, counts: np.ndarray, alpha: np.ndarray, rounds: int, change: float) -> np.ndarray:
    """Topic weights of documents ``(d, k)`` whose terms have the weights ``(d, terms, k)`` and occur ``(d, terms)`` times."""
    gamma = gamma.copy()
    rows, going, share = np.arange(len(gamma)), np.ones(len(gamma), bool), np.full(len(alpha), 1 / len(alpha))
    for _ in range(rounds):
        theta = np.exp(expected_log(gamma[rows]))
        ratio = counts / (beta @ theta[:, :, None])[:, :, 0]
        moved = alpha + theta * (ratio[:, None, :] @ beta)[:, 0]
        moves = np.abs(moved - gamma[rows]) @ share
        gamma[rows[going]] = moved[going]
        going &= moves >= change
        left = np.count_nonzero(going)
        if not left:
            break
        if left <= len(rows) * 3 // 4:
            rows, beta, counts, going = rows[going], beta[going], counts[going], np.ones(left, bool)
    return gamma


@dataclass
class TopicModel:
    """Dictionary, topic-word weights and both priors."""

    vocabulary: list[str]
    weights: np.ndarray
    alpha: np.ndarray
    eta: np.ndarray
    about: dict = field(default_factory=dict)

    @property
    def exp_topics(self) -> np.ndarray:
        return np.exp(expected_log(self.weights))

    def save(self, spark: SparkSession, folder: str) -> None:
        """SNK4: a table with a row per term, and one with the topic prior and what the model was trained on."""
        columns = {"term_id": range(len(self.vocabulary)), "term": self.vocabulary, "eta": self.eta, "weights": self.weights.T.tolist()}
        spark.createDataFrame(pa.table(columns)).write.mode("overwrite").parquet(f"{folder}/dictionary")
        row = (self.alpha.tolist(), json.dumps(self.about, sort_keys=True))
        spark.createDataFrame([row], "alpha array<double>, about string").write.mode("overwrite").parquet(f"{folder}/model")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> TopicModel:
        """SRC6."""
        rows = spark.read.parquet(f"{folder}/dictionary").orderBy("term_id").collect()
        head = spark.read.parquet(f"{folder}/model").first()
        weights = np.array([r["weights"] for r in rows]).T
        return TopicModel([r["term"] for r in rows], weights, np.array(head["alpha"]), np.array([r["eta"] for r in rows]), json.loads(head["about"]))

    @staticmethod
    def exists(spark: SparkSession, folder: str) -> bool:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        paths = [jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}/_SUCCESS") for part in ("dictionary", "model")]
        return all(path.getFileSystem(conf).exists(path) for path in paths)

    def topics(self) -> np.ndarray:
        """The word distribution of each topic."""
        return self.weights / self.weights.sum(1, keepdims=True)

    def distribution(self, tokens: Column) -> Column:
        """The topic distribution of a token list; zeros if it has no known word."""
        known = python_tasks(SparkSession.active()).broadcast((self.vocabulary, self.exp_topics, self.alpha))

        @F.arrow_udf("array<double>")
        def distribution(lists: pa.Array) -> pa.Array:
            vocabulary, exp_topics, alpha = known.value
            rows = []
            for at, n in parts(lists, BATCH_DOCS):
                starts, terms, counts = counted(lists.slice(at, n), pa.array(vocabulary))
                gamma, _ = infer(starts, terms, counts, exp_topics, alpha)
                rows.append(gamma / gamma.sum(1, keepdims=True) * (np.diff(starts) > 0)[:, None])
            flat = np.concatenate(rows) if rows else np.zeros((0, len(alpha)))
            offsets = np.arange(len(flat) + 1, dtype=np.int32) * len(alpha)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))

        return distribution(tokens)


def counted(lists: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Known terms of token lists and how often each occurs: where each list begins, term ids, counts."""
    n = len(lists)
    words = lists.flatten()
    ids = pc.index_in(words, value_set=vocabulary.cast(words.type)) if len(words) else pa.array([], pa.int32())
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    keys = rows[known].astype(np.int64) * len(vocabulary) + pc.drop_null(ids).to_numpy(zero_copy_only=False)
    found, counts = np.unique(keys, return_counts=True)
    rows, terms = np.divmod(found, max(1, len(vocabulary)))
    return np.searchsorted(rows, np.arange(n + 1)), terms, counts.astype(np.float64)


def write_word_counts(df: DataFrame, vocabulary: list[str], chunks: int, tokens_col: str, id_col: str) -> str:
    """Write ``(terms, counts)`` of every document into a folder per chunk; the dictionary is looked up in place."""
    spark = df.sparkSession
    known = python_tasks(spark).broadcast(vocabulary)
    source = df.select(F.pmod(F.xxhash64(id_col), F.lit(chunks)).cast("int").alias("chunk"), F.col(tokens_col).alias("tokens"))

    def run(batches):
        terms_of = pa.array(known.value, pa.string())
        for part in (batch.slice(at, n) for batch in batches for at, n in parts(batch.column("tokens"), BATCH_DOCS)):
            starts, terms, counts = counted(part.column("tokens"), terms_of)
            offsets = pa.array(starts.astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (terms.astype(np.int32), counts)]
            yield pa.RecordBatch.from_arrays([part.column("chunk"), *lists], ["chunk", "terms", "counts"])

    path = f"{shared_folder(spark)}/word-counts-{uuid.uuid4().hex}"
    source.mapInArrow(run, "chunk int, terms array<int>, counts array<double>").write.partitionBy("chunk").parquet(path)
    return path


def expected_counts(counts: DataFrame, exp_topics: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Expected word counts of each topic over rows ``(terms, counts)``, the documents' summed expected log topic shares, and
    how many documents have a term. Tasks send sums per term, which are added up before they come to the driver."""
    k, size = exp_topics.shape
    known = python_tasks(counts.sparkSession).broadcast((exp_topics, alpha))
    names = [f"s{t}" for t in range(k)]

    def run(batches):
        exp_topics, alpha = known.value
        sums, logs, documents = np.zeros((size, k)), np.zeros(k), 0
        for batch in batches:
            for at, n in parts(batch.column("terms"), BATCH_DOCS):
                part = batch.slice(at, n)
                lists = part.column("terms")
                starts = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64)
                terms = lists.flatten().to_numpy(zero_copy_only=False)
                own = part.column("counts").flatten().to_numpy(zero_copy_only=False)
                gamma, shares = infer(starts, terms, own, exp_topics, alpha)
                np.add.at(sums, terms, shares * own[:, None])
                full = np.diff(starts) > 0
                logs += expected_log(gamma[full]).sum(0)
                documents += int(full.sum())
        used = np.flatnonzero(sums.any(1))
        # the row of term -1 has the log shares, that of term -2 the number of documents
        rows = np.concatenate((sums[used], logs[None], np.full((1, k), float(documents))))
        ids = np.concatenate((used, [-1, -2])).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(c) for c in rows.T.copy())], ["term", *names])

    summed = counts.select("terms", "counts").mapInArrow(run, f"term int, {', '.join(f'{n} double' for n in names)}")
    # at most a row per term of the dictionary
    found = summed.groupBy("term").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    ids = found.column("term").to_numpy()
    values = np.stack([found.column(n).to_numpy() for n in names], 1) if len(ids) else np.zeros((0, k))
    expected, logs, documents = np.zeros((size, k)), np.zeros(k), 0
    for term, row in zip(ids.tolist(), values, strict=True):
        if term >= 0:
            expected[term] = row
        elif term == -1:
            logs = row
        else:
            documents = int(row[0])
    return expected.T, logs, documents


def document_weights(
    df: DataFrame, vocabulary: list[str], exp_topics: np.ndarray, alpha: np.ndarray, rounds: int = MOST_ROUNDS,
    tokens_col: str = "topic_tokens", id_col: str = "review_id",
) -> DataFrame:
    """Rows ``(id, topic, weight)``: the topic weights of every document for given topics, after so many rounds."""
    known = python_tasks(df.sparkSession).broadcast((vocabulary, exp_topics, alpha))
    source = df.select(F.col(id_col).alias("id"), F.col(tokens_col).alias("tokens"))

    def run(batches):
        vocabulary, exp_topics, alpha = known.value
        for part in (batch.slice(at, n) for batch in batches for at, n in parts(batch.column("tokens"), BATCH_DOCS)):
            starts, terms, counts = counted(part.column("tokens"), pa.array(vocabulary, pa.string()))
            gamma, _ = infer(starts, terms, counts, exp_topics, alpha, rounds)
            ids = part.column("id").take(pa.array(np.repeat(np.arange(part.num_rows), len(alpha))))
            topics = pa.array(np.tile(np.arange(len(alpha), dtype=np.int32), part.num_rows))
            yield pa.RecordBatch.from_arrays([ids, topics, pa.array(gamma.ravel())], ["id", "topic", "weight"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, topic int, weight double").withColumnRenamed("id", id_col)


def update(model: TopicModel, step: int, expected: np.ndarray, logs: np.ndarray, documents: int, corpus: int) -> TopicModel:
    """The model after a chunk: weights move towards the corpus the chunk suggests, and both priors take a Newton step."""
    if not documents:
        return model
    rate = (OFFSET + step) ** -DECAY
    weights = (1 - rate) * model.weights + rate * (model.eta + expected * (corpus / documents))
    alpha = newton_step(model.alpha, documents, logs / documents, rate)
    eta = newton_step(model.eta, len(weights), expected_log(weights).mean(0), rate)
    return TopicModel(model.vocabulary, weights, alpha, eta, model.about)


def start(vocabulary: list[str], k: int, seed: int) -> TopicModel:
    weights = np.random.default_rng(seed).gamma(100.0, 0.01, (k, len(vocabulary)))
    return TopicModel(vocabulary, weights, np.full(k, 1 / k), np.full(len(vocabulary), 1 / k))


def fit(df: DataFrame, model: TopicModel, passes: int, chunks: int, tokens_col: str, id_col: str) -> TopicModel:
    """Train from given start values: ``passes`` times over all chunks."""
    spark = df.sparkSession
    path = write_word_counts(df, model.vocabulary, chunks, tokens_col, id_col)
    table = spark.read.parquet(path)
    corpus = table.filter(F.size("terms") > 0).count()
    filled = sorted(r["chunk"] for r in table.select("chunk").distinct().collect())  # at most ``chunks``
    schema = table.drop("chunk").schema
    for step in range(passes * len(filled)):
        chunk = spark.read.schema(schema).parquet(f"{path}/chunk={filled[step % len(filled)]}")
        model = update(model, step, *expected_counts(chunk, model.exp_topics, model.alpha), corpus)
    return model
