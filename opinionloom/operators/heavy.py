"""Terms that make up a large share of all words, in memory that doesn't grow with the vocabulary.

Every task keeps at most ``k`` counters (Misra and Gries): where there are more, the smallest of the ``k + 1`` largest is taken
off all of them. Such summaries can be added up and cut again, and a term's counter then falls short of its count by less
than a ``k``-th of all words. So every term with a share of ``1 / k`` and more is among at most ``k`` candidates, which a
second pass counts exactly.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinionloom.session import python_tasks, written

#: Words added to the counters at a time.
BATCH_WORDS = 100_000


def cut(counters: Counter, k: int) -> Counter:
    """At most ``k`` counters: the ``k + 1``-th largest value is taken off all."""
    if len(counters) <= k:
        return counters
    values = np.fromiter(counters.values(), np.int64, len(counters))
    off = int(np.partition(values, len(values) - k - 1)[len(values) - k - 1])
    return Counter({term: n - off for term, n in counters.items() if n > off})


def summaries(df: DataFrame, tokens_col: str, k: int) -> DataFrame:
    """Rows ``(term, n)``: the counters of every task, and in the row of the null term the number of its words."""
    python_tasks(df.sparkSession)

    def run(batches):
        counters: Counter = Counter()
        words = 0
        for batch in batches:
            terms = pc.drop_null(batch.column("tokens").flatten())
            words += len(terms)
            for at in range(0, len(terms), BATCH_WORDS):
                found = pc.value_counts(terms.slice(at, BATCH_WORDS))
                counters.update(dict(zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True)))
                counters = cut(counters, k)
        terms = pa.array([None, *counters], pa.string())
        yield pa.RecordBatch.from_arrays([terms, pa.array([words, *counters.values()], pa.int64())], ["term", "n"])

    return df.select(F.col(tokens_col).alias("tokens")).mapInArrow(run, "term string, n long")


def heavy_terms(df: DataFrame, k: int, tokens_col: str = "tokens") -> DataFrame:
    """AGG20, TOPK3: rows ``(term, n)`` of the terms that are a ``k``-th of all words and more; null terms don't count.

    At most ``k`` candidates are sent to the second pass. The token lists are read twice.
    """
    merged = written(summaries(df, tokens_col, k).groupBy("term").agg(F.sum("n").alias("n")), "summaries")
    total = merged.filter("term is null").agg(F.sum("n")).first()[0] or 0
    largest = merged.filter("term is not null").orderBy(F.desc("n")).limit(k + 1).collect()
    off = largest[k]["n"] if len(largest) > k else 0
    candidates = [(r["term"],) for r in largest[:k] if r["n"] > off]
    listed = df.sparkSession.createDataFrame(candidates, "term string")
    words = df.select(F.explode(tokens_col).alias("term")).join(F.broadcast(listed), "term")
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * k >= total)
