"""Keyword search that reads only the files which can hold a match.

The reviews are written in buckets by a hash of their id, a folder per bucket, next to an index: for every three
characters in a row (plain letters in lower case, digits, signs, blanks) and every bucket the ids of the reviews that have
them, ascending, as differences. The number of buckets grows with the reviews, so no list is longer than a bucket.

A pattern is searched for plain runs that every match must hold, one set of triples per alternative. The rarest triples'
lists give the candidates; their buckets are read, and the pattern itself is tested on the candidates. A pattern without such a run
is tested on all reviews. So the rows are the same as without an index.

Matching ignores case as Java does: a few letters beyond ASCII equal ``i``, ``k`` or ``s``, and are indexed as such. Other letters
beyond ASCII are in no triple, neither of texts nor of patterns. Reviews without a text or an id are found by no term.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinionloom.operators.search import search
from opinionloom.session import python_tasks, written

BUCKET_ROWS = 50_000
#: Reviews whose triples a task lists together.
LIST_ROWS = 5_000
#: Lists of triples that are intersected for one alternative; the rarest are taken.
MOST_LISTS = 3
#: Letters that equal i, i, s and k when case is ignored.
_LIKE_PLAIN = ("ıİſK", "iisk")
_PLAIN = range(0x20, 0x7F)


def gram(three: str) -> int:
    a, b, c = three.lower().encode()
    return a << 16 | b << 8 | c


def grams_of(text: bytes) -> np.ndarray:
    """The triples of a text, each once."""
    raw = np.frombuffer(text.lower(), np.uint8).astype(np.int32)
    if len(raw) < 3:
        return np.zeros(0, np.int32)
    plain = (raw >= _PLAIN.start) & (raw < _PLAIN.stop)
    whole = plain[:-2] & plain[1:-1] & plain[2:]
    return np.unique((raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:])[whole])


_ATOM = re.compile(
    r"""\\(?P<escaped>[^A-Za-z0-9])|(?P<class>\\[dDwWsSbB]|\.|\^|\$|\[\^?[^\[\]\\&]+\])|(?P<literal>[^\\\[\](){}*+?|.^$])""", re.X
)
_REPEAT = re.compile(r"[*?]|\{0|\+|\{[1-9]")


def required_runs(alternative: str) -> list[str] | None:
    """Plain runs every match of a pattern without alternatives holds; None if the pattern has parts not looked into."""
    runs, at, run = [], 0, ""
    while at < len(alternative):
        atom = _ATOM.match(alternative, at)
        if not atom:
            return None
        at = atom.end()
        sign = atom["escaped"] or atom["literal"]
        repeat = _REPEAT.match(alternative, at)
        if repeat:
            end = re.compile(r"(?:[*+?]|\{[0-9]+(?:,[0-9]*)?\})[?+]?").match(alternative, at)
            if not end:
                return None
            at = end.end()
        plain = sign is not None and ord(sign) in _PLAIN
        if plain and not repeat:
            run += sign
            continue
        if plain and repeat[0] in "+" or plain and repeat[0].startswith("{") and repeat[0] != "{0":
            runs.append(run + sign)  # once at least; what follows may be another one
            run = sign if repeat[0] == "+" else ""
        else:
            runs.append(run)
            run = ""
    return [r for r in [*runs, run] if r]


def required_grams(pattern: str, literal: bool = False) -> list[set[int]] | None:
    """For every alternative of a pattern the triples its matches hold; None if some alternative has none."""
    if literal:
        alternatives = [[pattern]]
    elif "(" in pattern or "\\Q" in pattern:
        return None
    else:
        alternatives = [required_runs(a) for a in re.split(r"(?<!\\)\|", pattern)] if "\\\\" not in pattern else [None]
    found = []
    for runs in alternatives:
        pieces = [p for run in runs or [] for p in re.findall(r"[\x20-\x7e]{3,}", run)]
        grams = {gram(p[i : i + 3]) for p in pieces for i in range(len(p) - 2)}
        if not grams:
            return None
        found.append(grams)
    return found


def build_index(df: DataFrame, path: str, text_col: str = "review_text", id_col: str = "review_id", bucket_rows: int = BUCKET_ROWS) -> None:
    """Write the reviews by bucket under ``rows`` and the lists under ``lists``; ids are whole numbers."""
    spark = df.sparkSession
    python_tasks(spark)
    df = written(df, "indexed-rows")
    buckets = max(1, -(-df.count() // bucket_rows))
    placed = df.withColumn("bucket", F.pmod(F.coalesce(F.xxhash64(id_col), F.lit(0)), F.lit(buckets)).cast("int"))
    placed.repartition(buckets, "bucket").write.partitionBy("bucket").parquet(f"{path}/rows")
    rows = spark.read.schema(placed.schema).parquet(f"{path}/rows").filter(F.col(id_col).isNotNull())
    source = rows.select("bucket", F.col(id_col).cast("long").alias("id"), F.translate(text_col, *_LIKE_PLAIN).alias("text"))

    def run(batches):
        for batch in (b.slice(at, LIST_ROWS) for b in batches for at in range(0, b.num_rows, LIST_ROWS)):
            found = [grams_of(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            rows = np.repeat(np.arange(batch.num_rows), [len(g) for g in found])
            grams = np.concatenate(found).astype(np.int64)
            ids = batch.column("id").to_numpy(zero_copy_only=False)[rows]
            buckets = batch.column("bucket").to_numpy(zero_copy_only=False).astype(np.int64)[rows]
            keys = buckets << 24 | grams
            order = np.lexsort((ids, keys))
            keys = keys[order]
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(keys)).astype(np.int32)), pa.array(ids[order]))
            keys = keys[first]
            columns = [pa.array((keys >> 24).astype(np.int32)), lists, pa.array((keys & 0xFFFFFF).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "ids", "gram"])

    # lists of a few thousand reviews move, not every triple of every review; a list is no longer than its bucket
    grams = source.mapInArrow(run, "bucket int, ids array<long>, gram int").repartition("gram", "bucket")
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids"))))
    lists = grams.groupBy("gram", "bucket").agg(ids.alias("ids"))
    steps = F.expr("transform(ids, (id, i) -> if(i = 0, id, id - ids[i - 1]))")
    ordered = lists.select("gram", "bucket", F.size("ids").alias("n"), steps.alias("steps")).sortWithinPartitions("gram", "bucket")
    ordered.write.parquet(f"{path}/lists")


def _ids(lists: DataFrame) -> DataFrame:
    """Rows ``(bucket, gram, id)`` of lists: the running sums of their steps. A list is no longer than its bucket."""
    steps = lists.select("bucket", "gram", F.posexplode("steps").alias("pos", "step"))
    return steps.withColumn("id", F.sum("step").over(Window.partitionBy("bucket", "gram").orderBy("pos")))


def candidates(spark: SparkSession, path: str, wanted: Sequence[set[int]]) -> DataFrame:
    """Rows ``(bucket, id)`` of the reviews that hold the rarest triples of an alternative."""
    lists = spark.read.parquet(f"{path}/lists")
    everything = sorted(set().union(*wanted))
    counted = lists.filter(F.col("gram").isin(everything)).groupBy("gram").agg(F.sum("n").alias("n"))
    sizes = {r["gram"]: r["n"] for r in counted.collect()}  # a row per triple of the pattern
    found = []
    for grams in wanted:
        rarest = sorted(grams, key=lambda g: (sizes.get(g, 0), g))[:MOST_LISTS]
        own = _ids(lists.filter(F.col("gram").isin(rarest)))
        found.append(own.groupBy("bucket", "id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(rarest)).drop("n"))
    return reduce(DataFrame.union, found).distinct()


def search_index(
    spark: SparkSession,
    path: str,
    topics: Sequence[str] = (),
    sentiments: Sequence[str] = (),
    ratings: Sequence[int] = (),
    term: str = "",
    literal: bool = False,
    id_col: str = "review_id",
) -> DataFrame:
    """FLT8 to FLT13 over an index: the rows that ``search`` finds in the indexed reviews."""
    rows = spark.read.parquet(f"{path}/rows")
    wanted = required_grams(term.strip(), literal) if term.strip() else None
    if wanted is not None:
        near = candidates(spark, path, wanted)
        buckets = [r["bucket"] for r in near.select("bucket").distinct().collect()]  # numbers of buckets
        rows = rows.filter(F.col("bucket").isin(buckets)) if buckets else rows.filter(F.lit(False))
        near = near.select(F.col("bucket").alias("_bucket"), F.col("id").alias("_id"))
        rows = rows.join(near, (F.col("bucket") == F.col("_bucket")) & (F.col(id_col) == F.col("_id")), "left_semi")
    return search(rows, topics, sentiments, ratings, term, literal).drop("bucket")
