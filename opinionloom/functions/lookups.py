"""Lookups of words in small tables without a join, and the join for tables that are not small.

A table of at most ``MAX_INLINE_ROWS`` rows is folded into the plan as a literal; the text never moves. A longer
table is joined, with the hot words of the big side salted over several partitions.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinionloom.functions.binding import column, quoted
from opinionloom.session import written

MAX_INLINE_ROWS = 20_000
#: Word tables of at most this many bytes are broadcast.
BROADCAST_BYTES = 64 << 20
#: A word may be this share of all word rows; a salted join spreads each word over so many tasks of the session.
HOT_SHARE = 3
ENTRIES_PER_BUCKET = 4


def inline_map(pairs: Mapping[str, object], value_type: str) -> Callable[[str], str]:
    """A function ``SQL of a word -> SQL of its value or null`` over a literal hash table.

    Spark scans a map literal from the front, so the table is cut into short maps addressed by ``crc32``. The JSON
    text is constant-folded by the optimizer: tasks see ready-made maps.
    """
    buckets: list[dict[str, object]] = [{} for _ in range(max(1, len(pairs) // ENTRIES_PER_BUCKET))]
    for word, value in pairs.items():
        buckets[zlib.crc32(word.encode()) % len(buckets)][word] = value
    table = f"from_json({quoted(json.dumps(buckets))}, 'array<map<string,{value_type}>>')"

    def lookup(word: str) -> str:
        return f"try_element_at(get({table}, int(crc32(binary({word})) % {len(buckets)})), {word})"

    return lookup


def membership(words: Iterable[str]) -> Callable[[str], str]:
    """A function ``SQL of a word -> SQL of a boolean``; null counts as absent."""
    listed = sorted(set(words))
    if not listed:
        return lambda word: "false"
    literals = ", ".join(quoted(word) for word in listed)
    return lambda word: f"coalesce({word} IN ({literals}), false)"


def rows_within(df: DataFrame, bound: int) -> list | None:
    """The rows of a table of at most ``bound`` rows, else None; never brings more than ``bound + 1`` rows back."""
    rows = df.limit(bound + 1).collect()
    return rows if len(rows) <= bound else None


def one_row_per_key(table: DataFrame) -> DataFrame:
    """Of rows with the same key (the first column) the one with the smallest value counts; null keys are left out."""
    key, value = table.columns[:2]
    return table.filter(F.col(column(key)).isNotNull()).groupBy(column(key)).agg(F.min(column(value)).alias(value))


def table_to_dict(table: DataFrame | Mapping[str, object], bound: int = MAX_INLINE_ROWS) -> dict | None:
    """A two-column table as a dict when it is short enough to be folded into a plan, else None."""
    if isinstance(table, Mapping):
        return dict(table) if len(table) <= bound else None
    rows = rows_within(one_row_per_key(table), bound)
    return None if rows is None else {row[0]: row[1] for row in rows}


def table_bytes(table: DataFrame) -> int:
    """Measured size of a small table of texts and numbers: its characters, and 16 bytes a value."""
    texts = [F.coalesce(F.octet_length(column(n)), F.lit(0)) for n, kind in table.dtypes if kind == "string"]
    size = sum(texts, F.lit(16 * len(table.columns)).cast("long"))
    return table.agg(F.sum(size)).first()[0] or 0


def word_join(words: DataFrame, table: DataFrame, on: str, spread_by: Iterable[str], how: str = "inner") -> DataFrame:
    """Equi-join of word rows with a word table: broadcast while the table's measured size allows it, else salted."""
    if table_bytes(table) <= BROADCAST_BYTES:
        return words.join(F.broadcast(table), on, how)
    return salted_join(words, table, on, spread_by, how)


def lookup_join(df: DataFrame, table: DataFrame, on: str, how: str = "left", bound: int = MAX_INLINE_ROWS) -> DataFrame:
    """Lookup join: broadcast once the table is known to be short, otherwise planned by Spark."""
    short = table.select(on).limit(bound + 1).count() <= bound
    return df.join(F.broadcast(table) if short else table, on, how)


def hot_words(words: DataFrame, on: str, salts: int) -> list:
    """Words that are more than a ``salts``-th of all rows: fewer than ``salts`` of them."""
    counts = written(words.groupBy(on).agg(F.count(F.lit(1)).alias("n")), "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return [r[on] for r in counts.filter((F.col("n") * salts > total) & F.col(on).isNotNull()).select(on).collect()]


def salted_join(
    df: DataFrame, table: DataFrame, on: str, spread_by: Iterable[str], how: str = "inner", salts: int | None = None
) -> DataFrame:
    """Equi-join of word rows with a long word table; each measured hot word is spread over ``salts`` partitions.

    By default that is a third of the session's shuffle partitions, so that the task of a word that is a third of all
    rows is no larger than the others. Of the table only the rows of hot words are repeated. The word rows are read twice.
    """
    if salts is None:
        salts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // HOT_SHARE)
    hot = hot_words(df, on, salts)
    if not hot:
        return df.join(table, on, how)
    is_hot = F.coalesce(F.col(on).isin(hot), F.lit(False))
    salted = df.withColumn("_salt", F.when(is_hot, F.pmod(F.hash(*spread_by), F.lit(salts))).otherwise(0))
    copies = table.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(copies, [on, "_salt"], how).drop("_salt")
