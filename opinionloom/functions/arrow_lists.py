"""Lists of words in Arrow batches: bounded parts of them, and lookups of their words in a dictionary every task holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinionloom.functions.binding import column
from opinionloom.session import python_tasks

#: Word tables of at most this many bytes, as Arrow holds them, are given to every Python worker.
DICTIONARY_BYTES = 128 << 20
#: Values of lists that are worked on at a time.
PART_VALUES = 1 << 20


def parts(lists: pa.ListArray, most_rows: int, most_values: int = PART_VALUES) -> Iterator[tuple[int, int]]:
    """Begin and number of rows of parts with at most so many rows and list values; a longer list is a part of its own."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = int(ends[at - 1]) if at else 0
        stop = int(np.searchsorted(ends, before + most_values, side="right"))
        stop = min(max(at + 1, stop), at + most_rows)
        yield at, stop - at
        at = stop


def arrow_bytes(table: DataFrame) -> int:
    """Size of a word table as Arrow holds it: the bytes of its texts, and eight a value."""
    texts = [F.coalesce(F.octet_length(column(n)), F.lit(0)) for n, kind in table.dtypes if kind == "string"]
    return table.agg(F.sum(sum(texts, F.lit(8 * len(table.columns)).cast("long")))).first()[0] or 0


def dictionary(table: DataFrame) -> Broadcast:
    """The columns of a word table, at most ``DICTIONARY_BYTES`` of it, for the Python workers."""
    rows = table.toArrow()
    return python_tasks(table.sparkSession).broadcast([rows.column(n).combine_chunks() for n in rows.column_names])


def places(words: pa.Array, terms: pa.Array) -> np.ndarray:
    """Where each word stands among distinct terms; -1 for others and null."""
    if not len(words):
        return np.zeros(0, np.int64)
    found = pc.index_in(words, value_set=terms.cast(words.type), skip_nulls=True)
    return pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def ids_repeat(df: DataFrame, id_col: str) -> bool:
    """Whether some id belongs to more than one row; only the ids are read and move."""
    ids = df.select(F.col(column(id_col)).alias("id")).filter("id IS NOT NULL")
    return not ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
