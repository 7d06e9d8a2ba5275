"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared as lower-case letters and digits with single blanks between. An item of ``m`` characters is searched
with an edit budget ``k`` of ``RATE`` times ``m``. An occurrence within the budget shares at least ``m + 1 - q (k + 1)``
q-grams with the item, on diagonals at most ``k`` apart. So shared q-grams are counted in diagonal bands of width
``2 (k + 1)`` that overlap by half; bands that reach the number are retained, and each is verified by an alignment of the
whole item within the band.

``q`` is the largest of ``GRAMS`` for which the lemma still asks for a shared q-gram at the full budget: 8 for items of 40
characters and more and wherever else it does, else 4. Items of fewer than ``LEAST_CHARS`` characters have no budget; they
are found where they stand as whole words, by q-grams of their own size.

The items go to the tasks in blocks of bounded size, each distinct item once; every block is searched in every text.

Defined cases: null texts and null items match nothing, nor do items without a letter or digit. Repeated rows give repeated
results.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinionloom.llm.arrow_text import in_python, slices

#: Sizes of q-grams, powers of two.
GRAMS = (8, 4, 2, 1)
#: Shorter items match whole words only.
LEAST_CHARS = 8
RATE = 0.1
#: Characters of benchmark text sent to the tasks at a time.
BLOCK_CHARS = 2_000_000
SLICE_BYTES = 2 << 20
TABLE_BITS = 22
SPACE = 32
PRIME = 0x9E3779B97F4A7C15
LEAKS = "array<struct<item_id:{kind},start:int,stop:int,edits:int>>"


@cache
def _letters() -> np.ndarray:
    """Which code points are letters or digits; those beyond the first plane count as letters."""
    return np.array([chr(c).isalnum() for c in range(1 << 16)])


def lowered(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def normalized(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each closed by a zero; the place in its text of each; where in the array each text begins."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    points = np.frombuffer("\n".join([*map(lowered, texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    letter = _letters()[np.minimum(points, 0xFFFF)] | (points > 0xFFFF)
    points[~letter] = SPACE
    points[ends - 1] = 0
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != SPACE) | (points[:-1] != SPACE)
    kept = np.flatnonzero(keep)
    begins = np.searchsorted(kept, ends - sizes)
    return points[kept], kept - np.repeat(ends - sizes, np.diff(np.append(begins, len(kept)))), begins


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every run of ``q`` code points (a power of two), by doubling."""
    hashes, size, factor = points, 1, PRIME
    with np.errstate(over="ignore"):
        while size < q:
            hashes = hashes[:-size] + hashes[size:] * np.uint64(factor)
            factor = factor * factor % (1 << 64)
            size *= 2
        return hashes * np.uint64(PRIME)


def budget(m: int, rate: float = RATE) -> int:
    """Edits allowed in an item of ``m`` characters."""
    return math.floor(rate * m) if m >= LEAST_CHARS else 0


def gram_size(m: int, rate: float = RATE) -> int:
    """The largest ``q`` of which an occurrence within the budget shares one at least."""
    return next(q for q in GRAMS if m + 1 - q * (budget(m, rate) + 1) >= 1 or q == 1)


def trimmed(text: str) -> np.ndarray:
    """The normalised code points of an item, without blanks at its ends."""
    points = normalized([text])[0][:-1]
    points = points[1:] if len(points) and points[0] == SPACE else points
    return points[:-1] if len(points) and points[-1] == SPACE else points


def indexes(items: list[tuple], rate: float = RATE) -> list[Index]:
    """The items ``(id, text, times)`` in an index per size of q-grams, largest first."""
    by_size: dict[int, list] = {q: [] for q in GRAMS}
    for item_id, text, times in items:
        points = trimmed(text)
        if len(points):
            by_size[gram_size(len(points), rate)].append((item_id, points, times))
    return [Index(own, q, rate) for q, own in by_size.items() if own]


class Index:
    """The q-grams of the items of a block that have q-grams of one size; items are ``(id, points, times)``."""

    def __init__(self, items: list[tuple], q: int, rate: float = RATE):
        self.q, self.ids, self.points, self.times, self.k, self.least = q, [], [], [], [], []
        hashes, owners, offsets = [], [], []
        for item_id, points, times in items:
            grams, k = gram_hashes(points, q), budget(len(points), rate)
            hashes.append(grams)
            owners.append(np.full(len(grams), len(self.ids)))
            offsets.append(np.arange(len(grams)))
            self.ids.append(item_id)
            self.points.append(points)
            self.times.append(times)
            self.k.append(k)
            self.least.append(max(1, len(points) + 1 - q * (k + 1)))
        self.table = np.zeros(1 << TABLE_BITS, bool)
        if self.ids:
            every = np.concatenate(hashes)
            order = np.argsort(every, kind="stable")
            self.owners, self.offsets = np.concatenate(owners)[order], np.concatenate(offsets)[order]
            self.grams, self.firsts, self.many = np.unique(every[order], return_index=True, return_counts=True)
            self.table[self.grams >> np.uint64(64 - TABLE_BITS)] = True
            self.k, self.least = np.array(self.k), np.array(self.least)

    def regions(self, points: np.ndarray) -> list[tuple[int, int, int]]:
        """Retained bands as ``(item, first diagonal, last diagonal)``; neighbouring bands are one."""
        if not self.ids or len(points) < self.q:
            return []
        hashes = gram_hashes(points, self.q)
        at = np.flatnonzero(self.table[hashes >> np.uint64(64 - TABLE_BITS)])
        found = np.searchsorted(self.grams, hashes[at])
        found[found == len(self.grams)] = 0
        true = self.grams[found] == hashes[at]
        at, found = at[true], found[true]
        many = self.many[found]
        posting = np.repeat(self.firsts[found] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        item = self.owners[posting]
        width = self.k[item] + 1
        # diagonals are shifted so that none is negative
        shift = max(map(len, self.points))
        band = (np.repeat(at, many) - self.offsets[posting] + shift) // width
        span = len(points) + shift + 2
        keys = item * span + band
        keys, counts = np.unique(keys, return_counts=True)
        # a band holds the hits of two cells of half its width: cell b is in bands b and b - 1
        own = np.concatenate((keys, keys - 1))
        sums = np.concatenate((counts, counts))
        order = np.argsort(own, kind="stable")
        own, sums = own[order], sums[order]
        if not len(own):
            return []
        edge = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        totals, bands = np.add.reduceat(sums, edge), own[edge]
        items = (bands + 1) // span
        bands = bands[totals >= self.least[np.minimum(items, len(self.ids) - 1)]]
        out: list[tuple[int, int, int]] = []
        for key in bands.tolist():
            i = (key + 1) // span
            b, w = key - i * span, int(self.k[i]) + 1
            low, high = b * w - shift, (b + 2) * w - 1 - shift
            if out and out[-1][0] == i and low <= out[-1][2] + 1:
                out[-1] = (i, out[-1][1], high)
            else:
                out.append((i, low, high))
        return out

    def verify(self, points: np.ndarray, item: int, low: int, high: int, begin: int, end: int) -> tuple[int, int, int] | None:
        """``(first, last, edits)`` of the best occurrence within the budget in ``points[begin:end]`` on these diagonals."""
        pattern, k = self.points[item], int(self.k[item])
        start, stop = max(begin, low), min(end, high + len(pattern) + k)
        if stop - start < len(pattern) - k:
            return None
        window = points[start:stop]
        if len(pattern) < LEAST_CHARS:
            for at in range(start, stop - len(pattern) + 1):
                own = slice(at, at + len(pattern))
                if np.array_equal(points[own], pattern) and all(points[i] in (0, SPACE) for i in (own.stop, at - 1) if i >= begin):
                    return at, own.stop, 0
            return None
        exact = window.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").find(
            pattern.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        )
        if exact >= 0:
            return start + exact, start + exact + len(pattern), 0
        edits, last = banded_end(pattern, window, low - start, high - start, free=True, most=k)
        if edits > k:
            return None
        back = window[:last][::-1]
        _, size = banded_end(pattern[::-1], back, -k, k, free=False, most=k)
        return start + last - size, start + last, edits


def banded_end(pattern: np.ndarray, window: np.ndarray, low: int, high: int, free: bool, most: int) -> tuple[int, int]:
    """Least edits of the whole pattern against a part of the window, and where that part ends.

    Only cells whose window place less pattern place lies in ``low .. high`` are filled. With ``free`` the part begins
    anywhere, else at the window's start. Row by row; within a row steps along the window are a running minimum. Gives up
    when all cells of a row are above ``most``.
    """
    m, n = len(pattern), len(window)
    wide = high - low + 1
    far = 1 << 20
    # the window as seen from the first row's band on; outside of it no character is equal
    places = np.arange(low, high + 1 + m)
    inside = (places >= 0) & (places < n)
    seen = np.zeros(len(places), window.dtype)
    seen[inside] = window[places[inside]]
    blocked = np.where(inside, 0, far)  # no step over a place outside
    after = np.where((places >= 0) & (places <= n), 0, far)
    row = np.where(after[:wide] == 0, 0 if free else np.abs(places[:wide]), far)
    steps = np.arange(wide)
    for i in range(m):
        best = row + (seen[i : i + wide] != pattern[i]) + blocked[i : i + wide]
        np.minimum(best[:-1], row[1:] + 1, out=best[:-1])
        best -= steps
        row = np.minimum.accumulate(best) + steps + after[i + 1 : i + 1 + wide] if i + 1 < m else np.minimum.accumulate(best) + steps
        if i % 16 == 15 and row.min() > most:
            break
    row = row + np.where((places[-wide:] >= 0) & (places[-wide:] <= n), 0, far)
    best_at = int(np.argmin(row))
    return int(row[best_at]), low + best_at + m


def search(texts: list[str], parts: list[Index]) -> list[list[tuple]]:
    """For each text the ``(item_id, start, stop, edits)`` of the best occurrence of each item within its budget."""
    points, places, begins = normalized(texts)
    ends = np.append(begins[1:], len(points)) - 1
    best: dict[tuple[int, int, int], tuple[int, int, int]] = {}
    for part, index in enumerate(parts):
        for item, low, high in index.regions(points):
            first = max(0, int(np.searchsorted(begins, max(low, 0), side="right")) - 1)
            last = int(np.searchsorted(begins, high + len(index.points[item]), side="right"))
            for row in range(first, last):
                hit = index.verify(points, item, low, high, int(begins[row]), int(ends[row]))
                own = (row, part, item)
                if hit and (own not in best or (hit[2], hit[0]) < (best[own][2], best[own][0])):
                    best[own] = hit
    found: list[list[tuple]] = [[] for _ in texts]
    for (row, part, item), (start, stop, edits) in sorted(best.items()):
        hit = (parts[part].ids[item], int(places[start]), int(places[stop - 1]) + 1, edits)
        found[row] += [hit] * parts[part].times[item]
    return found


def _blocks(benchmark: DataFrame, item_key: str, item_text: str):
    """The distinct items and how often each is there, at most about ``BLOCK_CHARS`` at a time; hashed, so that blocks are
    alike in size."""
    items = benchmark.select(F.col(item_key).alias("item_id"), F.col(item_text).alias("item")).filter("item is not null")
    items = items.groupBy("item_id", "item").agg(F.count("*").alias("times"))
    size = items.agg(F.sum(F.length("item"))).first()[0] or 0
    blocks = -(-size // BLOCK_CHARS)
    for block in range(blocks):
        yield [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)) == block).collect()]


def find_leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    rate: float = RATE,
    leaks: str = "leaks",
) -> DataFrame:
    """The documents with a column ``leaks``: an array of ``item_id, start, stop, edits`` (code points of the text)."""
    kind = benchmark.schema[item_key].dataType.simpleString()
    marked = documents.withColumn(leaks, F.array().cast(LEAKS.format(kind=kind)))
    for items in _blocks(benchmark, item_key, item_text):
        marked = _search_block(marked, items, text, leaks, rate)
    return marked


def _search_block(documents: DataFrame, items: list[tuple], text: str, leaks: str, rate: float) -> DataFrame:
    shipped = documents.sparkSession.sparkContext.broadcast(items)
    # columns go by place: their names may hold dots
    plain = documents.toDF(*(f"c{i}" for i in range(len(documents.columns))))
    text_name, at = f"c{documents.columns.index(text)}", documents.columns.index(leaks)

    def run(batches):
        parts = indexes(shipped.value, rate)
        for batch in slices(batches, text_name, SLICE_BYTES):
            found = search([t or "" for t in batch.column(text_name).to_pylist()], parts)
            former = batch.column(at).to_pylist()
            rows = [[*old, *({"item_id": a, "start": b, "stop": c, "edits": d} for a, b, c, d in new)] for old, new in zip(former, found)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(rows, batch.schema.field(at).type))

    return in_python(plain, run, plain.schema).toDF(*documents.columns)


def contaminated(
    documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Rows ``(key, item, start, stop, edits)`` for every document and every item it holds; ``item`` is named as ``item_key``."""
    narrow = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = find_leaks(narrow, benchmark, "text", item_key, item_text)
    return found.select(F.col("key").alias(key), F.inline("leaks")).withColumnRenamed("item_id", item_key)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no item."""
    leaks = "_leaks"
    while leaks in documents.columns:
        leaks += "_"
    return find_leaks(documents, benchmark, text, leaks=leaks).filter(F.size(F.col(leaks)) == 0).drop(leaks)
