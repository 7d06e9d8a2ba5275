"""Best-fit packing of documents into sequences of a fixed number of tokens.

Pieces above a third of the capacity fit at most twice into a sequence: from the longest down, each is matched with the
longest other one that still fits. Smaller pieces then go, longest first, into the smallest gap that holds them.

Pieces of equal length are interchangeable. So the packing is computed on the number of pieces per length (at most
``capacity`` numbers, whatever the corpus) as groups of equally filled sequences, and is the very result a run over all
pieces would give. The pieces are then numbered within their length and look up their place.

Defined cases: a null text is empty; its ids are the end id alone. Rows with equal keys are documents of their own. An
empty table packs into nothing.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from opinionloom.llm.arrow_text import in_python, slices
from opinionloom.session import written

CAPACITY = 2048
END_ID = 0
SLICE_BYTES = 12 << 20
#: Pieces of one length are numbered in parts, about one for so many pieces in all.
PART_ROWS = 500_000
LEAST_PARTS = 64
#: Ids of words a worker remembers across batches; above this number it forgets those not seen since the last time.
REMEMBERED = 200_000
#: A word of plain letters and the signs behind it are tokenized one by one, the letters in lower case.
_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")


class ChunkTokenizer:
    """Ids of texts, where each distinct word is tokenized once.

    Right for lower-casing tokenizers whose pre-tokenizer drops white space and parts letters from signs, so that no token
    or special token crosses these places.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(file)
        for probe in ("ab cd", "ab\ncd\t ef", "a's <|x|> b", " ab  c ", "École, ab?! Cd.", "x;y z..."):
            whole = self.tokenizer.encode(probe, add_special_tokens=False).ids
            words = [p for c in probe.split() for p in self._parted(c) if p]
            parts = [i for w in words for i in self.tokenizer.encode(w, add_special_tokens=False).ids]
            if whole != parts:
                raise ValueError(f"{file} doesn't tokenize words one by one")
        self.known: dict[str, bytes] = {}  # ids as 32-bit integers
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _parted(chunk: str) -> tuple[str, str]:
        plain = _WORD.fullmatch(chunk)
        return (plain[1].lower(), plain[2]) if plain else (chunk, "")

    def _learn(self, words: set[str]) -> None:
        """Have the ids of all words in ``known``: from former batches, or by the tokenizer."""
        known, older, chunks = self.known, self.older, []
        for word in words:
            if word not in known:
                ids = older.get(word)
                if ids is None:
                    chunks.append(word)
                else:
                    known[word] = ids
        for at in range(0, len(chunks), 4096):
            part = chunks[at : at + 4096]
            encoded = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            for chunk, one in zip(part, encoded, strict=True):
                self.known[chunk] = array("I", one.ids).tobytes()

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, without special tokens added."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = words.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        parted = [self._parted(c) for c in names]
        self._learn({w for pair in parted for w in pair})
        packed = [self.known[w] + self.known[signs] if signs else self.known[w] for w, signs in parted]
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        flat = np.frombuffer(b"".join(packed), np.uint32)
        firsts = np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        counts = sizes[codes]
        ends = np.cumsum(counts)
        # position of each id in flat: the start of its chunk plus its place within
        places = np.repeat(firsts[codes] - (ends - counts), counts) + np.arange(int(counts.sum()))
        ids = flat[places]
        offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
        bounds = np.concatenate(([0], ends))[offsets]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


@cache
def _tokenizer(file: str) -> ChunkTokenizer:
    return ChunkTokenizer(file)


def pieces(
    documents: DataFrame, tokenizer_file: str, key: str, text: str, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """Rows ``(key, piece, start, length, ids_crc32)``: documents closed by ``end_id`` and cut only above ``capacity``."""
    source = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    end = np.array([end_id], np.uint32)

    def run(batches):
        tokenizer = _tokenizer(tokenizer_file)
        for batch in slices(batches, "text", SLICE_BYTES):
            rows, numbers, starts, lengths, sums = [], [], [], [], []
            for row, ids in enumerate(tokenizer.ids(batch.column("text"))):
                closed = np.concatenate((ids, end)).astype("<u4")
                for number, start in enumerate(range(0, len(closed), capacity)):
                    piece = closed[start : start + capacity]
                    rows.append(row)
                    numbers.append(number)
                    starts.append(start)
                    lengths.append(len(piece))
                    sums.append(zlib.crc32(piece.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32())]
                + [pa.array(x, pa.int64()) for x in (starts, lengths, sums)],
                ["key", "piece", "start", "length", "ids_crc32"],
            )

    kind = source.schema["key"].dataType.simpleString()
    return in_python(source, run, f"key {kind}, piece int, start long, length long, ids_crc32 long")


class Groups:
    """Groups of equally filled sequences: what is in them, how many there are, ordered by the gap they leave."""

    def __init__(self) -> None:
        self.by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = {}
        self.gaps: list[int] = []

    def add(self, gap: int, pattern: tuple[int, ...], many: int) -> None:
        if gap not in self.by_gap:
            bisect.insort(self.gaps, gap)
            self.by_gap[gap] = []
        self.by_gap[gap].append((pattern, many))

    def take_smallest(self, least: int) -> tuple[int, tuple[int, ...], int] | None:
        """Remove and return a group of the smallest gap of at least ``least``."""
        at = bisect.bisect_left(self.gaps, least)
        if at == len(self.gaps):
            return None
        gap = self.gaps[at]
        pattern, many = self.by_gap[gap].pop()
        if not self.by_gap[gap]:
            del self.by_gap[gap]
            self.gaps.pop(at)
        return gap, pattern, many

    def all(self) -> list[tuple[tuple[int, ...], int]]:
        return [one for gap in self.gaps for one in self.by_gap[gap]]


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Pack ``counts[length]`` pieces of each length: a list of (lengths in one sequence, number of such sequences)."""
    left = {n: c for n, c in counts.items() if c}
    groups = Groups()
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        longest = large[-1]
        at = bisect.bisect_right(large, capacity - longest) - 1
        if at < 0:
            groups.add(capacity - longest, (longest,), left[longest])
            large.pop()
            continue
        other = large[at]
        many = left[longest] // 2 if other == longest else min(left[longest], left[other])
        if many:
            groups.add(capacity - longest - other, (longest, other), many)
            left[longest] -= many
            left[other] -= many
        if other == longest and left[longest]:  # an odd one is left over: its partner is the next shorter
            if at == 0:
                groups.add(capacity - longest, (longest,), 1)
            else:
                groups.add(capacity - longest - large[at - 1], (longest, large[at - 1]), 1)
                left[large[at - 1]] -= 1
            left[longest] = 0
        large = [n for n in large if left[n]]
    for small in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        rest = left[small]
        while rest:
            gap, pattern, many = groups.take_smallest(small) or (capacity, (), rest)
            each = min(gap // small, rest)
            full = min(many, rest // each)
            groups.add(gap - each * small, pattern + (small,) * each, full)
            rest -= each * full
            if pattern and many > full:
                groups.add(gap, pattern, many - full)
    return groups.all()


def lookup_table(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows ``(length, first, sequence, per_sequence, many, offset)``: pieces of a length numbered from ``first`` on fill
    ``many`` sequences from ``sequence`` on, ``per_sequence`` in each, side by side from ``offset`` on."""
    rows, used, sequence = [], {}, 0
    for pattern, many in plan:
        offset = 0
        for length in dict.fromkeys(pattern):
            each = pattern.count(length)
            first = used.get(length, 0)
            rows.append((length, first, sequence, each, many, offset))
            used[length] = first + each * many
            offset += each * length
        sequence += many
    return rows


def pack(
    documents: DataFrame,
    tokenizer_file: str,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """Rows ``(key, piece, start, length, ids_crc32, sequence_id, offset)``."""
    cut = written(pieces(documents, tokenizer_file, key, text, capacity, end_id), "pieces")
    parts = max(LEAST_PARTS, cut.count() // PART_ROWS)
    cut = cut.withColumn("part", F.pmod(F.xxhash64("key", "piece", "ids_crc32"), F.lit(parts)))
    per_part = written(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "pieces-per-length")
    counts = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table: dict[int, list] = {}
    for length, *row in lookup_table(plan_sequences(counts, capacity)):
        table.setdefault(length, []).append(row)
    places = cut.sparkSession.sparkContext.broadcast({n: np.array(rows, np.int64).T for n, rows in table.items()})
    before = per_part.select(
        "length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before")
    )
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("key", "piece", "ids_crc32")) - 1
    numbered = (
        cut.withColumn("own", own)
        .join(before, ["length", "part"])
        .select("key", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own")).alias("number"))
    )

    def place(batches):
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            numbers = batch.column("number").to_numpy()
            sequences, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                first, sequence, each, _, offset = places.value[int(length)]
                own = lengths == length
                at = np.searchsorted(first, numbers[own], side="right") - 1
                into = numbers[own] - first[at]
                sequences[own] = sequence[at] + into // each[at]
                offsets[own] = offset[at] + into % each[at] * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in range(5)), pa.array(sequences), pa.array(offsets)],
                [*batch.schema.names[:5], "sequence_id", "offset"],
            )

    kind = cut.schema["key"].dataType.simpleString()
    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return in_python(numbered, place, schema).withColumnRenamed("key", key)
