"""Token counts by byte-pair merging: a heap of adjacent pairs over a linked list of symbols.

The lowest-rank adjacent pair is popped and merged until no pair is left; the count is the initial symbols less the merges.
No identifiers are made. A character the vocabulary lacks counts as its UTF-8 bytes.

No piece of such a vocabulary has a blank behind another character, so no merge crosses the place where a blank follows a
word. The text is cut there, and each distinct chunk of a batch is merged once.

Defined cases: a null or empty text has no tokens. Every row gives one row, repeated keys included.
"""

from __future__ import annotations

import heapq
import re
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinionloom.llm.arrow_text import in_python, slices

BLANK = "▁"
LIMIT = 4096
SLICE_BYTES = 16 << 20
#: Counts of chunks a worker remembers across batches; it forgets all of them when there are more.
REMEMBERED = 400_000
_CHUNK = re.compile(" +[^ ]*")


@cache
def merge_ranks(model_file: str) -> dict[str, int]:
    """Rank of every mergeable piece, by falling score; single characters are in it as well.

    Refuses vocabularies for which counting by chunks would be wrong.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ranks = {}
    scored = []
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i)
        if model.is_unused(i) or BLANK in piece.lstrip(BLANK):
            raise ValueError(f"piece {piece!r} can't be counted by chunks")
        scored.append((-model.get_score(i), i, piece))
    # pieces of equal score have equal rank: the leftmost of them merges first
    for rank, (score, _, piece) in enumerate(sorted(scored)):
        ranks[piece] = rank if not rank or score != last else ranks[former]
        last, former = score, piece
    return ranks


def count_chunk(chunk: str, ranks: dict[str, int]) -> int:
    """Tokens of one chunk of escaped text."""
    symbols = list(chunk)
    n = len(symbols)
    count = n
    heap = []
    for i in range(n - 1):
        rank = ranks.get(symbols[i] + symbols[i + 1])
        if rank is not None:
            heap.append((rank, i, 2))
    if heap:
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, i, size = heapq.heappop(heap)
            left = symbols[i]
            j = after[i]
            # stale when one side was merged since: a merged symbol leaves an empty place or is longer
            if not left or j >= n or len(left) + len(symbols[j]) != size:
                continue
            merged = left + symbols[j]
            symbols[i], symbols[j] = merged, ""
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = ranks.get(merged + symbols[k])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, len(merged) + len(symbols[k])))
            h = before[i]
            if h >= 0:
                rank = ranks.get(symbols[h] + merged)
                if rank is not None:
                    heapq.heappush(heap, (rank, h, len(symbols[h]) + len(merged)))
    for c in symbols:
        if c and c not in ranks:
            count += len(c.encode()) - 1
    return count


class Counter:
    """Counts the tokens of texts with the chunk counts a worker remembers."""

    def __init__(self, model_file: str):
        self.ranks = merge_ranks(model_file)
        self.known: dict[str, int] = {}

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = " " + text.replace(BLANK, " ")
        chunks = _CHUNK.findall(text) if "  " in text else [" " + c for c in text[1:].split(" ")]
        known, total = self.known, 0
        for chunk in chunks:
            n = known.get(chunk)
            if n is None:
                n = count_chunk(chunk.replace(" ", BLANK), self.ranks)
                if len(chunk) <= 64:
                    known[chunk] = n
            total += n
        if len(known) > REMEMBERED:
            known.clear()
        return total


@cache
def _counter(model_file: str) -> Counter:
    return Counter(model_file)


def count_tokens(
    documents: DataFrame, model_file: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT
) -> DataFrame:
    """Rows ``(key, n_bytes, n_tokens, over_limit)`` for a sentencepiece BPE model with byte fallback."""
    source = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        counter = _counter(model_file)
        for batch in slices(batches, "text", SLICE_BYTES):
            texts = batch.column("text")
            counts = [counter.count(t) if t else 0 for t in texts.to_pylist()]
            sizes = [len(t or b"") for t in texts.cast(pa.binary()).to_pylist()]
            counted = np.array(counts, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(sizes, pa.int64()), pa.array(counted), pa.array(counted > limit)],
                ["key", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = source.schema["key"].dataType.simpleString()
    return in_python(source, run, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)
