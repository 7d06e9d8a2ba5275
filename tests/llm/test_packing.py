import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from opinionloom.llm import packing
from opinionloom.llm.queries import TOKENIZERS

FILE = f"{TOKENIZERS}/word_bpe_49k.json"


def one_by_one(counts, capacity):
    """The packing rule, a piece at a time: gaps of all sequences."""
    lengths = sorted((n for n, c in counts.items() for _ in range(c)), reverse=True)
    large, gaps = [n for n in lengths if 3 * n > capacity], []
    while large:
        first = large.pop(0)
        partner = next((i for i, n in enumerate(large) if n <= capacity - first), None)
        gaps.append(capacity - first - (large.pop(partner) if partner is not None else 0))
    for n in (n for n in lengths if 3 * n <= capacity):
        fits = [i for i, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits, key=lambda i: gaps[i])] -= n
        else:
            gaps.append(capacity - n)
    return gaps


@pytest.mark.parametrize("seed", range(30))
def test_plan_on_counts_equals_packing_piece_by_piece(seed):
    pick = random.Random(seed)
    capacity = pick.choice([6, 10, 30, 64])
    counts = Counter(pick.randint(1, capacity) for _ in range(pick.randint(0, 120)))
    plan = packing.plan_sequences(counts, capacity)
    used = Counter()
    for pattern, many in plan:
        assert many > 0 and sum(pattern) <= capacity
        assert sum(3 * n > capacity for n in pattern) <= 2
        for n in pattern:
            used[n] += many
    assert used == counts
    assert sorted(capacity - sum(p) for p, many in plan for _ in range(many)) == sorted(one_by_one(counts, capacity))


def test_sequences_are_gapless_and_ids_are_the_tokenizer_s(spark, messy):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(messy.select("doc_id", "text"))
    tokenizer, want = Tokenizer.from_file(FILE), defaultdict(list)
    for r in documents.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[start : start + 2048], "<u4")
            want[r.doc_id, piece].append((start, len(part), zlib.crc32(part.tobytes())))
    rows = packing.pack(documents, FILE).collect()
    got, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece].append((r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    least = -(-sum(r.length for r in rows) // 2048)
    assert len(sequences) <= 1.03 * least + 1


def test_empty_table(empty):
    assert packing.pack(empty, FILE).count() == 0


def test_words_across_batches_are_forgotten_safely(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "REMEMBERED", 2)
    own, tokenizer = packing.ChunkTokenizer(FILE), Tokenizer.from_file(FILE)
    texts = ["It's A test of  ÉCOLE, <|endoftext|>x 123", "", None, "é ́x\tİ ſ"]
    for _ in range(3):
        assert [list(i) for i in own.ids(pa.array(texts))] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
