import hashlib
import random
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from opinionloom.llm import alignment

LEFT, RIGHT = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(LEFT, RIGHT)


def plain_groups(text, aligner):
    """The groups of a whole text, by byte offsets of whole-text encodings."""
    if not text:
        return []
    left = aligner.left.encode(" " + text, add_special_tokens=False).ids
    right = aligner.right.encode(text)
    whole = (" " + text).encode()
    sides = ([aligner.left_bytes[i] for i in left], [aligner.right_bytes[i] for i in right])
    if any(b"".join(s) != whole for s in sides):
        return []
    offsets = [[sum(map(len, s[: i + 1])) for i in range(len(s))] for s in sides]
    groups, a, b = [], 0, 0
    for end in sorted(set(offsets[0]) & set(offsets[1])):
        i, j = offsets[0].index(end) + 1, offsets[1].index(end) + 1
        groups.append((left[a:i], right[b:j]))
        a, b = i, j
    return groups


def plain_result(rows, aligner):
    found = [(key, plain_groups(text, aligner)) for key, text in rows]
    links = [Counter(p for a, b in groups for p in product(a, b)) for _, groups in found]
    counts = Counter(p for own in links for p in own)
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    result = []
    for (key, groups), own in zip(found, links, strict=True):
        listed = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        result.append((
            key, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), own.total(),
            sum(n for (a, b), n in own.items() if counts[a, b] == most[a]), sum(n * counts[p] for p, n in own.items()),
            hashlib.sha256(listed.encode()).hexdigest() if listed else "",
        ))
    return sorted(result, key=repr)


def random_texts(n, seed):
    rng = random.Random(seed)
    signs = ["a", "b", "the", "Straße", "é", "ÿ", "'s", "’", ".", ",", "\n", "\t", " ", " ", "  ", "   ", " ", "　", "日本", "😀", "12", "007"]
    signs += ["<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "▁", "é", "ﬁ", "\x00", "\x7f", "​", "}", "~", "!"]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_tokens_have_the_bytes_of_their_text(aligner):
    assert sorted(alignment.byte_characters().values()) == list(range(256))
    for text in random_texts(300, 5):
        assert b"".join(aligner.left_bytes[i] for i in aligner.left.encode(text, add_special_tokens=False).ids) == text.encode()
    for one in range(0, aligner.n_right, 997):
        expected = sentencepiece.SentencePieceProcessor(model_file=RIGHT).id_to_piece(one).replace("▁", " ").encode()
        assert aligner.right_bytes[one] == expected or aligner.right.is_byte(one)


def test_align_slices_at_common_ends():
    def groups(left, right):
        return [own.tolist() for own in alignment.align(np.array(left, np.int64), np.array(right, np.int64))]

    assert groups([1, 2, 3], [3, 1, 2]) == [[3, 6], [2, 3], [1, 3]]
    assert groups([2, 2], [1, 3]) == [[4], [2], [2]]
    assert groups([], []) == [[], [], []]


@pytest.mark.parametrize("most", [0, 5, 10_000])
def test_large_groups_link_like_small_ones(monkeypatch, most):
    monkeypatch.setattr(alignment, "MOST_LISTED", most)
    left, right = np.array([1, 1, 2, 3, 3, 3]), np.array([7, 8, 7, 9])
    starts, sizes = (np.array([0, 4]), np.array([0, 3])), (np.array([4, 2]), np.array([3, 1]))
    found = Counter()
    for group, a, b, n in zip(*(c.tolist() for c in alignment.linked_pairs(left, right, starts, sizes)), strict=True):
        found[group, a, b] += n
    expected = Counter((0, a, b) for a in [1, 1, 2, 3] for b in [7, 8, 7]) + Counter((1, a, b) for a in [3, 3] for b in [9])
    assert found == expected


def test_chunks_give_the_groups_of_the_whole_text(aligner):
    texts = random_texts(6000, 1) + [None, "", " ", "x" * 3000, "the cat sat on the mat. " * 50, "\n".join(["a b"] * 30)]
    for _ in range(2):  # the second time from memory
        counts, groups, pairs, times = aligner.align_texts(pa.array(texts))
        for text, own, listed, p, t in zip(texts, counts.tolist(), groups, pairs, times, strict=True):
            expected = plain_groups(text, aligner)
            assert listed == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in expected), text
            links = Counter(q for a, b in expected for q in product(a, b))
            assert own == [sum(len(a) for a, _ in expected), sum(len(b) for _, b in expected), len(expected), links.total()]
            assert {divmod(q, aligner.n_right): n for q, n in zip(p.tolist(), t.tolist(), strict=True)} == dict(links)


@pytest.mark.parametrize("hot_pairs", [1, 40, alignment.HOT_PAIRS])
def test_scores_equal_a_plain_version_however_many_pairs_are_hot(spark, aligner, hot_pairs):
    rows = list(enumerate(random_texts(300, 2))) + [(7, "the same"), (7, "the same"), (None, "the  a"), (8, None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = alignment.score_alignment(documents, LEFT, RIGHT, hot_pairs=hot_pairs).collect()
    assert sorted(map(tuple, found), key=repr) == plain_result(rows, aligner)


def test_messy_and_empty_tables(spark, messy, empty, aligner):
    rows = [(r.doc_id, r.text if r.text is None or len(r.text) < 5000 else r.text[:2000]) for r in messy.collect()]
    assert alignment.score_alignment(messy, LEFT, RIGHT).count() == len(rows)
    short = spark.createDataFrame(rows, "doc_id long, text string")
    found = alignment.score_alignment(short, LEFT, RIGHT).collect()
    assert sorted(map(tuple, found), key=repr) == plain_result(rows, aligner)
    assert alignment.score_alignment(empty, LEFT, RIGHT).collect() == []


def test_pairs_come_apart(spark):
    row = spark.createDataFrame([(5 * 32_000 + 31_999,)], "pair long").select(*alignment.pair_ids("pair", RIGHT)).first()
    assert tuple(row) == (5, 31_999)
