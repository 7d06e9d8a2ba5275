import random
import re
import zlib
from collections import Counter

import numpy as np

from opinionloom.llm import spelling


def plain_words(rows):
    total = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 7:
                total[word] += 1
    return {w: n for w, n in total.items() if n >= 2}


def edits(word, alphabet):
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    near = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in alphabet}
    return (near | {a + c + b[1:] for a, b in cuts if b for c in alphabet}) - {word}


def plain_variants(counts):
    alphabet = sorted({c for w in counts for c in w})
    near = {w: edits(w, alphabet) & counts.keys() for w in counts}
    form = {}
    for word, n in counts.items():
        best = min(near[word], key=lambda w: (-counts[w], w), default=None)
        form[word] = best if best is not None and counts[best] >= 10 * n else None
    rows = []
    for word, n in counts.items():
        root = word
        while form[root] is not None:
            root = form[root]
        rows.append((word, form[word], root, n, len(near[word]), form[word] and counts[form[word]]))
    return sorted(rows)


def similar_words(n, seed):
    rng = random.Random(seed)
    words = set()
    while len(words) < n:
        word = "".join(rng.choice(["ab", "ti", "on", "é", "s"]) for _ in range(rng.randrange(3, 7)))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(word) + 1)
            word = word[:at] + rng.choice(["", "a", "x", "ÿ"]) + word[at + rng.randrange(2) :]
        words.add(word)
    return sorted(words)


def test_near_words_share_a_signature_on_some_choice_of_parts():
    rng = random.Random(0)
    for word in similar_words(150, 1):
        if len(word) < 2:
            continue
        for other in rng.sample(sorted(edits(word, "abxé")), 8):
            for parts in ((4, 2), (3, 3), (6, 4)):
                same, shorter, longer = (s.tolist() for s in spelling.signatures([word, other], parts))
                if len(word) == len(other):
                    assert set(same[0]) & set(same[1])
                else:
                    short, long = (0, 1) if len(word) < len(other) else (1, 0)
                    assert set(shorter[short]) & set(longer[long])


def test_number_of_signatures_and_batches_do_not_matter():
    words = similar_words(50, 3)
    for together, part in zip(spelling.signatures(words), spelling.signatures(words[20:30]), strict=True):
        assert np.array_equal(together[20:30], part)
    assert [s.shape[1] for s in spelling.signatures(words)] == [12, 4, 4]


def test_near_words_equal_all_pairs(spark):
    words = similar_words(700, 2)
    table = spark.createDataFrame([(w,) for w in words] + [(words[0],), (None,), ("",)], "word string")
    found = sorted(map(tuple, spelling.near_words(table).collect()))
    expected = sorted((w, v) for w in words for v in edits(w, "abtionséxÿ") & set(words))
    assert len(expected) > 300 and found == expected


def test_variants_equal_a_plain_version(spark):
    rng = random.Random(4)
    stems = [w for w in similar_words(300, 5) if len(w) >= 7]
    weights = [1 / (i + 1) ** 1.3 for i in range(len(stems))]
    rows = [(k, " ".join(rng.choices(stems, weights, k=60)) + ". Größere ÉTOILES×") for k in range(400)]
    rows += [(5, None), (6, ""), (None, "nothing nothing"), (9, rows[9][1])]
    found = spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    expected = plain_variants(plain_words(rows))
    assert sorted(map(tuple, found)) == expected
    assert sum(r[1] is not None for r in expected) > 50


def test_forms_are_followed_to_the_last(spark):
    names = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb", "aabbbbb"]
    table = spark.createDataFrame([(w, 10**i) for i, w in enumerate(names)] + [("aaaaaaz", 1)], "word string, n long")
    found = {r.word: (r.form, r.root, r.form_n) for r in spelling.variant_groups(table).collect()}
    assert found["aaaaaaa"] == ("aaaaaab", names[-1], 10) and found[names[-1]] == (None, names[-1], None)
    assert found["aaaaaaz"] == ("aaaaaab", names[-1], 10)


def test_messy_and_empty_tables(spark, messy, empty):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    assert sorted(map(tuple, spelling.spelling_variants(messy).collect())) == plain_variants(plain_words(rows))
    assert spelling.spelling_variants(empty).collect() == []
