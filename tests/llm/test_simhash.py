import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from opinionloom.llm import simhash
from opinionloom.llm.components import component_roots


def fingerprint_by_hand(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_hand(prints, bits):
    """The smallest reachable index of each entry, by comparing all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def family(seed, bits):
    """Fingerprints in chains, balls and loose ones, so that grids have crowded and lonely cells."""
    pick = random.Random(seed)
    prints = {0, 1, 2**64 - 1}
    for _ in range(12):
        at = pick.getrandbits(64)
        for _ in range(20):
            prints.add(at)
            for b in pick.sample(range(64), pick.randint(1, bits + 1)):
                at ^= 1 << b
    hub = pick.getrandbits(64)
    prints |= {hub ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)} | {pick.getrandbits(64) for _ in range(100)}
    return sorted(prints)


@pytest.mark.parametrize(("bits", "cell_rows"), [(2, 128), (2, 1), (3, 8), (1, 2)])
def test_links_connect_what_all_pairs_connect(spark, bits, cell_rows):
    prints = family(bits * 10 + cell_rows, bits)
    rows = spark.createDataFrame([(signed(p),) for p in prints], "fingerprint long")
    edges = simhash.links(rows, bits, cell_rows)
    assert edges.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) > bits).count() == 0
    roots = {r.u: r.root for r in component_roots(edges).collect()}
    by_root, by_hand = {}, {}
    for p, g in zip(prints, groups_by_hand(prints, bits), strict=True):
        by_root.setdefault(roots.get(signed(p), signed(p)), set()).add(p)
        by_hand.setdefault(g, set()).add(p)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_hand.values()))


def test_embedding_distance_is_a_lower_bound(spark):
    pick = random.Random(2)
    pairs = [(pick.getrandbits(64), pick.getrandbits(64)) for _ in range(200)]
    pairs += [(a, a ^ (1 << b)) for a, b in [(pick.getrandbits(64), pick.randrange(64)) for _ in range(100)]]
    rows = spark.createDataFrame([(signed(a), signed(b)) for a, b in pairs], "a long, b long")
    far = F.bit_count(simhash.embedding(F.col("a")).bitwiseXOR(simhash.embedding(F.col("b"))))
    segments = lambda n: [(n >> i & 3).bit_count() for i in range(0, 64, 2)]
    for r in rows.withColumn("far", far).collect():
        a, b = r.a % 2**64, r.b % 2**64
        assert r.far == sum(abs(x - y) for x, y in zip(segments(a), segments(b), strict=True)) <= (a ^ b).bit_count()


def test_documents_equal_brute_force(spark, messy, empty):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    near = documents.limit(40).select((F.col("doc_id") + 1000).alias("doc_id"), F.concat("text", F.lit(" tail")).alias("text"))
    documents = documents.union(near).union(messy.select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    prints = [fingerprint_by_hand(t) for _, t in rows]
    groups = groups_by_hand(prints, 2)
    smallest = {}
    for (key, _), g in zip(rows, groups, strict=True):
        smallest[g] = min((k for k in (key, smallest.get(g)) if k is not None), default=None)
    want = sorted(str((k, p, smallest[g])) for (k, _), p, g in zip(rows, prints, groups, strict=True))
    got = simhash.near_duplicates(documents).collect()
    assert sorted(str((r.doc_id, r.fingerprint % 2**64, r.component)) for r in got) == want
    kept = simhash.keep_one(documents).collect()
    assert len(kept) == len(set(groups))
    assert {r.doc_id for r in kept if r.doc_id is not None} == {k for k in smallest.values() if k is not None}
    one = simhash.keep_one(messy)
    assert one.columns == messy.columns and one.count() == len({g for g in groups_by_hand([fingerprint_by_hand(r.text) for r in messy.collect()], 2)})
    assert simhash.near_duplicates(empty).count() == simhash.keep_one(empty).count() == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(500)] + [(7, 7), (3, 2), (2, 3)]
    roots = {r.u: r.root for r in component_roots(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert roots == {i: 0 for i in range(1, 301)} | {1001 + i: 1000 for i in range(500)}
