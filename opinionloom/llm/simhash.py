"""SimHash near-duplicates: fingerprints over word shingles, linked within a few differing bits.

Fingerprints are embedded as the bit counts of their 2-bit segments. The Manhattan distance of two embeddings is a lower
bound of the number of differing bits. The embeddings are filed in a grid: of ``max_bits + 2`` blocks of segments, two
fingerprints in range agree on at least two, so each block pair is one grid, and its cells hold all partners. Within a
cell pairs in range by the bound are verified on the fingerprints.

Cells above ``CELL_ROWS`` members are not paired. Their fingerprints meet at the points one bit away from them instead:
for ``max_bits`` of 2 two fingerprints are in range exactly when they share such a point or each other, and a point has at
most 65 neighbours. So no group is unbounded and no pair in range is lost.

Defined cases: a null or wordless text has fingerprint zero, linked like any other. Rows repeat as given. A row with a
null key takes part in the links and gets the component of its group, but is never its smallest key; a group of null keys
only has a null component.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from opinionloom.functions.binding import column
from opinionloom.llm.arrow_text import in_python, slices, utf8
from opinionloom.llm.components import component_roots
from opinionloom.session import written

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
CELL_ROWS = 128
SEGMENTS = 32
EVEN_BITS = 0x5555555555555555


def shingle_hashes(text: bytes, width: int = SHINGLE_WORDS, seed: int = SEED) -> list[int]:
    """XXH64 of every run of ``width`` words, A-Z lower-cased; of all words when there are fewer."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashed = xxhash.xxh64_intdigest
    return [hashed(joined[a:b], seed) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist())]


def fingerprint_of(hashes: list[int], block: int = 1 << 15) -> int:
    """A bit is set if it is set in over half of the hashes; as a signed 64-bit integer."""
    values = np.array(hashes, np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(values), block):
        part = values[at : at + block]
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(values), bitorder="little").view(np.int64)[0])


def fingerprints(documents: DataFrame, key: str, text: str, width: int = SHINGLE_WORDS) -> DataFrame:
    """Rows ``(key, text_key, fingerprint)``; ``text_key`` is a hash of the text, the fingerprint a signed long."""
    source = documents.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))

    def run(batches):
        for batch in slices(batches, "text"):
            prints = [fingerprint_of(shingle_hashes(t, width)) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("text_key"), pa.array(prints, pa.int64())], ["key", "text_key", "fingerprint"]
            )

    kind = source.schema["key"].dataType.simpleString()
    return in_python(source, run, f"key {kind}, text_key long, fingerprint long")


def embedding(fingerprint: Column) -> Column:
    """The bit counts of the 32 two-bit segments, each as 0, 1 or 2 leading bits of its segment: the Manhattan distance of
    two embeddings is the number of bits in which these longs differ."""
    half = F.shiftrightunsigned(fingerprint, 1)
    some = fingerprint.bitwiseOR(half).bitwiseAND(F.lit(EVEN_BITS))
    both = fingerprint.bitwiseAND(half).bitwiseAND(F.lit(EVEN_BITS))
    return some.bitwiseOR(F.shiftleft(both, 1))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks(blocks: int) -> list[int]:
    edges = [2 * (SEGMENTS * i // blocks) for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def _differ(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(distinct: DataFrame, max_bits: int = MAX_BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links ``(u, v)`` between the distinct fingerprints of a table that connect all that differ in at most ``max_bits``."""
    grids = F.array(
        *(
            F.struct(F.lit(i).alias("grid"), embedding(F.col("fingerprint")).bitwiseAND(F.lit(_signed(a | b))).alias("cell"))
            for i, (a, b) in enumerate(combinations(block_masks(max_bits + 2), 2))
        )
    )
    filed = distinct.select("fingerprint", F.inline(grids))
    sizes = written(filed.groupBy("grid", "cell").agg(F.count("*").alias("n")).filter("n > 1"), "cells")
    within = F.flatten(
        F.transform(
            "members",
            lambda x: F.transform(
                F.filter(
                    "members",
                    lambda y: (x < y) & (_differ(embedding(x), embedding(y)) <= max_bits) & (_differ(x, y) <= max_bits),
                ),
                lambda y: F.struct(x.alias("u"), y.alias("v")),
            ),
        )
    )
    paired = (
        filed.join(sizes.filter(F.col("n") <= cell_rows), ["grid", "cell"], "left_semi")
        .groupBy("grid", "cell")
        .agg(F.collect_list("fingerprint").alias("members"))
        .select(F.inline(within))
    )
    crowded = filed.join(sizes.filter(F.col("n") > cell_rows), ["grid", "cell"], "left_semi").select("fingerprint").distinct()
    return paired.union(links_by_points(crowded, max_bits)).distinct()


def links_by_points(distinct: DataFrame, max_bits: int) -> DataFrame:
    """The same links by shared points: every fingerprint and all that differ from it in half of ``max_bits``.

    An odd bound takes one more bit on the one side, so the pairs are verified.
    """
    reach = (max_bits + 1) // 2
    flips = [0, *(_signed(sum(1 << b for b in bits)) for n in range(1, reach + 1) for bits in combinations(range(64), n))]
    points = distinct.select(
        "fingerprint", F.explode(F.array(*(F.col("fingerprint").bitwiseXOR(F.lit(f).cast("long")) for f in flips))).alias("point")
    )
    balls = points.groupBy("point").agg(F.collect_list("fingerprint").alias("members")).filter(F.size("members") > 1)
    if max_bits % 2:
        pairs = F.flatten(
            F.transform(
                "members",
                lambda x: F.transform(
                    F.filter("members", lambda y: (x < y) & (_differ(x, y) <= max_bits)),
                    lambda y: F.struct(x.alias("u"), y.alias("v")),
                ),
            )
        )
        return balls.select(F.inline(pairs))
    return balls.select(F.array_min("members").alias("u"), F.explode("members").alias("v")).filter("u != v")


def near_duplicates(
    documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """Rows ``(key, text_key, fingerprint, component, root)`` per document, the fingerprint a signed long; ``component`` is
    the smallest key reachable over links, ``root`` the smallest fingerprint."""
    prints = written(fingerprints(documents, key, text, width), "fingerprints")
    distinct = written(prints.groupBy("fingerprint").agg(F.min("key").alias("smallest")), "distinct-fingerprints")
    roots = component_roots(links(distinct.select("fingerprint"), max_bits))
    rooted = distinct.join(roots, distinct["fingerprint"] == roots["u"], "left").select(
        "fingerprint", "smallest", F.coalesce("root", "fingerprint").alias("root")
    )
    named = rooted.join(rooted.groupBy("root").agg(F.min("smallest").alias("component")), "root")
    return prints.join(named.select("fingerprint", "component", "root"), "fingerprint").select(
        F.col("key").alias(key), "text_key", "fingerprint", "component", "root"
    )


def keep_one(
    documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """The documents without near-duplicates: of each component one row stays, that of the smallest key.

    Of rows with equal (or only null) keys in a component the one with the smallest text hash stays; rows of equal key and
    text are copies, of which the smallest by the other columns stays.
    """
    found = near_duplicates(documents, key, text, width, max_bits)
    members = written(
        found.groupBy("root", F.col(key).alias("k"), F.col("text_key").alias("t")).agg(F.count("*").alias("n")), "near-duplicates"
    )
    first = F.min(F.struct(F.col("k").isNull().alias("empty"), F.col("k"), F.col("t"), F.col("n")))
    firsts = members.groupBy("root").agg(first.alias("first"), F.count("*").alias("size")).filter("size > 1 or first.n > 1")
    firsts = written(firsts, "keepers")
    repeated = firsts.filter("first.n > 1").select("first.k", "first.t")
    others = members.join(firsts.filter("size > 1"), "root").filter(
        ~(F.col("k").eqNullSafe(F.col("first.k")) & (F.col("t") == F.col("first.t")))
    )
    # the rows to go are far fewer than those to stay
    gone = written(others.select("k", "t").union(repeated), "near-duplicates-to-go")

    def matched(some: DataFrame, how: str) -> DataFrame:
        same = documents[key].eqNullSafe(some["k"]) & (F.xxhash64(documents[text]) == some["t"])
        return documents.join(some, same, how)

    kept = matched(gone, "left_anti")
    if repeated.isEmpty():
        return kept
    fields = {f.name: documents[column(f.name)] for f in documents.schema.fields}
    order = [c for name, c in fields.items() if not isinstance(documents.schema[name].dataType, MapType)]
    once = (
        matched(repeated, "left_semi")
        .groupBy(documents[key].alias("k"), F.xxhash64(documents[text]).alias("t"))
        .agg(F.min_by(F.struct(*fields.values()), F.struct(*order)).alias("row"))
        .select("row.*")
    )
    return kept.unionByName(once)
