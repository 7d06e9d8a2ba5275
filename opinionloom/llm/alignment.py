"""Alignment of two tokenizers: groups of ids that cover the same bytes, and how often ids are linked over a corpus.

Both tokenizers read a text with a blank before it. The byte ends of either side go into a dictionary from end to index; the
ends in both, sorted, slice the two id lists into groups, and every id of a group's left side is linked with every one
of its right side.

Neither tokenizer has a token across a blank that follows a word and stands before a letter, digit or sign, so texts are
cut there and each distinct chunk is tokenized and aligned once for all texts a worker remembers it for. A group never
reaches beyond its chunk.

``link_counts`` counts the documents that hold a pair linked: every task sums what it reads before anything is shuffled.
``link_scores`` brings the counts back to the documents. Pairs of at least a ``HOT_PAIRS``-th part of all (document, pair)
rows are at most ``HOT_PAIRS`` in number, whatever the corpus; they are broadcast and looked up in place. The rows of
the other pairs are joined, and none of these pairs is frequent enough to make a task large.

Defined cases: a null or empty text, and a text whose tokens' bytes on either side are not the text's (a character that a
tokenizer normalises), have no tokens: counts of zero, an empty list of groups, no links. Every row gives one row, repeated
keys and rows included, and counts as a document of its own. An empty table gives empty results.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from functools import cache
from itertools import batched, chain, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from opinionloom.llm.arrow_text import in_python, slices
from opinionloom.llm.word_ids import gather
from opinionloom.session import written

BLANK = "▁"
#: Chunks a worker remembers across slices; it forgets all of them when there are more.
REMEMBERED = 250_000
CHUNKS_PER_TEXT = 256
HOT_PAIRS = 200_000
#: A group of more links counts its ids before they are paired.
MOST_LISTED = 4096
#: Chunks tokenized and aligned at a time.
LEARNED = 1 << 14
SLICE_BYTES = 2 << 20
#: Behind the blank of a cut stands one of these: never white space.
_SAFE = "!-~À-ÿ"
_CUT = re.compile(f"(?<! )(?= [{_SAFE}])")
_UNEVEN = f"(?:^| )(?:[^{_SAFE}]|$)"
_SAFE_START = re.compile(f"[{_SAFE}][^ ]*")


def byte_characters() -> dict[str, int]:
    """The printable character a byte-level vocabulary writes each byte as: its own code point where that is a visible
    Latin-1 character, else the next free one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in shown)
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_level_tokens(tokenizer: Tokenizer) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary."""
    vocabulary, table = tokenizer.get_vocab(), byte_characters()
    tokens = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        tokens[i] = bytes(table[c] for c in token)
    return tokens


def piece_tokens(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """The bytes of every id of a piece vocabulary with byte pieces."""
    pieces = [(i, model.id_to_piece(i)) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in pieces]


def align(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The common ends of two lists of token sizes over the same bytes, and how many tokens of either side they close."""
    indexes = [dict(zip(np.cumsum(sizes).tolist(), range(1, len(sizes) + 1), strict=True)) for sizes in (left, right)]
    common = sorted(indexes[0].keys() & indexes[1].keys())
    counts = (np.fromiter(map(index.__getitem__, common), np.int64, len(common)) for index in indexes)
    return np.array(common, np.int64), *counts


def linked_pairs(left: np.ndarray, right: np.ndarray, starts: tuple, sizes: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links of groups, given where each begins on either side and how many tokens it has there: rows of group, left id,
    right id and times. Large groups list every pair of distinct ids once."""
    links = sizes[0] * sizes[1]
    small = np.flatnonzero(links <= MOST_LISTED)
    many = links[small]
    group = np.repeat(small, many)
    place = np.arange(len(group)) - np.repeat(np.cumsum(many) - many, many)
    across = sizes[1][group]
    found = [(group, left[starts[0][group] + place // across], right[starts[1][group] + place % across], np.ones(len(group), np.int64))]
    for large in np.flatnonzero(links > MOST_LISTED).tolist():
        (a, n), (b, m) = (
            np.unique(ids[start[large] : start[large] + size[large]], return_counts=True)
            for ids, start, size in ((left, starts[0], sizes[0]), (right, starts[1], sizes[1]))
        )
        times = np.outer(n, m).ravel()
        found.append((np.full(len(times), large), np.repeat(a, len(b)), np.tile(b, len(a)), times))
    return tuple(np.concatenate(column) for column in zip(*found, strict=True))


class Aligner:
    """Tokenizes and aligns texts, with the chunks a worker remembers."""

    def __init__(self, left_file: str, right_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        self.left = Tokenizer.from_file(left_file)
        self.left.encode_special_tokens = True
        self.right = sentencepiece.SentencePieceProcessor(model_file=right_file)
        self.left_bytes, self.right_bytes = byte_level_tokens(self.left), piece_tokens(self.right)
        if any(b" " in t.lstrip(b" ") for i, t in enumerate(self.right_bytes) if not self.right.is_byte(i)):
            raise ValueError(f"{right_file} has a piece with a blank behind another character")
        for head, tail in product((" a", " 's", " .", "\n", " 日\t"), (" b", " 's", " .", " 9", " é")):
            whole, *parts = (self.left.encode(t, add_special_tokens=False).ids for t in (head + tail, head, tail))
            if whole != parts[0] + parts[1]:
                raise ValueError(f"{left_file} has tokens across a blank that follows a word")
        self.n_right = len(self.right_bytes)
        self.sizes = [np.fromiter(map(len, tokens), np.int64, len(tokens)) for tokens in (self.left_bytes, self.right_bytes)]
        # every id as it is written within a group and at its end
        self.written = [f"{i}{sign}" for tokens, signs in ((self.left_bytes, ",|"), (self.right_bytes, ",;")) for i in range(len(tokens)) for sign in signs]
        self.written_at = (0, 2 * len(self.left_bytes))
        self.written_sizes = np.fromiter(map(len, self.written), np.int64, len(self.written))
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.texts: list[str] = []
        #: tokens left and right, groups, links, whether the bytes are the chunk's, distinct linked pairs
        self.counts = np.zeros((0, 6), np.int64)
        self.pair_codes: dict[int, int] = {}
        self.pairs, self.times = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _ids(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        left = self.left.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return list(zip((e.ids for e in left), self.right.encode(texts, num_threads=1), strict=True))

    def _covers(self, ids: tuple[list[int], list[int]], text: str) -> bool:
        expected = (" " + text).encode()
        return b"".join(map(self.left_bytes.__getitem__, ids[0])) == expected == b"".join(map(self.right_bytes.__getitem__, ids[1]))

    def _learn(self, chunks: Iterable[str]) -> None:
        """Tokenize and align new chunks, those that are a word alone many at a time."""
        joined, single = [], []
        for chunk in chunks:
            (joined if _SAFE_START.fullmatch(chunk) else single).append(chunk)
        lists = [joined[at : at + CHUNKS_PER_TEXT] for at in range(0, len(joined), CHUNKS_PER_TEXT)]
        good, bad = [], []
        encoded = self._ids([" ".join(own) for own in lists])
        for own, ids in zip(lists, encoded, strict=True):
            if self._covers(ids, " ".join(own)):
                good.append((own, ids))
            else:
                single += own
        for at in range(0, len(single), 1024):
            part = single[at : at + 1024]
            for chunk, ids in zip(part, self._ids(part), strict=True):
                if self._covers(ids, chunk):
                    good.append(([chunk], ids))
                else:
                    bad.append(chunk)
        self._add(good)
        self.codes.update(zip(bad, range(len(self.texts), len(self.texts) + len(bad)), strict=True))
        self.texts += [""] * len(bad)
        self.counts = np.concatenate((self.counts, np.zeros((len(bad), 6), np.int64)))

    def _add(self, encoded: list[tuple[list[str], tuple[list[int], list[int]]]]) -> None:
        """Align the ids of rows of chunks, and hand the groups out to the chunks."""
        if not encoded:
            return
        chunks = [c for own, _ in encoded for c in own]
        ids = [np.fromiter(chain.from_iterable(pair[side] for _, pair in encoded), np.int64) for side in (0, 1)]
        ends, *tos = align(*(sizes[own] for sizes, own in zip(self.sizes, ids, strict=True)))
        froms = [np.concatenate(([0], to[:-1])) for to in tos]
        many = [to - start for to, start in zip(tos, froms, strict=True)]
        chunk_ends = np.cumsum([1 + len(c.encode()) for c in chunks])
        last = np.searchsorted(ends, chunk_ends)
        if not np.array_equal(ends[np.minimum(last, len(ends) - 1)], chunk_ends):
            raise ValueError("a token reaches beyond its chunk")
        group_ends = last + 1
        first = np.concatenate(([0], group_ends[:-1]))
        # ids and signs of all groups in a row: a group's left ids stand behind the right ids of the groups before
        group_of = [np.repeat(np.arange(len(ends)), n) for n in many]
        listed = np.zeros(len(ids[0]) + len(ids[1]), np.int64)
        closing = [np.zeros(len(own), bool) for own in ids]
        for side in (0, 1):
            closing[side][tos[side] - 1] = True
            other = (froms[1], tos[0])[side][group_of[side]]
            listed[np.arange(len(ids[side])) + other] = self.written_at[side] + 2 * ids[side] + closing[side]
        text = "".join(map(self.written.__getitem__, listed.tolist()))
        places = np.cumsum(self.written_sizes[listed])
        text_ends = places[tos[0][last] + tos[1][last] - 1].tolist()
        self.codes.update(zip(chunks, range(len(self.texts), len(self.texts) + len(chunks)), strict=True))
        self.texts += [text[a : b - 1] for a, b in zip([0, *text_ends[:-1]], text_ends, strict=True)]
        # links, and the distinct pairs of each chunk
        group, left, right, times = linked_pairs(*ids, tuple(froms), tuple(many))
        names, local = np.unique(left * self.n_right + right, return_inverse=True)
        own = np.searchsorted(group_ends, group, side="right") * len(names) + local
        order = np.argsort(own)
        own, times = own[order], times[order]
        new = np.flatnonzero(np.diff(own, prepend=-1))
        times = np.add.reduceat(times, new)
        owner, local = np.divmod(own[new], len(names))
        known = self.pair_codes
        named = np.fromiter((known.setdefault(p, len(known)) for p in names.tolist()), np.int32, len(names))
        self.pairs, self.times = np.concatenate((self.pairs, named[local])), np.concatenate((self.times, times))
        links = np.concatenate(([0], np.cumsum(many[0] * many[1])))
        columns = [to[last] - start[first] for to, start in zip(tos, froms, strict=True)]
        columns += [group_ends - first, links[group_ends] - links[first], np.ones(len(chunks), np.int64)]
        columns.append(np.bincount(owner, minlength=len(chunks)))
        self.counts = np.concatenate((self.counts, np.stack(columns, 1)))

    def _chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the chunks of all texts, and where each text begins among them."""
        texts = pc.fill_null(texts, "")
        uneven = pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False)
        words = pc.split_pattern(texts.filter(pa.array(~uneven)), " ")
        coded = words.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        others = {}
        for row in np.flatnonzero(uneven).tolist():
            text = texts[row].as_py()
            others[row] = [c[1:] for c in _CUT.split(" " + text) if c] if text else []
        new = dict.fromkeys(n for n in names if n not in self.codes)
        new.update(dict.fromkeys(c for own in others.values() for c in own if c not in self.codes))
        for part in batched(new, LEARNED):
            self._learn(part)
        of_names = np.fromiter(map(self.codes.__getitem__, names), np.int64, len(names))
        codes = of_names[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = np.zeros(len(texts), np.int64)
        sizes[~uneven] = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        if others:
            parts, at = [], 0
            for row, size in enumerate(sizes.tolist()):
                if row in others:
                    parts.append(np.fromiter(map(self.codes.__getitem__, others[row]), np.int64, len(others[row])))
                else:
                    parts.append(codes[at : at + size])
                    at += size
            codes = np.concatenate(parts)
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        return codes, np.concatenate(([0], np.cumsum(sizes)))

    def align_texts(self, texts: pa.Array) -> tuple[np.ndarray, list[str], list[np.ndarray], list[np.ndarray]]:
        """Of each text: counts (tokens left and right, groups, links), its groups, its linked pairs and how often each is
        linked; a pair is ``left id * size of the right vocabulary + right id``."""
        if len(self.codes) > REMEMBERED:
            self._forget()
        codes, bounds = self._chunks(texts)
        n = len(texts)
        totals = np.concatenate((np.zeros((1, 6), np.int64), np.cumsum(self.counts[codes], 0)))[bounds]
        counts = np.diff(totals, axis=0)
        whole = counts[:, 4] == np.diff(bounds)
        counts[~whole] = 0
        listed = codes.tolist()
        places = bounds.tolist()
        groups = [
            ";".join(map(self.texts.__getitem__, listed[a:b])) if good else ""
            for a, b, good in zip(places[:-1], places[1:], whole.tolist(), strict=True)
        ]
        sizes = self.counts[:, 5]
        firsts = np.cumsum(sizes) - sizes
        rows = np.repeat(np.arange(n), np.diff(bounds))
        kept = whole[rows]
        codes, rows = codes[kept], rows[kept]
        many = sizes[codes]
        found = np.repeat(rows, many) * max(1, len(self.pair_codes)) + gather(self.pairs, firsts[codes], many)
        order = np.argsort(found)
        found, times = found[order], gather(self.times, firsts[codes], many)[order]
        new = np.flatnonzero(np.diff(found, prepend=-1))
        times = np.add.reduceat(times, new) if len(new) else times
        rows, local = np.divmod(found[new], max(1, len(self.pair_codes)))
        pairs = np.fromiter(self.pair_codes, np.int64, len(self.pair_codes))[local]
        ends = np.searchsorted(rows, np.arange(n + 1)).tolist()
        cut = [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return counts[:, :4], groups, [pairs[c] for c in cut], [times[c] for c in cut]


@cache
def _aligner(left_file: str, right_file: str) -> Aligner:
    return Aligner(left_file, right_file)


def align_documents(documents: DataFrame, left_file: str, right_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(row, key, n_a, n_b, n_groups, n_links, groups, pairs, times)``: ``groups`` is ``a1,a2|b1;a3|b2,b3`` with the ids
    in order, ``pairs`` the distinct linked pairs as 64-bit numbers (``pair_ids`` takes them apart) and ``times`` how often
    each is linked; ``row`` numbers the rows."""
    source = documents.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    names = ["n_a", "n_b", "n_groups", "n_links"]

    def run(batches):
        aligner = _aligner(left_file, right_file)
        for batch in slices(batches, "text", SLICE_BYTES):
            counts, groups, pairs, times = aligner.align_texts(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("key"), *(pa.array(np.ascontiguousarray(c)) for c in counts.T)]
                + [pa.array(groups, pa.string()), pa.array([p.tobytes() for p in pairs], pa.binary())]
                + [pa.array([t.astype("<u4").tobytes() for t in times], pa.binary())],
                ["row", "key", *names, "groups", "pairs", "times"],
            )

    schema = f"row long, key {kind}, {', '.join(f'{n} long' for n in names)}, groups string, pairs binary, times binary"
    return in_python(source, run, schema).withColumnRenamed("key", key)


def pair_ids(pair: str, right_file: str) -> list:
    """Columns ``a`` and ``b`` of a pair number."""
    size = sentencepiece.SentencePieceProcessor(model_file=right_file).get_piece_size()
    return [F.floor(F.col(pair) / size).cast("long").alias("a"), F.pmod(F.col(pair), F.lit(size)).cast("long").alias("b")]


def link_counts(aligned: DataFrame, n_right: int) -> DataFrame:
    """Rows ``(pair, n, best)``: how many documents hold a pair linked, and whether that is the most of its left id."""

    def run(batches):
        for batch in batches:
            joined = b"".join(batch.column("pairs").to_pylist())
            pairs, n = np.unique(np.frombuffer(joined, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], ["pair", "n"])

    counted = in_python(aligned.select("pairs"), run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = written(counted.withColumn("a", F.expr(f"pair div {n_right}")), "pair-counts")
    most = counted.groupBy("a").agg(F.max("n").alias("most"))
    return written(counted.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "link-counts")


def link_scores(aligned: DataFrame, counts: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Rows ``(row, n_best, count_sum)``: links whose pair is the most frequent of its left id, and the sum of the links'
    counts."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = total // hot_pairs + 1  # at most hot_pairs pairs are as frequent
    hot = counts.filter(F.col("n") >= least).orderBy("pair").toArrow().combine_chunks()
    columns = [hot.column(c).to_numpy().astype(kind) for c, kind in (("pair", np.int64), ("n", np.int64), ("best", bool))]
    known = aligned.sparkSession.sparkContext.broadcast(columns)

    def lookup(batch):
        """All pairs of a batch, their rows in it and times, whether they are known, and where."""
        pairs = [np.frombuffer(p, np.int64) for p in batch.column("pairs").to_pylist()]
        times = np.frombuffer(b"".join(batch.column("times").to_pylist()), "<u4").astype(np.int64)
        rows = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
        flat = np.concatenate(pairs)
        names = known.value[0]
        at = np.minimum(np.searchsorted(names, flat), max(0, len(names) - 1))
        return flat, rows, times, names[at] == flat if len(names) else np.zeros(len(flat), bool), at

    def score_hot(batches):
        for batch in batches:
            if batch.num_rows:
                _, rows, times, found, at = lookup(batch)
                rows, times, at = rows[found], times[found], at[found]
                n_best, count_sum = np.zeros((2, batch.num_rows), np.int64)
                np.add.at(n_best, rows, times * known.value[2][at])
                np.add.at(count_sum, rows, times * known.value[1][at])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), pa.array(n_best), pa.array(count_sum)], ["row", "n_best", "count_sum"]
                )

    def list_others(batches):
        for batch in batches:
            if batch.num_rows:
                flat, rows, times, found, _ = lookup(batch)
                own = batch.column("row").to_numpy()[rows[~found]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), pa.array(flat[~found]), pa.array(times[~found])], ["row", "pair", "times"]
                )

    source = aligned.select("row", "pairs", "times")
    frequent = in_python(source, score_hot, "row long, n_best long, count_sum long")
    others = (
        in_python(source, list_others, "row long, pair long, times long")
        .join(counts.filter(F.col("n") < least), "pair")
        .groupBy("row")
        .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best_too"), F.sum(F.col("times") * F.col("n")).alias("sum_too"))
    )
    zero = F.lit(0).cast("long")
    return frequent.join(others, "row", "left").select(
        "row",
        (F.col("n_best") + F.coalesce("best_too", zero)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("sum_too", zero)).alias("count_sum"),
    )


def score_alignment(
    documents: DataFrame, left_file: str, right_file: str, key: str = "doc_id", text: str = "text", hot_pairs: int = HOT_PAIRS
) -> DataFrame:
    """Rows ``(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``; the hash is empty without tokens."""
    sha = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    aligned = written(
        align_documents(documents, left_file, right_file, key, text).withColumn("groups_sha256", sha).drop("groups"), "aligned"
    )
    n_right = sentencepiece.SentencePieceProcessor(model_file=right_file).get_piece_size()
    scores = link_scores(aligned, link_counts(aligned, n_right), hot_pairs)
    return aligned.join(scores, "row").select(
        key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
