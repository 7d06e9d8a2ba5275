"""Token-id files: the ids of all documents as one stream in key order, in patched frame-of-reference blocks.

A *segment* holds the ids of some whole documents, in blocks of ``BLOCK`` ids. Of each block the minimum is subtracted;
the rests are packed at the width that holds ``PERCENTILE`` percent of the block's values, and the values that are wider
are outliers, kept whole in an exception list. Little-endian, one array after the other:

====================  ==============================================================================================
``magic, n, b, e``    4 x u32: ``PFR1``, ids, blocks, exceptions
``block_starts``      b x u32: the first word of each block among the packed words
``exception_starts``  b x u32: the first exception of each block
``minima``            b x u32
``exceptions``        e x u32: values less the minimum
``places``            e x u8: place in the block, padded with zeros to full words
``widths``            b x u8: bits of a packed value, padded with zeros to full words
``packed``            4 x width words a block: value ``i`` lies in lane ``i % 4``, a lane is a run of bits from bit 0 on
====================  ==============================================================================================

So any range of ids is read from its blocks alone (``read_range``). The last block of a segment is filled up with its own
first id.

``write_token_files`` makes a folder of two Parquet tables. ``segments`` has a row per segment: part, number in the part,
place of its first id in the part, keys and lengths of its documents, and the bytes. ``parts`` has the place of each part
in the whole stream. Parts are ranges of the key, so both tables together say where a document starts. Spark's commit
protocol writes them, and tasks that are lost are run again.

Defined cases: a null text is empty, its ids are the end id alone. Null keys come first. Rows of equal keys are documents
of their own, in the order of their text's hash; rows that repeat key and text are interchangeable, and are spread over parts
like others. An empty table gives tables without rows. Other columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinionloom.llm.arrow_text import in_python, slices
from opinionloom.llm.word_ids import word_ids

BLOCK = 128
LANES = 4
PERCENTILE = 90
END_ID = 1
MAGIC = int.from_bytes(b"PFR1", "little")
#: A segment is closed at so many ids; a longer document has one of its own.
SEGMENT_IDS = 1 << 18
#: Bytes of text a part is meant to hold.
PART_BYTES = 32 << 20
SLICE_BYTES = 4 << 20


def _bits(values: np.ndarray) -> np.ndarray:
    """How many bits each value takes; zero takes none."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.uint8)


def _padded(values: np.ndarray) -> bytes:
    return values.astype("u1").tobytes() + bytes(-len(values) % 4)


def _pack(blocks: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``BLOCK`` values below ``2 ** width`` as rows of ``LANES * width`` words."""
    per_lane = BLOCK // LANES
    values = np.ascontiguousarray(blocks.reshape(-1, per_lane, LANES).transpose(1, 0, 2))
    words = np.zeros((width, len(blocks), LANES), np.uint32)
    for i in range(per_lane):
        word, shift = divmod(i * width, 32)
        words[word] |= values[i] << np.uint32(shift)
        if shift + width > 32:
            words[word + 1] |= values[i] >> np.uint32(32 - shift)
    return words.transpose(1, 0, 2).reshape(len(blocks), -1)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    per_lane = BLOCK // LANES
    words = np.ascontiguousarray(packed.reshape(-1, width, LANES).transpose(1, 0, 2))
    values = np.empty((per_lane, len(packed), LANES), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for i in range(per_lane):
        word, shift = divmod(i * width, 32)
        values[i] = words[word] >> np.uint32(shift)
        if shift + width > 32:
            values[i] |= words[word + 1] << np.uint32(32 - shift)
    values &= mask
    return values.transpose(1, 0, 2).reshape(len(packed), BLOCK)


def encode_segment(ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """The bytes of a segment of unsigned 32-bit ids."""
    n = len(ids)
    if not n:
        return np.array([MAGIC, 0, 0, 0], "<u4").tobytes()
    blocks = np.full(-(-n // BLOCK) * BLOCK, ids[(n - 1) // BLOCK * BLOCK], np.uint32)
    blocks[:n] = ids
    blocks = blocks.reshape(-1, BLOCK)
    minima = blocks.min(1)
    rests = blocks - minima[:, None]
    rank = -(-BLOCK * percentile // 100) - 1
    widths = _bits(np.partition(rests, rank, axis=1)[:, rank])
    outlier = rests >= (np.uint64(1) << widths.astype(np.uint64))[:, None]
    rows, places = np.nonzero(outlier)
    exceptions = rests[outlier]
    counts = np.bincount(rows, minlength=len(blocks))
    sizes = LANES * widths.astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    packed = np.zeros(int(sizes.sum()), np.uint32)
    for width in np.unique(widths[widths > 0]).tolist():
        own = np.flatnonzero(widths == width)
        low = rests[own] & np.uint32((1 << width) - 1)
        packed[starts[own][:, None] + np.arange(LANES * width)] = _pack(low, width)
    head = np.array([MAGIC, n, len(blocks), len(exceptions)], "<u4")
    arrays = (head, starts, np.cumsum(counts) - counts, minima, exceptions)
    return b"".join([*(a.astype("<u4").tobytes() for a in arrays), _padded(places), _padded(widths), packed.astype("<u4").tobytes()])


def read_range(data: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids ``start:stop`` of a segment; only the blocks that hold them are unpacked."""
    magic, n, b, e = np.frombuffer(data, "<u4", 4).tolist()
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, np.uint32)
    block_starts = np.frombuffer(data, "<u4", b, 16).astype(np.int64)
    exception_starts = np.frombuffer(data, "<u4", b, 16 + 4 * b).astype(np.int64)
    at = 16 + 12 * b
    places = np.frombuffer(data, "u1", e, at + 4 * e)
    exceptions = np.frombuffer(data, "<u4", e, at)
    at += 4 * e + e + -e % 4
    first, last = start // BLOCK, -(-stop // BLOCK)
    widths = np.frombuffer(data, "u1", b, at)[first:last]
    packed = np.frombuffer(data, "<u4", -1, at + b + -b % 4)
    values = np.zeros((last - first, BLOCK), np.uint32)
    for width in np.unique(widths[widths > 0]).tolist():
        own = np.flatnonzero(widths == width)
        values[own] = _unpack(packed[block_starts[first + own][:, None] + np.arange(LANES * width)], width)
    bounds = np.append(exception_starts, e)[first : last + 1]
    own = slice(int(bounds[0]), int(bounds[-1]))
    values[np.repeat(np.arange(last - first), np.diff(bounds)), places[own]] = exceptions[own]
    values += np.frombuffer(data, "<u4", b, 16 + 8 * b)[first:last][:, None]
    return values.ravel()[start - first * BLOCK : stop - first * BLOCK]


def write_token_files(
    documents: DataFrame,
    path: str,
    tokenizer_file: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
    segment_ids: int = SEGMENT_IDS,
    part_bytes: int = PART_BYTES,
) -> None:
    """Tokenize every document, close it with ``end_id``, and write the stream of ids in ascending key order.

    Texts, not ids, are dealt out by ranges of the key: they are smaller, and are tokenized once, where they are written.
    The bounds need no tokens either.
    """
    source = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    size = source.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))).first()[0] or 0
    parts = max(source.sparkSession.sparkContext.defaultParallelism, -(-size // part_bytes))
    order = ["key", "hash", "row"]
    dealt = (
        source.withColumn("hash", F.xxhash64("text"))
        .withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .select(F.spark_partition_id().alias("part"), "key", "text")
    )
    end = np.array([end_id], np.uint32)
    kind = source.schema["key"].dataType.simpleString()
    fields = ["part", "segment", "start", "n_ids", "keys", "lengths", "bytes"]

    def run(batches):
        tokenizer = word_ids(tokenizer_file)
        part, segment, start = 0, 0, 0
        keys, lengths, ids, waiting = [], [], [], 0

        def closed():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([start]), pa.array([waiting])]
                + [pa.array([keys], pa.list_(key_type)), pa.array([lengths], pa.list_(pa.int64()))]
                + [pa.array([encode_segment(np.concatenate(ids))], pa.binary())],
                fields,
            )

        for batch in slices(batches, "text", SLICE_BYTES):
            part, key_type = batch.column("part")[0].as_py(), batch.column("key").type
            for name, own in zip(batch.column("key").to_pylist(), tokenizer.ids(batch.column("text")), strict=True):
                keys.append(name)
                lengths.append(len(own) + 1)
                ids += (own, end)
                waiting += len(own) + 1
                if waiting >= segment_ids:
                    yield closed()
                    segment, start = segment + 1, start + waiting
                    keys, lengths, ids, waiting = [], [], [], 0
        if keys:
            yield closed()
        pa.default_memory_pool().release_unused()

    schema = f"part int, segment int, start long, n_ids long, keys array<{kind}>, lengths array<long>, bytes binary"
    in_python(dealt, run, schema).write.parquet(f"{path}/segments")
    spark = source.sparkSession
    sizes = spark.read.parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    # one row a part
    before = F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids")
    sizes.select("part", before.alias("part_start"), "n_ids").coalesce(1).write.parquet(f"{path}/parts")


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``first_id``, the place of their first id in the whole stream."""
    parts = spark.read.parquet(f"{path}/parts").select("part", "part_start")
    return spark.read.parquet(f"{path}/segments").join(parts, "part").withColumn("first_id", F.col("part_start") + F.col("start"))


def _documents_in(found: DataFrame, key: str, value: str, kind: str, make) -> DataFrame:
    source = found.select("first_id", "keys", "lengths", "bytes")
    schema = f"key {source.schema['keys'].dataType.elementType.simpleString()}, start long, n_tokens long, {value} {kind}"

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                lengths = batch.column("lengths")[row].values.to_numpy()
                ids = read_range(batch.column("bytes")[row].as_py()).astype("<u4", copy=False)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                values = [make(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("keys")[row].values, pa.array(starts + batch.column("first_id")[row].as_py())]
                    + [pa.array(lengths), pa.array(values, pa.int64() if kind == "long" else pa.list_(pa.int64()))],
                    ["key", "start", "n_tokens", value],
                )

    return in_python(source, run, schema).withColumnRenamed("key", key)


def read_digests(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Rows ``(key, start, n_tokens, ids_crc32)`` of every document, from the files alone."""
    return _documents_in(segments(spark, path), key, "ids_crc32", "long", lambda ids: zlib.crc32(ids.tobytes()))


def read_ids(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Rows ``(key, start, n_tokens, ids)`` of every document."""
    return _documents_in(segments(spark, path), key, "ids", "array<long>", lambda ids: ids.astype(np.int64))


def read_stream(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """Rows ``(first_id, ids)``: the ids at places ``start`` up to ``stop`` of the stream, a row per segment that has some.

    Segments outside are skipped by their places, blocks outside by the block starts.
    """
    last = F.col("first_id") + F.col("n_ids")
    found = segments(spark, path).filter((F.col("first_id") < stop) & (last > start)).select("first_id", "n_ids", "bytes")

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)
            taken = [(max(start, first), read_range(data, max(0, start - first), min(n, stop - first))) for first, n, data in rows]
            firsts, ids = ([t[0] for t in taken], [t[1].astype(np.int64) for t in taken])
            yield pa.RecordBatch.from_arrays([pa.array(firsts, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], ["first_id", "ids"])

    return in_python(found, run, "first_id long, ids array<long>")
