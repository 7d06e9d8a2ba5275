import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from opinionloom.llm import token_files
from opinionloom.llm.word_ids import WordIds

FILE = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 700), st.sampled_from([0, 1, 200, 49_407, 2**32 - 1]), st.integers(0, 2**32 - 1), st.sampled_from([1, 50, 90, 100]))
def test_segments_round_trip(n, most, seed, percentile):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, most, n, endpoint=True).astype(np.uint32)
    ids[rng.random(n) < 0.05] = 2**32 - 1  # outliers
    data = token_files.encode_segment(ids, percentile)
    assert token_files.read_range(data).tolist() == ids.tolist()
    start, stop = sorted(rng.integers(0, n + 1, 2).tolist())
    assert token_files.read_range(data, start, stop).tolist() == ids[start:stop].tolist()


def test_outliers_are_exceptions_and_do_not_widen_a_block():
    ids = np.full(token_files.BLOCK, 1000, np.uint32)
    ids[::2] += 3
    narrow = len(token_files.encode_segment(ids))
    ids[5] = 4_000_000_000
    data = token_files.encode_segment(ids)
    assert np.frombuffer(data, "<u4", 4).tolist() == [token_files.MAGIC, 128, 1, 1]
    assert len(data) == narrow + 4 + 4  # the value, and its padded place
    assert token_files.read_range(data).tolist() == ids.tolist()


def test_only_the_blocks_of_a_range_are_read():
    ids = np.arange(10_000, dtype=np.uint32)
    data = bytearray(token_files.encode_segment(ids))
    data[-2000:] = bytes(2000)  # the last blocks are gone
    assert token_files.read_range(bytes(data), 0, 1000).tolist() == list(range(1000))
    with pytest.raises(ValueError):
        token_files.read_range(b"else" + bytes(data[4:]))


def test_word_ids_equal_the_library():
    rng = random.Random(3)
    signs = "ab Éß'’.,;:!? \n\t 　 日é😀012<|endoftext|>_-/ "
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["<|endoftext|>", "don't we'll", "x" * 5000, "straße ÀÉ, ab.cd", None]
    own = WordIds(FILE)
    tokenizer = Tokenizer.from_file(FILE)
    for _ in range(2):  # the second time from memory
        found = [ids.tolist() for ids in own.ids(pa.array(texts))]
        assert found == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def plain(rows):
    tokenizer = Tokenizer.from_file(FILE)
    return [(key, [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]) for key, text in rows]


def test_files_hold_the_stream_in_key_order(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["one", "two", "Third", "x9"]) for _ in range(rng.randrange(60)))) for k in range(400)]
    rows[7], rows[8] = (7, None), (8, "")
    shuffled = rng.sample(rows, len(rows))
    token_files.write_token_files(
        spark.createDataFrame(shuffled, "doc_id long, text string"), str(tmp_path), FILE, segment_ids=500, part_bytes=1000
    )
    stream, expected = [], {}
    for key, ids in plain(rows):
        expected[key] = (len(stream), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        stream += ids
    digests = token_files.read_digests(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in digests} == expected
    assert {r.doc_id: r.ids for r in token_files.read_ids(spark, str(tmp_path)).collect()} == dict(plain(rows))
    found = sorted(token_files.read_stream(spark, str(tmp_path), 1234, 5678).collect())
    assert [i for r in found for i in r.ids] == stream[1234:5678] and found[0].first_id == 1234
    assert spark.read.parquet(f"{tmp_path}/segments").count() > 20
    assert max(r.n_ids for r in spark.read.parquet(f"{tmp_path}/segments").collect()) < 500 + 61


def test_messy_and_empty_tables(spark, messy, empty, tmp_path):
    token_files.write_token_files(messy, str(tmp_path / "messy"), FILE)
    found = token_files.read_ids(spark, str(tmp_path / "messy")).orderBy("start").collect()
    keys = [r.doc_id for r in found]
    assert keys == [None, None, 1, 1, 1, *range(2, 11)]
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()
    everything = sorted((r.doc_id or 0, r.ids) for r in found)
    assert everything == sorted((k or 0, ids) for k, ids in plain([(r.doc_id, r.text) for r in messy.collect()]))
    token_files.write_token_files(empty, str(tmp_path / "empty"), FILE)
    assert token_files.read_digests(spark, str(tmp_path / "empty")).collect() == []


def test_repeated_rows_are_spread(spark, tmp_path):
    rows = spark.range(3000).selectExpr("5L as doc_id", "'the same text' as text")
    token_files.write_token_files(rows, str(tmp_path), FILE)
    sizes = [r[1] for r in spark.read.parquet(f"{tmp_path}/segments").groupBy("part").sum("n_ids").collect()]
    assert len(sizes) >= 6 and max(sizes) < 3000
    found = token_files.read_digests(spark, str(tmp_path)).select("start").collect()
    assert sorted(r.start for r in found) == [4 * i for i in range(3000)]
