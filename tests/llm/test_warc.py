import hashlib
import zlib
from collections import Counter

from pyspark.sql import functions as F

from opinionloom.llm import warc


def plain_record(key, payload):
    return warc.record_bytes(key, "http://x.org/", payload, hashlib.sha256(payload).hexdigest(), None, False)


def salvaged(data):
    parts = list(warc.salvage(data))
    return [p.payload for p in parts if isinstance(p, warc.Record)], [(p.position, p.size) for p in parts if isinstance(p, warc.Gap)]


PAYLOADS = [b"first", b"WARC/1.1\r\nnot a record\r\n\r\n" * 3, b"", bytes(range(256)) * 50, b"last"]


def test_whole_archives_have_no_gaps():
    for pack in (lambda r: r, warc.member):
        assert salvaged(b"".join(pack(plain_record(i, p)) for i, p in enumerate(PAYLOADS))) == (PAYLOADS, [])
    mixed = plain_record(0, b"a") + warc.member(plain_record(1, b"b") + plain_record(2, b"c")) + warc.EMPTY_MEMBER + plain_record(3, b"d")
    assert salvaged(mixed) == ([b"a", b"b", b"c", b"d"], [])
    assert salvaged(b"") == ([], [])


def test_every_single_damaged_byte_costs_one_record_at_most():
    for pack in (lambda r: r, warc.member):
        records = [pack(plain_record(i, p)) for i, p in enumerate((b"first", b"second one", b"third"))]
        data = b"".join(records)
        begin, end = len(records[0]), len(records[0]) + len(records[1])
        for at in range(begin, end):
            damaged = data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :]
            payloads, gaps = salvaged(damaged)
            assert payloads[0] == b"first" and payloads[-1] == b"third" and len(payloads) in (2, 3)
            if len(payloads) == 2:
                assert gaps == [(begin, end - begin)]


def test_one_bad_record_in_a_member_of_many():
    records = [plain_record(i, b"page %d" % i) for i in range(5)]
    records[2] = records[2].replace(b"page 2", b"page X")
    packed = warc.member(b"".join(records))
    begin = len(records[0]) + len(records[1])
    parts = list(warc.salvage(packed + warc.member(plain_record(5, b"after"))))
    assert [p.payload for p in parts if isinstance(p, warc.Record)] == [b"page 0", b"page 1", b"page 3", b"page 4", b"after"]
    gaps = [p for p in parts if isinstance(p, warc.Gap)]
    assert [(g.position, g.size) for g in gaps] == [(0, len(packed))]
    assert gaps[0].reason == f"block digest differs, bytes {begin} to {begin + len(records[2])} of the member's content"


def test_records_before_a_break_in_a_member_of_many():
    noise = [b"".join(hashlib.sha256(b"%d %d" % (i, k)).digest() for k in range(200)) for i in range(20)]
    packed, after = warc.member(b"".join(plain_record(i, p) for i, p in enumerate(noise))), warc.member(plain_record(99, b"after"))
    at = len(packed) // 2
    found, gaps = salvaged(packed[:at])
    assert found == noise[: len(found)] and 8 <= len(found) <= 10 and gaps == [(0, at)]
    found, gaps = salvaged(packed[:at] + bytes(2000) + packed[at + 2000 :] + after)
    assert found[-1] == b"after" and noise[:8] == found[:8] and gaps == [(0, len(packed))]


def test_cut_off_and_foreign_bytes_are_logged():
    first, second = warc.member(plain_record(1, b"one")), plain_record(2, b"two")
    junk = b"junk \x1f\x8b\x08 WARC/1.1\r\n more"
    assert salvaged(junk + first + junk + second + first[:-5]) == (
        [b"one", b"two"],
        [(0, len(junk)), (len(junk) + len(first), len(junk)), (2 * len(junk) + len(first) + len(second), len(first) - 5)],
    )
    assert salvaged(b"no archive at all") == ([], [(0, 17)])


def test_members_end_in_a_zero_byte():
    big = warc.member(b"x" * (17 << 20))
    assert big[-1] == 0 and zlib.decompressobj(31).decompress(big) == b"x" * (17 << 20)


def test_round_trip(spark, tmp_path):
    same = "é" * 50
    rows = [(5, "http://a/ b\n", same), (3, None, same), (9, "u", same), (3, "v", same), (None, "w", same), (1, "u", "short"), (2, "u", "short"),
            (7, "u", None), (8, "u", ""), (None, None, None), (10, "u", "\x00\r\n\r\nWARC/1.1\r\n" + "z" * 100_000), (11, "u", "n" * 120), (None, "u", "n" * 120)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, first int")
    warc.write_archives(pages, str(tmp_path / "a"), archive_bytes=700)
    out = warc.read_archives(spark, str(tmp_path / "a"))
    assert out.filter("gap is not null").count() == 0
    got = Counter((r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in out.collect())
    want = Counter()
    for key, _, html in rows:
        body = (html or "").encode()
        first = {same: "3", "n" * 120: "11"}.get(html)
        revisit = first is not None and first != (None if key is None else str(key))
        want[None if key is None else str(key), "revisit" if revisit else "response", first if revisit else None, len(body), hashlib.sha256(body).hexdigest()] += 1
    assert got == want
    bodies = {bytes(r.payload) for r in out.filter("record_type = 'response'").collect()}
    assert bodies == {(r[2] or "").encode() for r in rows}
    archives = out.groupBy("archive").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    assert len(archives) > 2 and all(a.size <= 700 + 30 * a.n or a.n == 1 for a in archives)


def test_damaged_archive_through_spark(spark, tmp_path):
    records = [warc.member(plain_record(i, b"page %d" % i)) for i in range(5)]
    damaged = bytearray(b"".join(records))
    damaged[len(records[0]) + 30] ^= 0xFF
    (tmp_path / "one.warc.gz").write_bytes(bytes(damaged))
    out = warc.read_archives(spark, str(tmp_path))
    assert {r.record_id for r in out.filter("gap is null").collect()} == {"0", "2", "3", "4"}
    gap = out.filter(F.col("gap").isNotNull()).first()
    assert (gap.position, gap.size, gap.gap) == (len(records[0]), len(records[1]), "member damaged")


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0
