"""Web archives: round trips, the frames themselves, and broken archives."""

import hashlib
import struct

import pytest
import zstandard as zstd

from coverlens.llm import warc
from coverlens.llm.queries import ORACLES, QUERIES
from tests.comparing import differences, duck

SCHEMA = "page_id long, url string, html string, digest string, n int, salt int"


def pages(spark):
    big = "<p>été\r\n\r\n</p>" * 200
    rows = [(i, f"http://x/{i}", f"<html>{i}</html>" * (1 + i % 40), "d", 1, 2) for i in range(300)]
    rows += [(1000 + i, "http://y/\r\nWARC-Type: evil\x00é", big, None, None, None) for i in range(50)]
    rows += [(2000, None, None, "d", 1, 2), (2001, "u", "", "d", 1, 2), (2002, "u", "", "d", 1, 2)]
    rows += [(3000, "u", "z" * 1000, "d", 1, 2), (3001, "u", "z" * 1000, "d", 1, 2), (3001, "u", "z" * 1000, "d", 1, 2)]
    rows += [(3002, "u", "z" * 999, "d", 1, 2), (3003, "u", "z" * 999, "d", 1, 2), (None, "u", "z" * 1000, "d", 1, 2)]
    rows += [(4000, "u", "y" * 3_000_000, "d", 1, 2)]
    return rows


def test_round_trip(spark, tmp_path):
    rows = pages(spark)
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    path = str(tmp_path / "archives")
    warc.write(table, path, archive_bytes=100_000)
    found = warc.read(spark, path).collect()
    newest = {}
    for page_id, _, html, *_ in rows:
        if page_id is not None:
            newest[html or ""] = max(newest.get(html or "", page_id), page_id)
    expected = []
    for page_id, url, html, *_ in rows:
        raw = (html or "").encode()
        revisit = len(raw) >= 1000 and page_id != newest[html]
        expected.append((page_id, "revisit" if revisit else "response", newest[html] if revisit else None, len(raw),
                         hashlib.sha1(raw).hexdigest(), None if revisit else raw))
    got = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload and bytes(r.payload) or (None if r.payload is None else b"")) for r in found]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert {r.url for r in found if r.page_id == 1000} == {"http://y/%0D%0AWARC-Type: evil%00é"}
    files = list((tmp_path / "archives").glob("part-*"))
    assert len(files) > 2
    for file in files:
        data = file.read_bytes()
        assert struct.unpack("<I", data[:4])[0] == warc.DICTIONARY_MAGIC
        # Other decoders see the same: frames one behind another, the dictionary in the first.
        size = struct.unpack("<I", data[4:8])[0]
        words = zstd.ZstdCompressionDict(zstd.ZstdDecompressor().decompress(data[8 : 8 + size]))
        reader = zstd.ZstdDecompressor(dict_data=words).stream_reader(data[8 + size :], read_across_frames=True)
        assert reader.read() == b"".join(warc._records(data))


def test_no_pages(spark, tmp_path):
    warc.write(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).collect() == []


def archive(records, words=None):
    words = words or warc.train([b"".join(records) + b"........"])
    pack = zstd.ZstdCompressor(dict_data=words, write_checksum=True)
    return warc.dictionary_frame(words) + b"".join(pack.compress(r) for r in records)


GOOD = warc.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None)


def test_broken_archives_are_refused():
    data = archive([GOOD, GOOD])
    assert len(list(warc._records(data))) == 2
    flipped = bytearray(data)
    flipped[-10] ^= 1
    for bad in (data[:-3], data + b"xxxxxxxxx", bytes(flipped), data + warc.dictionary_frame(warc.train([b"12345678"]))):
        with pytest.raises(warc.CorruptArchive):
            list(warc._records(bad))


@pytest.mark.parametrize(
    ("old", "new"),
    [(b"WARC/1.1", b"WARC/9.9"), (b"payload", b"PAYLOAD"), (b"Content-Length: 7", b"Content-Length: 8"), (b"WARC-Type: response", b"WARC-Type: other"),
     (b"\r\n\r\n", b"\r\n"), (b"sha1:", b"sha9:"), (b"WARC-Date: ", b"WARC-Date ")],
)
def test_broken_records_are_refused(old, new):
    assert warc.parse(GOOD)[0] == 1
    with pytest.raises(warc.CorruptArchive):
        warc.parse(GOOD.replace(old, new))


def test_query_equals_statement(spark, sf_dir):
    assert differences(QUERIES["op9_warc"](spark, sf_dir), duck(sf_dir), ORACLES["op9_warc"]) == []
