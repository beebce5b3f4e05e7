"""Web archives (WARC 1.1) in Zstandard with a dictionary: one frame per record, written and read by Spark.

An archive starts with a skippable frame that holds the dictionary; every record is a frame of its
own behind it. Archives are the files of Spark's text writer, whose line separator is here an empty
skippable frame: so they reach any store that Spark writes to, and a lost task leaves none behind.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlens.llm.common import map_arrow, values, written

#: Fixed values of the formats: magic numbers of Zstandard frames, profile of revisit records.
FRAME_MAGIC = 0xFD2FB528
SKIPPABLE_MAGIC = 0x184D2A50
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_PAGE = "urn:coverlens:page:"
_DATE = "2026-01-01T00:00:00Z"
#: An empty skippable frame, all of it ASCII.
SEPARATOR = struct.pack("<II", SKIPPABLE_MAGIC, 0).decode("ascii")
REVISIT_BYTES = 1000
ARCHIVE_BYTES = 32_000_000
DICTIONARY_BYTES = 32_768
#: A dictionary is trained on so many leading records of its archive, up to so many bytes of each.
DICTIONARY_RECORDS = 400
DICTIONARY_RECORD_BYTES = 8192
#: One group of equal payloads is spread over so many join keys.
SALTS = 16


class CorruptArchive(ValueError):
    """An archive breaks the format."""


def _header_value(text: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def _page(page_id: int | None) -> str:
    return f"<{_PAGE}{'null' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record if `refers_to` is given: it has the HTTP header only."""
    revisit = refers_to is not None
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    head += [f"WARC-Record-ID: {_page(page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_value(url)}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_page(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(records: list[bytes]) -> zstd.ZstdCompressionDict:
    """A dictionary from records; from few or odd ones, which cannot be trained on, their raw text."""
    samples = [r[:DICTIONARY_RECORD_BYTES] for r in records[:DICTIONARY_RECORDS]]
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, samples)
    except zstd.ZstdError:
        raw = b"".join(samples)[:DICTIONARY_BYTES].ljust(8, b"\n")
        return zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)


def dictionary_frame(dictionary: zstd.ZstdCompressionDict) -> bytes:
    packed = zstd.ZstdCompressor().compress(dictionary.as_bytes())
    return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The frames of one archive, the dictionary's first. A mark stands before the rows it speaks of."""
    compressor = spoken_of = newest = None
    for batch in batches:
        columns = [values(batch.column(c)) for c in ("key", "digest", "n", "mark", "newest", "page_id", "url", "payload")]
        records = []
        for key, digest, n, mark, found, page_id, url, payload in zip(*columns, strict=True):
            if mark:
                spoken_of, newest = (key, digest, n), found
                continue
            refers_to = newest if spoken_of == (key, digest, n) and page_id != newest else None
            records.append(record(page_id, url, payload, digest, refers_to))
        frames = []
        if compressor is None and records:
            dictionary = train(records)
            frames.append(dictionary_frame(dictionary))
            compressor = zstd.ZstdCompressor(dict_data=dictionary, write_checksum=True)
        frames += [compressor.compress(r) for r in records]
        yield pa.record_batch([pa.array(frames, pa.binary())], ["frame"])


def write(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Archive pages (page_id, url, html), one record per row, into files below `path`.

    Of rows with equal payloads of at least `revisit_bytes`, those of the largest page_id become
    responses, the others revisit it; null ids among them revisit too, unless all are null. A null
    html is an empty payload, a null url leaves its header out. Other columns are ignored.

    Payloads are shuffled once: what is equal is found on a table without them, and its marks
    are dealt to the archives in the same exchange, in front of their rows. Rows alike in id, url and payload share an archive.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("n", F.length("payload").cast("long"))
    rows = rows.withColumn("key", F.xxhash64("page_id", "url"))
    narrow = written(rows.select("key", "page_id", "digest", "n"), "digests")
    large = narrow.where(F.col("n") >= revisit_bytes)
    # Map-side maxima first: a group of copies of any size is a row per task.
    equal = large.groupBy("digest", "n").agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("copies"))
    equal = equal.where("copies > 1").withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    large = large.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int"))
    # The newest id depends on the payload alone, so one row stands for equal keys, colliding ones too.
    marks = large.join(equal, ["digest", "n", "salt"]).select("key", "digest", "n", "newest").distinct()
    total = narrow.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    rows = rows.withColumn("newest", F.lit(None).cast("long")).withColumn("mark", F.lit(False))
    dealt = rows.unionByName(marks.withColumn("mark", F.lit(True)), allowMissingColumns=True)
    by = ("key", "digest", "n")
    dealt = dealt.repartition(int(total // archive_bytes) + 1, *by).sortWithinPartitions(*by, F.desc("mark"))
    frames = map_arrow(dealt, _archives, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at `at` ends, by its header and its blocks' headers."""
    descriptor = data[at + 4]
    single, checksum = descriptor >> 5 & 1, descriptor >> 2 & 1
    size = (single, 2, 4, 8)[descriptor >> 6] if descriptor >> 6 else single
    at += 5 + (1 - single) + (0, 1, 2, 4)[descriptor & 3] + size
    while True:
        block = int.from_bytes(data[at : at + 3], "little")
        kind, length = block >> 1 & 3, block >> 3
        if kind == 3 or at + 3 > len(data):
            raise CorruptArchive("broken block")
        at += 3 + (1 if kind == 1 else length)
        if block & 1:
            break
    at += 4 * checksum
    if at > len(data):
        raise CorruptArchive("cut frame")
    return at


def _records(content: bytes) -> Iterator[bytes]:
    """The records of an archive, each from one frame."""
    data, at, decompressor, first = memoryview(content), 0, zstd.ZstdDecompressor(), True
    while at < len(data):
        if at + 8 > len(data):
            raise CorruptArchive("cut frame")
        magic, length = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == SKIPPABLE_MAGIC:
            end = at + 8 + length
            if end > len(data):
                raise CorruptArchive("cut frame")
            if magic == DICTIONARY_MAGIC:
                if not first:
                    raise CorruptArchive("the dictionary is not the first frame")
                raw = bytes(data[at + 8 : end])
                if raw[:4] == struct.pack("<I", FRAME_MAGIC):
                    raw = zstd.ZstdDecompressor().decompress(raw)
                decompressor = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(raw))
        elif magic == FRAME_MAGIC:
            end = frame_end(data, at)
            try:
                yield decompressor.decompressobj().decompress(data[at:end])
            except zstd.ZstdError as error:
                raise CorruptArchive(str(error)) from error
        else:
            raise CorruptArchive(f"unknown frame {magic:#x}")
        at, first = end, False


def parse(data: bytes) -> tuple:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise CorruptArchive(f"version {version[:40]!r}")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(": ")
        if not colon:
            raise CorruptArchive(f"header line {line[:80]!r}")
        fields[name.lower()] = value

    def field(name: str, pattern: str) -> str:
        match = re.fullmatch(pattern, fields.get(name, ""))
        if not match:
            raise CorruptArchive(f"{name}: {fields.get(name)!r}")
        return match[1]

    page = rf"<{_PAGE}(null|-?\d+)>"
    number = lambda text: None if text == "null" else int(text)
    kind = field("warc-type", "(response|revisit)")
    length = int(field("content-length", r"(\d+)"))
    if rest[length:] != b"\r\n\r\n":
        raise CorruptArchive(f"content-length {length} of {len(rest)} bytes")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    announced = re.search(rb"(?i)\r\ncontent-length: (\d+)(?:\r\n|$)", http)
    if not announced:
        raise CorruptArchive("no length of the payload")
    digest = field("warc-payload-digest", "sha1:([0-9a-f]{40})")
    refers_to = number(field("warc-refers-to", page)) if kind == "revisit" else None
    if kind == "revisit":
        field("warc-profile", f"({re.escape(REVISIT_PROFILE)})")
        payload = None
    elif len(payload) != int(announced[1]) or hashlib.sha1(payload).hexdigest() != digest:
        raise CorruptArchive("payload and its header differ")
    return (
        number(field("warc-record-id", page)),
        fields.get("warc-target-uri"),
        kind,
        refers_to,
        int(announced[1]),
        digest,
        payload,
    )


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives below `path`, checked; raises CorruptArchive in the task if one is broken.

    (page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload): the payload is
    null for revisits; length and digest are the full payload's for both.
    """
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    n = 7 if with_payload else 6

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))[:n]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names[:n])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in values(batch.column("content")):
                rows, size = [], 0
                for data in _records(content):
                    rows.append(parse(data)[:n])
                    size += len(data)
                    if size > 8_000_000:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
    return map_arrow(files, run, schema + (", payload binary" if with_payload else ""))


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Archive pages below `path`, read the archives back, and return what the records say."""
    write(pages, path)
    found = read(pages.sparkSession, path, with_payload=False)
    return written(found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "records")
