"""WARC archives with dictionary-compressed records.

Pages with equal payloads are found by their SHA-256: the page with the smallest id becomes a response, the others
revisit it. Pages whose digest certainly does not repeat (a Bloom filter of bounded size tells) are archived where they
are read; only the others shuffle. Each task builds a Zstandard dictionary from the first records it archives, and
compresses every record in a frame of its own. A row is a block of such frames, and so many rows make an archive; the
first of them begins with the dictionary in a skippable frame. Spark's text writer puts them into files with an empty
skippable frame as the separator; so the files are plain sequences of Zstandard frames, each readable by itself and of
bounded size, and Spark's commit protocol keeps lost or repeated tasks from leaving partial archives, on any store that
Spark can write.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.exact_dedup import filter_bits, repeat_filter, with_may_repeat
from millrace.runtime import cut, ensure_checkpoint_dir

MIN_REVISIT_BYTES = 100
DICTIONARY_BYTES = 1 << 16
SAMPLE_BYTES = 1 << 21  # of a partition's first records, from which its dictionary is built
BLOCK_BYTES = 1 << 21  # a block is closed once its frames reach this
ARCHIVE_BLOCKS = 64  # blocks an archive: 128 MB, but for records beyond a block's size
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"  # WARC-Date, where the caller has none: archives of equal pages are equal

# Fixed values of the formats.
_SKIPPABLE = 0x184D2A50
_DICTIONARY_FRAME = 0x184D2A5D
SEPARATOR = struct.pack("<II", _SKIPPABLE, 0).decode("ascii")  # an empty skippable frame
_SEPARATOR = SEPARATOR.encode("ascii")
_FRAME = b"\x28\xb5\x2f\xfd"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uri(url: str | None, page_id) -> str:
    """The URL without characters that would break a header line; a page without one gets a URN."""
    return quote(url, safe="".join(map(chr, range(33, 127)))) if url else f"urn:page:{page_id}"


def _record(page_id, url, payload: bytes, size: int, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    """A WARC/1.1 record with an HTTP response block; the block of a revisit has the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    block = http.encode() + payload
    identity = hashlib.sha256(f"{page_id}\0{url}\0{digest}".encode()).digest()[:16]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.UUID(bytes=identity, version=4)}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_uri(url, page_id)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {_REVISIT_PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained on the samples; where they are too few to train on, their end serves as raw content."""
    size = min(DICTIONARY_BYTES, max(256, sum(map(len, samples)) // 8))
    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(size, samples, k=512, d=8, steps=1).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-size:] or b"\0"


def _archive(date: str, block_bytes: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[bytes] | None = []
        held, compressor, leading = 0, None, b""
        block: list[bytes] = []
        size = written = 0

        def begin() -> None:
            nonlocal compressor, leading, waiting
            content = _dictionary(waiting)
            compressor = zstandard.ZstdCompressor(
                level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content), write_checksum=True
            )
            packed = zstandard.ZstdCompressor(level=19).compress(content)
            leading = struct.pack("<II", _DICTIONARY_FRAME, len(packed)) + packed
            waiting = None

        def close() -> pa.RecordBatch:
            nonlocal block, size, written
            frames = block if written % blocks else [leading, *block]  # each archive has the dictionary
            written, block, size = written + 1, [], 0
            return pa.record_batch({"frame": pa.array([_SEPARATOR.join(frames)], pa.binary())})

        def add(records: list[bytes]) -> Iterator[pa.RecordBatch]:
            nonlocal size
            for record in records:
                block.append(compressor.compress(record))
                size += len(block[-1])
                if size >= block_bytes:
                    yield close()

        for batch in batches:
            records = []
            for page_id, url, html, length, digest, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode()
                records.append(_record(page_id, url, payload, length, digest, refers_to, revisit, date))
            if waiting is not None:
                waiting += records
                held += sum(map(len, records))
                if held < SAMPLE_BYTES:
                    continue
                records = waiting
                begin()
            yield from add(records)
        if waiting:
            records = waiting
            begin()
            yield from add(records)
        if not (block or written or TaskContext.get().partitionId()):
            waiting = []
            begin()  # Spark writes a first file in any case
            yield close()
        elif block:
            yield close()

    return run


def write_archives(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    date: str = DATE,
    block_bytes: int = BLOCK_BYTES,
    blocks: int = ARCHIVE_BLOCKS,
) -> None:
    """Write a record for each page to archives in the folder ``path``, each of ``blocks`` blocks at most.

    A null html counts as empty, a null url becomes a URN; null ids sort last. Payloads below ``MIN_REVISIT_BYTES`` are
    all responses. Rows that repeat the smallest id of their payload are responses like it. An empty table writes
    one archive without records. Other columns are ignored, whatever their names.
    """
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")
    ).withColumn("digest", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256))
    keys = cut(rows.where(F.octet_length("html") >= MIN_REVISIT_BYTES).select("page_id", "digest"))
    bits = filter_bits(keys.count())
    bitmaps = cut(repeat_filter(keys, "digest", bits))
    firsts = (
        with_may_repeat(keys, "digest", bitmaps, bits, "may_repeat")
        .where("may_repeat")
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
        .where("copies > 1")
        .drop("copies")
    )
    firsts = cut(firsts)  # so that the next join has exchanges of its own, of which Spark splits a hot payload's
    tested = with_may_repeat(rows, "digest", bitmaps, bits, "may_repeat")
    single = tested.where(~F.col("may_repeat")).withColumn("first", F.lit(None).cast(firsts.schema["first"].dataType))
    repeated = tested.where("may_repeat").join(firsts, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    (
        single.unionByName(repeated)
        .select(
            "page_id",
            "url",
            F.when(~revisit, F.col("html")).alias("html"),  # a revisit travels without its payload
            F.coalesce(F.octet_length("html"), F.lit(0)).alias("size"),
            "digest",
            F.col("first").cast("string").alias("refers_to"),
            revisit.alias("revisit"),
        )
        .mapInArrow(_archive(date, block_bytes, blocks), "frame binary")
        .select(F.col("frame").cast("string").alias("value"))
        .write.option("lineSep", SEPARATOR)
        .option("maxRecordsPerFile", blocks)
        .text(path)
    )


def _frames(data: bytes) -> Iterator[bytes]:
    """Uncompressed contents of the archive's record frames, in order."""
    dictionary, at, view = None, 0, memoryview(data)
    decompressor = zstandard.ZstdDecompressor()
    while at < len(data):
        (magic,) = struct.unpack_from("<I", data, at)
        if magic & 0xFFFFFFF0 == _SKIPPABLE:
            (size,) = struct.unpack_from("<I", data, at + 4)
            content = view[at + 8 : at + 8 + size]
            if magic == _DICTIONARY_FRAME:
                raw = zstandard.ZstdDecompressor().decompress(bytes(content)) if bytes(content[:4]) == _FRAME else bytes(content)
                dictionary = zstandard.ZstdCompressionDict(raw)
                decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
            at += 8 + size
            continue
        end = data.find(_SEPARATOR, at)
        while True:  # the separator's bytes may also stand within a frame
            try:
                yield decompressor.decompress(view[at:end])
                break
            except zstandard.ZstdError:
                end = data.find(_SEPARATOR, end + 1)
                if end < 0:
                    raise
        at = end


def parse_record(record: bytes) -> dict:
    """Headers (lower-case names, with ``warc-type`` and so on), HTTP headers and payload of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sent = {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}
    return {"version": lines[0], "headers": headers, "http": sent, "payload": payload}


_READ = (
    "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, "
    "html string, archive string"
)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the archives in ``path``.

    A response's digest and size are those of the payload read back, checked against its headers; a revisit has no
    payload and those of its headers. ``payloads=False`` leaves ``html`` null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for record in _frames(content.as_py()):
                    row = _row(parse_record(record), payloads)
                    rows.append({**row, "archive": archive})
                    held += len(record)
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, _READ_SCHEMA)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _READ_SCHEMA)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, _READ)


_READ_SCHEMA = pa.schema(
    [
        (name, {"long": pa.int64(), "string": pa.string()}[kind])
        for name, kind in (x.split() for x in _READ.split(", "))
    ]
)


def _row(record: dict, payloads: bool) -> dict:
    headers, payload = record["headers"], record["payload"]
    digest = headers["warc-payload-digest"].removeprefix("sha256:")
    size = int(record["http"]["content-length"])
    revisit = headers["warc-type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {headers['warc-record-id']} differs from its digest")
    return {
        "page_id": headers["x-page-id"] or None,
        "url": headers["warc-target-uri"],
        "record_type": headers["warc-type"],
        "refers_to": headers.get("x-refers-to-page-id"),
        "payload_bytes": size,
        "payload_digest": digest,
        "html": payload.decode() if payloads and not revisit else None,
    }


def archive_round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from new archives.

    The archives go to a new folder beside the session's checkpoints and stay there with them.
    """
    spark = pages.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(pages, path, page_id, url, html)
    kind = pages.schema[page_id].dataType
    read = read_archives(spark, path, payloads=False)
    return read.select(
        F.col("page_id").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
