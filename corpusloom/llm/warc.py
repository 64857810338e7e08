"""WARC archives of Zstandard records under one dictionary: written a chunk a task, deduplicated, and read back."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import Table, ship

# The first skippable frame's magic number, which marks a dictionary, and the dictionary's own.
SKIPPABLE, DICTIONARY = 0x184D2A5D, 0xEC30A437
#: An archive is closed at this many uncompressed bytes; its dictionary is built from at most the bytes below it.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 16 << 20, 4 << 20, 64 << 10


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def escaped(url: str | None) -> str:
    """A URL without line breaks; a name of none."""
    return (url or "urn:page:none").replace("\r", "%0D").replace("\n", "%0A")


def record_id(page_id: int | None, url: str | None) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {escaped(url)}')}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: tuple[int, str | None] | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with none of the page (id, URL) it refers to."""
    body = b"" if refers_to is not None else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id(page_id, url)}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {escaped(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: text/html; charset=utf-8",
        *([f"X-Page-ID: {page_id}"] if page_id is not None else []),
        f"X-Payload-Bytes: {len(payload)}",
    ]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{record_id(*refers_to)}>",
            f"WARC-Refers-To-Target-URI: {escaped(refers_to[1])}",
            "WARC-Refers-To-Date: 1970-01-01T00:00:00Z",
            f"X-Refers-To-Page-ID: {refers_to[0]}",
        ]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> bytes:
    """A Zstandard dictionary of records from across the archive; none where they are too few to build one."""
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    sample = records[::step]
    if len(sample) < 8:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r[: 128 << 10] for r in sample]).as_bytes()
    except zstandard.ZstdError:  # records too small or too alike for any dictionary
        return b""


def write_archive(records: list[bytes]) -> bytes:
    """Records as a .warc.zst: the dictionary, itself compressed, in a leading skippable frame; then a frame a record."""
    raw = build_dictionary(records)
    out = []
    if raw:
        packed = zstandard.ZstdCompressor(level=19).compress(raw)
        out.append(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
    engine = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None, write_checksum=True)
    out += [engine.compress(r) for r in records]
    return b"".join(out)


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, body) of each record of a .warc.zst."""
    at, words = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", data, 4)[0]
        raw = data[8 : 8 + size]
        if struct.unpack_from("<I", raw)[0] != DICTIONARY:
            raw = zstandard.ZstdDecompressor().decompress(raw)
        words, at = zstandard.ZstdCompressionDict(raw), 8 + size
    engine = zstandard.ZstdDecompressor(dict_data=words)
    view = memoryview(data)
    while at < len(data):
        one = engine.decompressobj()
        parts = []
        # Fed in pieces, so that what follows the frame is not copied record by record.
        while not one.eof:
            piece = view[at : at + 65_536]
            if not len(piece):
                raise ValueError("a record is cut short")
            parts.append(one.decompress(piece))
            at += len(piece) - len(one.unused_data)
        whole = b"".join(parts)
        head, _, rest = whole.partition(b"\r\n\r\n")
        first, *fields = head.decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        headers = dict(f.split(": ", 1) for f in fields)
        yield headers, rest[: int(headers["Content-Length"])]


def archives(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0
) -> DataFrame:
    """(archive_id, content): the pages as .warc.zst files, one row a file of about ARCHIVE_BYTES uncompressed.

    Payloads are UTF-8; null counts as empty. Of records with equal payloads of at least least_bytes, that of the
    smallest id is a response and the others revisit it; smaller ones are responses. Rows of null id are responses,
    and none revisits them. A repeated row of the smallest id is a response each time.
    """
    ship(pages.sparkSession)
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("html"))
    keyed = rows.withColumn("sha", F.sha1(F.encode("html", "utf-8")))
    first = Table(
        keyed.filter((F.octet_length("html") >= least_bytes) & F.col("page_id").isNotNull())
        .groupBy("sha")
        .agg(F.min(F.struct("page_id", "url")).alias("first"), F.max("page_id").alias("last"))
        .filter("first.page_id < last")
        .select("sha", "first")
    )
    decided = keyed.join(first.df, "sha", "left").select("page_id", "url", "html", F.when(F.col("page_id") > F.col("first.page_id"), F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task's number and a count within it: no two archives of one write share a name, whatever ids they hold.
        task, n = TaskContext.get().partitionId(), 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{n:06d}"]), pa.array([write_archive(held)], pa.binary())], ["archive_id", "content"])

        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    raw = html.encode()
                    one = record(page_id, url, raw, payload_digest(raw), refers_to and (refers_to["page_id"], refers_to["url"]))
                    held.append(one)
                    size += len(one)
                    if size >= ARCHIVE_BYTES:
                        yield archive()
                        held, size, n = [], 0, n + 1
        if held:
            yield archive()

    return decided.mapInArrow(write, "archive_id string, content binary")


def read_records(files: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of the records of archives."""
    ship(files.sparkSession)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for head, body in read_archive(content.as_py()):
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = head["WARC-Type"]
                    if kind == "response" and (payload_digest(body) != digest or len(body) != int(head["X-Payload-Bytes"])):
                        raise ValueError(f"the payload of page {head.get('X-Page-ID')} does not have its digest")
                    rows.append((number(head.get("X-Page-ID")), int(head["X-Payload-Bytes"]), digest, kind, number(head.get("X-Refers-To-Page-ID")), head["WARC-Target-URI"], body if kind == "response" else None))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return files.select("content").mapInArrow(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    )


def round_trip(pages: DataFrame, **how) -> DataFrame:
    """Write the pages' archives to the shared folder and read their records back."""
    return read_records(Table(archives(pages, **how)).df)


def save_files(files: DataFrame, folder: str) -> int:
    """Write archives as <folder>/<archive_id>.warc.zst through Spark's file system, one at a time; how many."""
    jvm, conf = files.sparkSession.sparkContext._jvm, files.sparkSession.sparkContext._jsc.hadoopConfiguration()
    n = 0
    for row in files.toLocalIterator():
        at = jvm.org.apache.hadoop.fs.Path(folder, f"{row.archive_id}.warc.zst")
        out = at.getFileSystem(conf).create(at, True)
        out.write(bytearray(row.content))
        out.close()
        n += 1
    return n
