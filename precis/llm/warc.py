"""WARC archives of a table of pages: written by Spark tasks, read back record by record.

Every record is one gzip member. A task joins members to chunks of some megabytes, and Spark's own text
sink writes the chunks as they are: its committer gives each file exactly once however often a task is
repeated, on any file system. The separator that this sink puts after a chunk is an empty gzip member,
which decompresses to nothing. The reader goes through a file in order: it decompresses by pieces,
takes as many bytes as each record announces, checks its digests, and holds one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precis.sources.store import fresh_path

DATE = "1970-01-01T00:00:00Z"  # of records whose page has no date of its own; reruns give equal archives
CHUNK = 8 << 20  # bytes of compressed records after which a chunk is ended
CHUNKS_IN_FILE = 8
_PIECE = 1 << 16  # bytes that are decompressed at once
_VERSION = b"WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Fixed value: a gzip member (RFC 1952) without content.
_EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003") + bytes.fromhex("0300") + bytes(8)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(data: bytes) -> bytes:
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _field_text(value: str) -> str:
    """A field value on one line: what is not printable ASCII is percent-encoded."""
    return re.sub(rb"[^\x21-\x7e]", lambda m: b"%%%02X" % m.group()[0], value.encode()).decode()


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record: version, named fields, a blank line, the block and two line ends."""
    lines = [_VERSION, *[f"{name}: {value}".encode() for name, value in fields], f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """The response of a page, or a revisit, whose block has the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    fields = [("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", _id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", _field_text(url)))
    if is_revisit:
        fields += [("WARC-Refers-To", _id(refers_to)), ("WARC-Profile", _PROFILE)]
    fields += [("WARC-Payload-Digest", "sha1:" + sha1_base32(payload)), ("WARC-Block-Digest", "sha1:" + sha1_base32(block)),
               ("Content-Type", "application/http; msgtype=response")]
    return record(fields, block)


def _info() -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    return record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:info:pages>"), ("WARC-Date", DATE),
                   ("Content-Type", "application/warc-fields")], block)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of gzip members from rows ``page_id, url, html, refers_to``."""
    held, size = [], 0

    def ended() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([_member(_info()) + b"".join(held)], pa.binary())], names=["chunk"])

    for batch in batches:
        for i in range(batch.num_rows):
            page_id, url, html, refers_to, is_revisit = (batch.column(j)[i].as_py() for j in range(5))
            held.append(_member(page_record(page_id, url, html, refers_to, is_revisit)))
            size += len(held[-1])
            if size >= CHUNK:
                yield ended()
                held, size = [], 0
    if held:
        yield ended()


def _with_partner(pages: DataFrame, min_bytes: int) -> DataFrame:
    """``page_id, url, html`` (bytes) with ``refers_to``, the page whose response has the payload, and
    ``is_revisit``."""
    keyed = pages.withColumn("digest", F.sha2("html", 256))
    copies = keyed.filter(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("best"), F.count("*").alias("n"))
    # Payloads that occur once need no partner; of a hot payload a task sends one row.
    copies = copies.filter("n > 1").select("digest", "best")
    found = keyed.join(copies, "digest", "left")
    is_revisit = F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    return found.select("page_id", "url", "html", F.when(is_revisit, F.col("best")).alias("refers_to"), is_revisit.alias("is_revisit"))


def write_archives(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0
) -> None:
    """Write every page as a record to archives below ``path``, files ``*.txt`` of gzip members.

    Of pages with equal payloads of at least ``min_bytes``, that with the largest id is a response, the
    others are revisits of it. Rows that repeat that id too are all responses. A null id is
    less than any other; if a payload has null ids only, all are responses. A null payload is an empty one; a null
    URL leaves out its field. Payloads of any length are kept whole; one record must fit into a task.
    No rows give no records. Other columns are not looked at.
    """
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    source = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("html"))
    chunks = _with_partner(source, min_bytes).mapInArrow(_chunks, "chunk binary")
    # Text of Spark may hold any bytes; the sink writes them unchanged.
    writer = chunks.select(F.col("chunk").cast("string").alias("value")).write
    separator = _EMPTY_MEMBER.decode("latin-1")
    writer.options(lineSep=separator, encoding="ISO-8859-1", maxRecordsPerFile=CHUNKS_IN_FILE, compression="none").text(path)


@dataclass
class Record:
    fields: dict[str, str] = field(default_factory=dict)
    block: bytes = b""


class BrokenArchive(ValueError):
    """An archive that ends early, is not framed as announced, or whose digest does not match."""


def _members(content: bytes) -> Iterator[Iterator[bytes]]:
    """The gzip members of a file, each as pieces of its decompressed bytes."""
    view, at = memoryview(content), 0
    while at < len(view):
        inflate = zlib.decompressobj(31)

        def pieces() -> Iterator[bytes]:
            nonlocal at
            while not inflate.eof:
                part = inflate.unconsumed_tail or view[at:at + _PIECE]
                if not len(part):
                    raise BrokenArchive("a member ends early")
                if not inflate.unconsumed_tail:
                    at += len(part)
                try:
                    yield inflate.decompress(part, _PIECE)
                except zlib.error as error:
                    raise BrokenArchive(f"a member cannot be decompressed: {error}") from error
            at -= len(inflate.unused_data)

        yield pieces()


def _record(pieces: Iterator[bytes]) -> Record | None:
    """The record of one member; None of an empty one."""
    head = bytearray()
    while (end := head.find(b"\r\n\r\n")) < 0:
        piece = next(pieces, None)
        if piece is None:
            if head:
                raise BrokenArchive("a record has no end of its fields")
            return None
        head += piece
    lines = bytes(head[:end]).split(b"\r\n")
    if lines[0] != _VERSION:
        raise BrokenArchive(f"not a record: {lines[0][:20]!r}")
    found = Record({name.decode().lower(): value.strip().decode() for name, _, value in (x.partition(b":") for x in lines[1:])})
    length = int(found.fields["content-length"])
    body = bytearray(head[end + 4:])
    for piece in pieces:
        body += piece
        if len(body) > length + 4:
            break
    if len(body) != length + 4 or body[length:] != b"\r\n\r\n":
        raise BrokenArchive(f"{length} bytes announced, {len(body) - 4} found")
    found.block = bytes(body[:length])
    return found


def _checked(found: Record, name: str, data: bytes) -> str:
    """The digest that the record names, which the bytes must have."""
    algorithm, _, digest = found.fields[name].partition(":")
    if algorithm != "sha1" or sha1_base32(data) != digest:
        raise BrokenArchive(f"{name} of {found.fields.get('warc-record-id')} does not match")
    return digest


def read_records(content: bytes) -> Iterator[Record]:
    """The records of an archive in order; block digests are verified."""
    for pieces in _members(content):
        found = _record(pieces)
        for _ in pieces:  # to the end of the member
            pass
        if found is not None:
            if "warc-block-digest" in found.fields:
                _checked(found, "warc-block-digest", found.block)
            yield found


def _page(name: str | None) -> int | None:
    number = (name or "<urn:page:none>").removeprefix("<urn:page:").removesuffix(">")
    return None if number == "none" else int(number)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            for found in read_records(content.as_buffer()):
                kind = found.fields["warc-type"]
                if kind not in ("response", "revisit"):
                    continue
                http, _, payload = found.block.partition(b"\r\n\r\n")
                announced = re.search(rb"\r\nContent-Length: (\d+)", http)
                if kind == "response":
                    digest = _checked(found, "warc-payload-digest", payload)
                    if int(announced[1]) != len(payload):
                        raise BrokenArchive("the HTTP header announces another length")
                else:
                    digest, payload = found.fields["warc-payload-digest"].partition(":")[2], None
                rows.append({
                    "page_id": _page(found.fields["warc-record-id"]), "url": found.fields.get("warc-target-uri"),
                    "payload": payload, "payload_bytes": int(announced[1]), "payload_digest": digest, "record_type": kind,
                    "refers_to": _page(found.fields.get("warc-refers-to"))})
                size += len(found.block)
                if size > CHUNK:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ROW)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ROW)


_ROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                  ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_ROW_DDL = ("page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, "
            "refers_to long")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each response and revisit in the archives below ``path``.

    ``payload`` is null for a revisit; ``payload_bytes`` and ``payload_digest`` (base32 SHA-1) are those of the whole payload.
    ``refers_to`` is the id of the page that a revisit repeats, else null. URLs come percent-encoded. A record that is not framed
    as it says, or whose digest does not match, is an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_read, _ROW_DDL)


def round_trip(pages: DataFrame, **names: str | int) -> DataFrame:
    """Write the pages to archives in the shared folder and read these; see the two functions."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path, **names)
    return read_archives(pages.sparkSession, path)
