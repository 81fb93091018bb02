"""WARC archives: exact round trip, revisits, the framing itself, and broken files."""

import base64
import gzip
import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from precis.llm import warc

SCHEMA = "page_id long, url string, html string"
ODD = [
    (1, "http://a/", "same"), (2, "http://b/", "same"), (7, None, "same"), (7, "http://b/ü x\r\ny", "same"), (3, "", None),
    (4, "x", ""), (5, "http://c/", "WARC/1.1\r\n\r\n\r\nContent-Length: 3\r\n\r\n"), (None, "n", "same"), (None, "n", "alone"),
    (None, "n", "alone"), (-6, "m", "é\u0000\n" * 1000), (8, "l", "long " * 3_000_000), (-2**63, "z", "least"),
]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(rows, min_bytes=0):
    best = {}
    for page_id, _, html in rows:
        if page_id is not None:
            best[html or ""] = max(page_id, best.get(html or "", page_id))
    made = Counter()
    for page_id, _, html in rows:
        html = html or ""
        size, top = len(html.encode()), best.get(html)
        other = size >= min_bytes and top is not None and page_id != top
        made[page_id, size, digest(html), "revisit" if other else "response", top if other else None] += 1
    return made


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_round_trip(spark, min_bytes):
    pages = spark.createDataFrame(ODD, SCHEMA).repartition(3).withColumns({n: F.lit("x") for n in ("digest", "best", "refers_to", "n")})
    got = warc.round_trip(pages, min_bytes=min_bytes).collect()
    assert Counter(tuple(r[c] for c in COLUMNS) for r in got) == brute(ODD, min_bytes)
    texts = {r["page_id"]: bytes(r["payload"]).decode() for r in got if r["payload"] is not None and r["page_id"] is not None}
    assert texts[8] == "long " * 3_000_000 and texts[-6] == "é\u0000\n" * 1000 and texts[5] == ODD[6][2]
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in got)
    assert {r["url"] for r in got if r["page_id"] == 7} == {None, "http://b/%C3%BC%20x%0D%0Ay"}


def test_no_rows(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_files_are_gzip_members_of_one_record(spark, tmp_path):
    path = str(tmp_path / "archives")
    warc.write_archives(spark.createDataFrame(ODD, SCHEMA).coalesce(2), path)
    records = 0
    for file in (tmp_path / "archives").glob("part-*"):
        content = file.read_bytes()
        assert gzip.decompress(content).count(b"WARC-Record-ID") >= 2  # also a plain reader of gzip takes the whole file
        while content:
            inflate = zlib.decompressobj(31)
            text = inflate.decompress(content) + inflate.flush()
            content = inflate.unused_data
            if text:
                head, _, rest = text.partition(b"\r\n\r\n")
                fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
                assert head.startswith(b"WARC/1.1\r\n") and len(rest) == int(fields[b"Content-Length"]) + 4
                records += fields[b"WARC-Type"] != b"warcinfo"
    assert records == len(ODD)


def test_broken_archives_are_errors():
    whole = warc.page_record(1, "u", b"payload", None, False)
    good = warc._member(whole) * 3
    assert [r.block[-7:] for r in warc.read_records(good)] == [b"payload"] * 3
    for bad in (good[:-4], warc._member(whole.replace(b"payload", b"pbyload")), warc._member(whole[:-1]), warc._member(whole + b"x"),
                warc._member(b"HTTP"), b"no gzip at all", good + b"\n"):
        with pytest.raises(warc.BrokenArchive):
            list(warc.read_records(bad))


def test_pieces_smaller_than_a_record(monkeypatch):
    monkeypatch.setattr(warc, "_PIECE", 7)
    blocks = [bytes([i]) * 100 for i in range(5)]
    content = b"".join(warc._member(warc.page_record(i, None, b, None, False)) + warc._EMPTY_MEMBER for i, b in enumerate(blocks))
    assert [r.block[-100:] for r in warc.read_records(content)] == blocks
