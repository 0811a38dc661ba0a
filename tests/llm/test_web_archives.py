import base64
import hashlib
import io
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkstrata.llm import web_archives as wa

SCHEMA = "page_id long, url string, html string"


def plain_rows(rows: list[tuple], least: int = 0) -> list[tuple]:
    """(page_id, bytes, digest, type, refers_to) by the contract; of repeated rows the first is the response."""
    out, seen = [], {}
    for page_id, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        first = seen.setdefault(data, page_id) if len(data) >= least else None
        revisit = len(data) >= least and (data, "seen") in seen
        seen[data, "seen"] = True
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(map(repr, out))


def pages() -> list[tuple]:
    r = random.Random(6)
    bodies = [None, "", "<p>é中😀", "a\r\n\r\nb", "WARC/1.1\r\n", "PK\x05\x06", "x" * 300_000, "\x00\x01", "{json}"]
    rows = [(k, r.choice(["http://a/{b}", "http://a/ b\r\nx: y", None, "", f"http://h/{k}"]), r.choice(bodies) if r.random() < 0.6 else f"own {k}") for k in range(400, 100, -1)]
    return rows + [(7, "u", "copy"), (7, "u", "copy"), (7, "u", "copy"), (None, None, None), (None, None, None), (None, "u", "only nulls"), (None, "u", "copy"), (8, "hot", "hot")] + [(1000 + k, "hot", "hot") for k in range(300)]


@pytest.mark.parametrize("least", [0, 5])
def test_archives_against_brute_force(spark, monkeypatch, tmp_path, least):
    monkeypatch.setattr(wa, "PACKAGE_BYTES", 3000)
    monkeypatch.setattr(wa, "BLOCK_BYTES", 2000)
    rows = pages()
    clash = {"sha": F.lit("x"), "first": F.lit(1), "type": F.lit("x"), "n": F.lit(0), "later": F.lit(None), "a.b": F.lit(1)}
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns(clash)
    out = wa.archive_pages(df, f"file://{tmp_path}", least)
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(repr(tuple(r)) for r in out.collect()) == plain_rows(rows, least)
    found = wa.packages_in(spark, str(tmp_path))
    assert found.count() == len(list(tmp_path.glob("*.wacz"))) > 4
    payloads = {(r.page_id, r.payload.decode()) for r in wa.read_records(found).where("type = 'response'").collect()}
    assert {(p, t) for p, t in payloads if p is not None} <= {(p, t or "") for p, _, t in rows}
    for name in os.listdir(tmp_path):
        if name.endswith(".wacz"):
            with zipfile.ZipFile(tmp_path / name) as z:  # another reader finds it sound
                assert z.testzip() is None and {m.filename: m.compress_type for m in z.infolist()} == {wa.ARCHIVE: 0, wa.INDEX: 0}


def test_archives_of_nothing(spark):
    assert wa.archive_pages(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("limit", [None, 100, 0])
@pytest.mark.parametrize("ahead", [b"", b"bytes before the package"])
def test_directories_with_wide_fields(monkeypatch, limit, ahead):
    if limit is not None:  # sizes, places and counts over these are written as ZIP64
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    f = io.BytesIO()
    bodies = {f"archive/é{k}.warc": bytes([k]) * n for k, n in enumerate((0, 5, 90, 250))} | {"indexes/packed.cdx": b"line\n" * 50}
    with zipfile.ZipFile(f, "w") as z:
        z.comment = b"a comment with PK\x05\x06 in it"
        for name, body in bodies.items():
            info = zipfile.ZipInfo(name)
            info.extra = b"\x55\x54\x05\x00\x01abcd"
            z.writestr(info, body, zipfile.ZIP_DEFLATED if "indexes" in name else zipfile.ZIP_STORED)
        written = [(x.filename, x.compress_type, x.compress_size, x.file_size) for x in z.infolist()]
    data = ahead + f.getvalue()
    f = io.BytesIO(data)
    members = wa.directory(f, len(data))
    assert [(m.name, m.method, m.packed, m.size) for m in members] == written
    assert {m.name: wa.contents(f, m) for m in members} == bodies


def test_broken_packages():
    for data in (b"", b"PK\x05\x06", b"no package at all", b"PK\x05\x06" + b"\xff" * 18, b"\x00" * 100 + b"PK\x05\x06" + b"\x00\x00\x00\x00\x09\x00\x09\x00\xff\x00\x00\x00\x00\x00\x00\x00\x00\x00"):
        with pytest.raises(wa.ArchiveError):
            wa.directory(io.BytesIO(data), len(data))
    record = wa.record_bytes(1, "http://a/", b"payload", wa.payload_digest(b"payload"), None, False)
    assert wa.parse_record(record).payload == b"payload"
    with pytest.raises(wa.ArchiveError):
        wa.parse_record(wa.record_bytes(1, "http://a/", b"payload", wa.payload_digest(b"other"), None, False))
    with pytest.raises(wa.ArchiveError):
        wa.parse_record(b"HTTP/1.1 200 OK\r\n\r\n")
