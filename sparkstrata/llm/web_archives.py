"""Web archives in ZIP packages: written by tasks, read back by range reads without extraction.

A package holds a compressed WARC file, archive/data.warc.gz, with a gzip member
for each record, and an index of its records, indexes/index.cdx. Both are stored
in the package uncompressed, so a record's bytes lie in the package as they are:
the reader parses the ZIP directory, with its ZIP64 fields, reads the index
through it, and then fetches each record alone by its place.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkstrata.llm.common import arrow_schema, file_system, materialize, n_partitions, new_folder, record_batch, sliced, texts

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: A task starts another package after so many bytes of records.
PACKAGE_BYTES = 256_000_000
#: Records that lie within so many bytes of each other are read by one task, and so many bytes at a time.
BLOCK_BYTES = 16_000_000
#: Equal payloads of fewer bytes are not held against each other.
LEAST_BYTES = 0
#: The profile of revisits of equal payloads (fixed value of the format).
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class ArchiveError(ValueError):
    """A package or record that can't be read."""


class Member(NamedTuple):
    """A file in a package: its name, method (0: stored), packed and full size, and the place of its first byte."""

    name: str
    method: int
    packed: int
    size: int
    start: int


def read_at(f, at: int, n: int) -> bytes:
    f.seek(at)
    data = f.read(n)
    if len(data) != n:
        raise ArchiveError("the package ends too early")
    return data


def directory(f, length: int) -> list[Member]:
    """The members of an open package of ``length`` bytes, from its central directory, with ZIP64 fields where sizes or places need them."""
    tail_at = max(0, length - 65_557)  # the end record and the longest comment
    tail = read_at(f, tail_at, length - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (len(tail) < at + 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ArchiveError("no end of a central directory")
    disk, first_disk, here, n, size, start, _ = struct.unpack_from("<HHHHIIH", tail, at + 4)
    end_at = tail_at + at
    locator_at, wide = end_at - 20, None
    if locator_at >= 56 and (locator := read_at(f, locator_at, 20))[:4] == b"PK\x06\x07":
        # where bytes stand before the package's own, its places are too low; the record then stands before the locator
        for place in (struct.unpack_from("<Q", locator, 8)[0], locator_at - 56):
            if place <= locator_at - 56 and (record := read_at(f, place, 56))[:4] == b"PK\x06\x06":
                end_at, wide = place, record
                break
    if wide:
        disk, first_disk, here, n, size, start = struct.unpack_from("<IIQQQQ", wide, 16)
    elif n == 0xFFFF or size == 0xFFFFFFFF or start == 0xFFFFFFFF:
        raise ArchiveError("no ZIP64 end record")
    if disk or first_disk or here != n:
        raise ArchiveError("packages of several volumes can't be read")
    shift = end_at - start - size  # bytes before the package's own first one
    if shift < 0:
        raise ArchiveError("a broken central directory")
    data, at, out = read_at(f, start + shift, size), 0, []
    for _ in range(n):
        if data[at : at + 4] != b"PK\x01\x02" or len(data) < at + 46:
            raise ArchiveError("a broken central directory")
        flags, method, _, _, _, packed, full, n_name, n_extra, n_comment, _, _, _, header = struct.unpack_from("<HHHHIIIHHHHHII", data, at + 8)
        if flags & 1:
            raise ArchiveError("encrypted members can't be read")
        name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, k = data[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            kind, n_field = struct.unpack_from("<HH", extra, k)
            if kind == 1:
                values = iter(struct.unpack_from(f"<{n_field // 8}Q", extra, k + 4))
                try:  # only the fields that are full in the directory stand here, in this order
                    full = next(values) if full == 0xFFFFFFFF else full
                    packed = next(values) if packed == 0xFFFFFFFF else packed
                    header = next(values) if header == 0xFFFFFFFF else header
                except StopIteration:
                    raise ArchiveError("a broken ZIP64 field") from None
            k += 4 + n_field
        local = read_at(f, header + shift, 30)
        if local[:4] != b"PK\x03\x04":
            raise ArchiveError("a member without its header")
        own_name, own_extra = struct.unpack_from("<HH", local, 26)
        out.append(Member(name, method, packed, full, header + shift + 30 + own_name + own_extra))
        at += 46 + n_name + n_extra + n_comment
    return out


def contents(f, member: Member) -> bytes:
    """A whole member, for indexes; archives are never read as a whole."""
    data = read_at(f, member.start, member.packed)
    if member.method not in (0, 8):
        raise ArchiveError(f"method {member.method} of {member.name}")
    data = data if member.method == 0 else zlib.decompress(data, -15)
    return gzip.decompress(data) if member.name.endswith(".gz") else data


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """The same for the same page and payload, so that a record written again has the same."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool) -> bytes:
    """One record as a gzip member: a response with the payload, or a revisit of page ``first`` with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    # line ends can't stand in a header
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    header = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": target,
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{payload_digest(block)}",
        "X-Page-ID": "" if page_id is None else str(page_id),
    }
    if revisit:
        header |= {"WARC-Profile": SAME_PAYLOAD, "WARC-Refers-To": record_id(first, digest), "X-Refers-To-Page-ID": "" if first is None else str(first)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in header.items())
    return gzip.compress(f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n", 6, mtime=0)


class Record(NamedTuple):
    """A WARC record: its header fields (names in lower case), those of its HTTP header, its payload."""

    header: dict[str, str]
    http: dict[str, str]
    payload: bytes


def fields(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for x in lines:
        if x[:1] in b" \t" and x and last:  # a folded line goes on
            out[last] += " " + x.strip().decode(errors="replace")
            continue
        name, _, value = x.partition(b":")
        last = name.strip().lower().decode(errors="replace")
        out[last] = value.strip().decode(errors="replace")
    return out


def parse_record(data: bytes) -> Record:
    """The record in a gzip member, or in plain bytes; block and payload are held against the digests."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/"):
        raise ArchiveError("no WARC record")
    header = fields(lines[1:])
    block = rest[: int(header.get("content-length", len(rest)))]
    if (said := header.get("warc-block-digest")) and said.removeprefix("sha1:") != payload_digest(block):
        raise ArchiveError("a block that differs from its digest")
    http, payload = {}, block
    if header.get("content-type", "").startswith("application/http"):
        top, _, payload = block.partition(b"\r\n\r\n")
        http = fields(top.split(b"\r\n")[1:])
    if header.get("warc-type") == "response" and (said := header.get("warc-payload-digest")) and said.removeprefix("sha1:") != payload_digest(payload):
        raise ArchiveError("a payload that differs from its digest")
    return Record(header, http, payload)


def with_firsts(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, html, sha, first, later): each page with the SHA-1 of its payload, and, for later pages of a payload, the smallest page_id that has it.

    Only ids and digests are grouped, with partial minima, so a payload that
    many pages share meets in one row for each task; pages meet their smallest
    id by id and digest, which no two pages share. Rows of one id and digest are
    in one partition.
    """
    n = n_partitions(pages.sparkSession)
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumns({"sha": F.sha1(F.col("html").cast("binary")), "id": F.coalesce(F.col("page_id").cast("string"), F.lit(""))})
    ids = materialize(own.groupBy("sha", "id").agg(F.first("page_id").alias("page_id"), F.first(F.octet_length("html")).alias("size")), "page-digests")
    firsts = ids.where(F.col("size") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    later = ids.join(firsts, "sha").where("page_id is null or page_id <> first").select("sha", "id", "first", F.lit(True).alias("later"))
    met = own.repartition(n, "sha", "id").join(later, ["sha", "id"], "left")  # the only shuffle of payloads
    return met.select("page_id", "url", "html", "sha", "first", F.coalesce("later", F.lit(False)).alias("later"))


def write_packages(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(package, records): the packages with a record for each page, written by tasks to ``folder``, a URI that all machines reach.

    Of pages with equal payloads of ``least_bytes`` or more the one with the
    smallest page_id is a response, the others revisit it; all smaller ones are
    responses. Pages without page_id come after all others; of repeated rows the
    first is the response. A name belongs to one attempt of a task, and the rows
    name the packages of the attempts that Spark committed.
    """
    schema = "package string, records long"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = file_system(folder)
        before = None
        f = package = member = None
        index: list[str] = []
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            member.close()
            package.writestr(INDEX, "\n".join(index), zipfile.ZIP_STORED)
            package.close()
            f.close()
            yield record_batch({"package": [f"{folder}/{name}"], "records": [len(index)]}, arrow)

        for b in sliced(batches, 64):
            for page_id, url, sha, first, later, payload in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "sha", "first", "later")), texts(b, "html")):
                again = (page_id, sha) == before and len(payload) >= least_bytes  # repeated rows follow each other
                before = page_id, sha
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                data = record_bytes(page_id, url, payload, digest, first if later else page_id, later or again)
                if f is None:
                    name, index, size = f"{uuid.uuid4().hex}.wacz", [], 0
                    f = fs.open_output_stream(f"{place}/{name}")
                    package = zipfile.ZipFile(f, "w", zipfile.ZIP_STORED)
                    member = package.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
                member.write(data)
                about = {"offset": size, "length": len(data), "filename": ARCHIVE.rpartition("/")[2], "digest": f"sha1:{digest}"}
                index.append(f"{(url or '-').replace(' ', '%20') or '-'} 19700101000000 {json.dumps(about)}".replace("\n", "%0A").replace("\r", "%0D"))
                size += len(data)
                if size >= PACKAGE_BYTES:
                    yield from close()
                    f = None
        if f is not None:
            yield from close()

    met = with_firsts(pages, least_bytes)
    return materialize(met.sortWithinPartitions("sha", "page_id", "url").mapInArrow(run, schema), "packages")


def index_entries(packages: DataFrame) -> DataFrame:
    """(package, start, length): the place in its package of each record that the package's indexes list.

    Archives must be stored, not compressed, in the package, so that a record's
    place follows from the member's; indexes may be compressed and may be
    several. A broken package is an error.
    """
    schema = "package string, start long, length long"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column("package").to_pylist():
                fs, at = file_system(uri)
                with fs.open_input_file(at) as f:
                    members = directory(f, f.size())
                    archives = {m.name.rpartition("/")[2]: m for m in members if m.name.startswith("archive/")}
                    if bad := [m.name for m in archives.values() if m.method]:
                        raise ArchiveError(f"compressed archives can't be read by ranges: {bad}")
                    for m in (m for m in members if m.name.startswith("indexes/")):
                        starts, lengths = [], []
                        for line in io.BytesIO(contents(f, m)):
                            # a key, a time, and an object; header lines have none
                            if len(parts := line.split(b" ", 2)) == 3 and parts[2].startswith(b"{"):
                                entry = json.loads(parts[2])
                                own = archives[entry["filename"]]
                                starts.append(own.start + int(entry["offset"]))
                                lengths.append(int(entry["length"]))
                                if int(entry["offset"]) + lengths[-1] > own.packed:
                                    raise ArchiveError("an index entry beyond its archive")
                        for k in range(0, len(starts), 10_000):
                            own = slice(k, k + 10_000)
                            yield record_batch({"package": [uri] * len(starts[own]), "start": starts[own], "length": lengths[own]}, arrow)

    n = n_partitions(packages.sparkSession)
    return packages.select("package").repartition(n, "package").mapInArrow(run, schema)


def read_records(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """(package, start, type, page_id, refers_to, url, payload_digest, payload_bytes, payload) of all records of packages.

    Each record is fetched by its place; places near each other are read
    together, and a large package is read by many tasks. A revisit has no
    payload; its digest and size are those of the full payload, which its header
    and its HTTP header tell. ``payloads``: return them, else null; they are read
    and held against their digests either way.
    """
    schema = "package string, start long, type string, page_id long, refers_to long, url string, payload_digest string, payload_bytes long, payload binary"
    arrow = arrow_schema(schema)

    def parsed(uri: str, start: int, data: bytes) -> tuple:
        r = parse_record(data)
        number = lambda x: int(x) if x else None
        revisit = r.header.get("warc-type") == "revisit"
        size = int(r.http.get("content-length", 0)) if revisit else len(r.payload)
        digest = r.header["warc-payload-digest"].removeprefix("sha1:") if revisit else payload_digest(r.payload)
        return uri, start, r.header.get("warc-type"), number(r.header.get("x-page-id")), number(r.header.get("x-refers-to-page-id")), r.header.get("warc-target-uri"), digest, size, r.payload if payloads and not revisit else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, f = None, None
        for b in sliced(batches, 256):
            rows, near = [], []
            for uri, start, length in [*zip(*(b.column(c).to_pylist() for c in ("package", "start", "length"))), (None, 0, 0)]:
                if near and (uri != opened or start != near[-1][0] + near[-1][1] or start + length - near[0][0] > BLOCK_BYTES):
                    data = read_at(f, near[0][0], near[-1][0] + near[-1][1] - near[0][0])
                    rows += [parsed(opened, s, data[s - near[0][0] : s - near[0][0] + n]) for s, n in near]
                    near = []
                if uri is not None:
                    if uri != opened:
                        if f:
                            f.close()
                        fs, at = file_system(uri)
                        opened, f = uri, fs.open_input_file(at)
                    near.append((start, length))
            if rows:
                yield record_batch(dict(zip(arrow.names, zip(*rows))), arrow)
        if f:
            f.close()

    entries = index_entries(packages).withColumn("block", F.floor(F.col("start") / BLOCK_BYTES))
    dealt = entries.repartition(n_partitions(packages.sparkSession), "package", "block").sortWithinPartitions("package", "start")
    return dealt.select("package", "start", "length").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, folder: str | None = None, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): each page as its record says after archives were written and read back.

    Null html is an empty payload, null url an empty one. Rows without page_id
    get records too; repeated rows get one each, of which the first is the
    response and the others revisit it; other columns are left out; no rows give
    no packages and no rows. ``folder`` keeps the packages; without it they lie
    in the shared folder until the application ends.
    """
    packages = write_packages(pages, folder or new_folder(pages.sparkSession, "web-archives"), least_bytes)
    out = read_records(packages, payloads=False)
    return out.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


def packages_in(spark: SparkSession, path: str) -> DataFrame:
    """(package): the packages that lie under a path, for `read_records`; their contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wacz").load(path).select(F.col("path").alias("package"))
