"""Web archives in ZIP packages: WARC records beside their index, read by byte ranges.

A package holds two stored members, ``archive/data.warc.gz`` and ``indexes/index.cdxj``.
Each record is a gzip member of its own. The reader takes the end of the file, follows the
ZIP64 locator where there is one, parses the central directory, finds where the members'
bytes start, and reads single records through the index without extracting anything.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_schema, column, slices, with_row_ids
from lodestone.llm.files import attempt_name, open_folder
from lodestone.staging import new_path, stage

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD_ID = "<urn:page:{}>"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str, payload: bytes, refers_to, date: str) -> bytes:
    """One gzip member: a response, or a revisit that keeps only the HTTP header."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_RECORD_ID.format('none' if page_id is None else page_id)}",
        f"WARC-Date: {date}",
        # a line break inside a value would end the header line
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_RECORD_ID.format(refers_to)}", f"WARC-Profile: {PROFILE}"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    data = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return packer.compress(data) + packer.flush()


def package(members: list[tuple[str, bytes]], zip64: bool = True) -> Iterator[bytes]:
    """The bytes of a ZIP file with stored members; with ZIP64 records if asked or needed."""
    at, central = 0, b""
    for name, data in members:
        crc, size, title = zlib.crc32(data), len(data), name.encode()
        wide = zip64 or size >= 0xFFFFFFFF or at >= 0xFFFFFFFF
        short = 0xFFFFFFFF if wide else size
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        version = 45 if wide else 20
        head = struct.pack("<4s5H3L2H", b"PK\x03\x04", version, 0, 0, 0, 33, crc, short, short,
                           len(title), len(extra))
        full = struct.pack("<HHQQQ", 1, 24, size, size, at) if wide else b""
        central += struct.pack(
            "<4s6H3L5H2L", b"PK\x01\x02", version, version, 0, 0, 0, 33, crc, short, short,
            len(title), len(full), 0, 0, 0, 0, 0xFFFFFFFF if wide else at) + title + full
        yield head + title + extra
        yield data
        at += len(head) + len(title) + len(extra) + size
    tail, count = b"", len(members)
    if zip64 or at >= 0xFFFFFFFF:
        tail = struct.pack("<4sQ2H2L4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count,
                           len(central), at)
        tail += struct.pack("<4sLQL", b"PK\x06\x07", 0, at + len(central), 1)
        end = struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    else:
        end = struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, count, count, len(central), at, 0)
    yield central + tail + end


class PackageReader:
    """Stored members of a ZIP file by byte range."""

    def __init__(self, handle, size: int):
        self.handle = handle
        tail_at = max(0, size - 22 - 0xFFFF)
        tail = self._range(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<10xH2L", tail, end)
        locator = end - 20
        if locator >= 0 and tail[locator : locator + 4] == b"PK\x06\x07":
            (at,) = struct.unpack_from("<8xQ", tail, locator)
            count, length, start = struct.unpack("<32x3Q", self._range(at, 56))
        self.members = self._members(self._range(start, length), count)

    def _range(self, at: int, length: int) -> bytes:
        self.handle.seek(at)
        data = self.handle.read(length)
        if len(data) != length:
            raise ValueError("the file ends early")
        return data

    @staticmethod
    def _members(central: bytes, count: int) -> dict[str, tuple[int, int, int, int]]:
        found, at = {}, 0
        for _ in range(count):
            mark, method, crc, packed, size, n, m, k, start = struct.unpack_from(
                "<4s6xH4x3L3H8xL", central, at)
            if mark != b"PK\x01\x02":
                raise ValueError("broken central directory")
            name = central[at + 46 : at + 46 + n].decode()
            extra = central[at + 46 + n : at + 46 + n + m]
            i = 0
            while i + 4 <= len(extra):
                kind, length = struct.unpack_from("<2H", extra, i)
                if kind == 1:
                    wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, i + 4))
                    size = next(wide) if size == 0xFFFFFFFF else size
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    start = next(wide) if start == 0xFFFFFFFF else start
                i += 4 + length
            found[name] = (method, start, size, crc)
            at += 46 + n + m + k
        return found

    def start_of(self, name: str) -> tuple[int, int]:
        """(first byte, size) of a stored member's data."""
        method, at, size, _ = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is not stored")
        n, m = struct.unpack("<26x2H", self._range(at, 30))
        return at + 30 + n + m, size

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        start, size = self.start_of(name)
        whole = length is None
        length = size - offset if whole else length
        if offset < 0 or length < 0 or offset + length > size:
            raise ValueError("range outside the member")
        data = self._range(start + offset, length)
        if whole and not offset and zlib.crc32(data) != self.members[name][3]:
            raise ValueError(f"{name} is damaged")
        return data


def parse(packed: bytes) -> dict:
    """Headers and payload of one record."""
    data = zlib.decompress(packed, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    for line in http.decode().split("\r\n")[1:]:
        if line.lower().startswith("content-length: "):
            fields["length"] = int(line[16:])
    if fields["WARC-Type"] == "response":
        if len(payload) != fields["length"]:
            raise ValueError("payload of another length")
        if "sha1:" + base32_sha1(payload) != fields["WARC-Payload-Digest"]:
            raise ValueError("payload with another digest")
    return fields | {"payload": payload}


def _page(urn: str | None) -> int | None:
    return None if urn in (None, "<urn:page:none>") else int(urn[len("<urn:page:") : -1])


def first_copies(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(id, digest, first): for pages whose payload, of at least ``least_bytes``, equals that
    of a page with a smaller id, and with ``first`` = id for repeated rows of the smallest. Only ids and digests are shuffled; a hot digest is one row
    of minima after map-side grouping."""
    small = pages.where(F.octet_length("html") >= least_bytes).select("id", "digest")
    least = small.groupBy("digest").agg(F.min("id").alias("first"))
    return small.join(least, "digest").groupBy("id", "digest", "first").count().where(
        "id > first or (id is null and first is not null) or (id = first and count > 1)").drop("count")


def write(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least_bytes: int = 0, package_bytes: int = 16 << 20, date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Writes packages under the shared folder; returns their manifest (path, records).

    Of records with equal payloads of at least ``least_bytes`` the smallest id is the
    response and the rest revisit it; a repeated row of the same id revisits its first row.
    Null payloads are empty ones, a null url is empty, and a page without an id revisits
    equal pages that have one or is a response. Other columns are not read. A package is
    cut once it holds ``package_bytes``; a larger record has a package to itself.
    """
    spark = pages.sparkSession
    rows = pages.select(
        column(id_col).cast("long").alias("id"), column(url_col).cast("string").alias("url"),
        F.coalesce(column(html_col).cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha1("html"))
    copies = stage(first_copies(rows, least_bytes), "page-copies")
    a, b = rows.alias("a"), copies.alias("b")
    joined = a.join(
        b, F.expr("a.id <=> b.id and a.digest = b.digest"), "left"
    ).select("a.id", "a.url", "a.html", "a.digest", "b.first")
    if not copies.where("id = first").isEmpty():
        # Of repeated rows, wherever a plan puts them, the one with the least row id is the response.
        again = stage(with_row_ids(joined.where("id = first")), "repeated-pages")
        chosen = again.groupBy("id", "digest").agg(F.min("rid").alias("least"))
        marked = again.join(chosen, ["id", "digest"]).select(
            "id", "url", "html", "digest", F.expr("if(rid = least, null, first)").alias("first"))
        joined = joined.where("first is null or id is null or id <> first").union(marked)
    ordered = joined.sortWithinPartitions("id", "digest")
    folder = new_path(spark, "warc")
    made = arrow_schema("path string, records long")

    def run(batches):
        filesystem, root = open_folder(folder)
        filesystem.create_dir(root, recursive=True)
        held, index, size, number = [], [], 0, 0

        def close():
            nonlocal held, index, size, number
            name = attempt_name("pages", number, ".zip")
            lines = "\n".join(json.dumps(x) for x in index).encode()
            with filesystem.open_output_stream(f"{root}/{name}") as out:
                for piece in package([(ARCHIVE, b"".join(held)), (INDEX, lines)]):
                    out.write(piece)
            count = len(index)
            held, index, size, number = [], [], 0, number + 1
            return pa.RecordBatch.from_pydict(
                {"path": [f"{folder}/{name}"], "records": [count]}, schema=made)

        for part in slices(batches, "html"):
            for page, url, html, _, first in zip(*(c.to_pylist() for c in part.columns), strict=True):
                payload = html.encode()
                packed = record(page, url or "", payload, first, date)
                index.append({"offset": size, "length": len(packed)})
                held.append(packed)
                size += len(packed)
                if size >= package_bytes:
                    yield close()
        if index:
            yield close()

    # The manifest is a row per package; a few files hold it.
    found = ordered.mapInArrow(run, "path string, records long").repartition(8)
    return stage(found, "warc-manifest")


def read(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record of the packages that ``manifest`` names, read by byte ranges."""
    schema = (
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long" + (", payload binary" if with_payload else "")
    )
    arrow = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for path in batch["path"].to_pylist():
                filesystem, at = open_folder(path)
                with filesystem.open_input_file(at) as handle:
                    reader = PackageReader(handle, handle.size())
                    lines = reader.read(INDEX).splitlines()
                    for start in range(0, len(lines), 256):
                        got = []
                        for line in lines[start : start + 256]:
                            place = json.loads(line)
                            got.append(parse(reader.read(ARCHIVE, place["offset"], place["length"])))
                        columns = [
                            [_page(r["WARC-Record-ID"]) for r in got],
                            [r["WARC-Target-URI"] for r in got], [r["length"] for r in got],
                            [r["WARC-Payload-Digest"].removeprefix("sha1:") for r in got],
                            [r["WARC-Type"] for r in got],
                            [_page(r.get("WARC-Refers-To")) for r in got],
                        ] + ([[r["payload"] for r in got]] if with_payload else [])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(v, type=f.type) for v, f in zip(columns, arrow, strict=True)],
                            schema=arrow)

    # A task for every few packages, so that a small set still uses all cores.
    packages, cores = manifest.count(), manifest.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(packages, max(cores, packages // 8)))
    return manifest.select("path").repartition(tasks).mapInArrow(run, schema)
