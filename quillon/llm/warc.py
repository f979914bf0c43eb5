"""Web archives in ZIP packages: written in parallel, read by ranges without extraction.

A package is a ZIP file with stored members: `archive/data.warc.gz`, one gzip member per WARC record, and
`indexes/index.cdxj`, one line per record with its place. The reader takes any such package, from other writers too: it
parses the end record, the central directory (ZIP64 forms included) and local headers, finds archives and indexes, and
fetches records by range. Files are opened with pyarrow.fs, so packages may lie on a shared disk, HDFS or an object
store that it knows by the scheme of the path.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common

#: Payloads of fewer bytes are stored each time.
LEAST_BYTES = 100
#: Bytes of records or number of records after which a package is closed.
PACKAGE_BYTES, PACKAGE_RECORDS = 64 << 20, 100_000
#: Bytes of neighbouring records that are fetched at once.
RANGE_BYTES = 8 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Visible ASCII, as it is in a URL.
_PLAIN = "".join(map(chr, range(33, 127)))

Read = Callable[[int, int], bytes]


# writing


def _record(fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in (fields | {"Content-Length": str(len(block))}).items())
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, digest: str, size: int, payload: bytes | None, number: int = 0) -> bytes:
    """A response with its payload, or without one a revisit of the response that has this digest."""
    own = f"urn:page:{'' if page_id is None else page_id}:{number}:{digest}"
    response, large = payload is not None, size >= LEAST_BYTES
    fields = {
        "WARC-Type": "response" if response else "revisit",
        "WARC-Record-ID": f"<{f'urn:sha256:{digest}' if response and large else own}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": quote(url, safe=_PLAIN) if url else own,
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha256:{digest}",
    }
    if page_id is not None:
        fields["WARC-Page-ID"] = str(page_id)
    if not response:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:sha256:{digest}>"}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return _record(fields, http + (payload or b""))


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Package:
    """A package that is written record by record; only its index is held."""

    def __init__(self, stream) -> None:  # noqa: ANN001
        self.zip, self.at, self.lines = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED), 0, []
        self.archive = self.zip.open(zipfile.ZipInfo("archive/data.warc.gz"), "w", force_zip64=True)
        info = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields"}
        self._put(_record(info, b"format: WARC File Format 1.1\r\n"))

    def _put(self, record: bytes) -> int:
        raw = _gzip(record)
        self.archive.write(raw)
        self.at += len(raw)
        return len(raw)

    def add(self, key: str, record: bytes) -> None:
        start = self.at
        place = {"filename": "data.warc.gz", "offset": start, "length": self._put(record)}
        self.lines.append(f"{key} 19700101000000 {json.dumps(place)}\n")

    def close(self) -> None:
        self.archive.close()
        with self.zip.open(zipfile.ZipInfo("indexes/index.cdxj"), "w") as index:
            for line in sorted(self.lines):
                index.write(line.encode())
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "wacz_version": "1.1.1"}))
        self.zip.close()


def write_packages(pages: DataFrame, path: str) -> DataFrame:
    """Write a record per row of pages (page_id, url, html) into packages under path; gives (path, records) of each.

    Of rows with equal payloads of LEAST_BYTES or more, one with the smallest page_id (nulls last, then the smallest
    url) is the response and the others are revisits of it; smaller payloads are all responses. Null html is an empty
    payload. Equal rows meet before they travel, and are told apart by a number; rows of one payload lie wherever their
    own hash says, so copies of a page do not gather: a revisit names its response by digest. A task that is run again
    writes files under new names, and only those that the committed list names are ever read.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"digest": F.unhex(F.sha2("payload", 256)), "size": F.octet_length("payload").cast("long")})
    large = rows.where(F.col("size") >= LEAST_BYTES).groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("bare"), "url")).alias("first"))
    firsts = large.select("digest", "first.page_id", "first.url").withColumns({"payload": F.lit(None).cast("string"), "size": F.lit(0).cast("long"), "n": F.lit(0).cast("long"), "first": F.lit(1)})
    both = rows.withColumns({"n": F.lit(1).cast("long"), "first": F.lit(0)}).unionByName(firsts)
    alike = both.groupBy("digest", "page_id", "url").agg(F.max("payload").alias("payload"), F.max("size").alias("size"), F.sum("n").alias("n"), F.max("first").alias("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pafs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        package = stream = name = None

        def close() -> pa.RecordBatch:
            package.close()
            stream.close()
            return pa.RecordBatch.from_pydict({"path": [f"{path}/{name}"], "records": [len(package.lines)]})

        for batch in batches:
            for i in range(len(batch)):
                page_id, url, digest, text, size, n, first = (batch.column(x)[i].as_py() for x in ("page_id", "url", "digest", "payload", "size", "n", "first"))
                payload, digest = text.encode(), digest.hex()
                for number in range(n):
                    if package is None:
                        name = f"{uuid.uuid4().hex}.wacz"
                        stream = store.open_output_stream(f"{folder}/{name}")
                        package = Package(stream)
                    response = size < LEAST_BYTES or (first == 1 and number == 0)
                    package.add(digest, page_record(page_id, url, digest, size, payload if response else None, number))
                    if package.at >= PACKAGE_BYTES or len(package.lines) >= PACKAGE_RECORDS:
                        yield close()
                        package = None
        if package is not None:
            yield close()

    return common.materialize(alike.mapInArrow(write, "path string, records long"), "packages")


# reading


class Member(NamedTuple):
    name: str
    method: int
    flags: int
    stored: int
    header: int


def _end(read: Read, size: int) -> tuple[int, int, int, int]:
    """Entries of the central directory, its bytes, its first byte, and what precedes the ZIP file itself."""
    tail = read(max(0, size - 65_557), min(size, 65_557))
    at = tail.rfind(b"PK\5\6")
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\5\6", 0, at)
    if at < 0:
        raise ValueError("no ZIP file: it has no end record")
    _, disk, first_disk, _, n, length, start, _ = struct.unpack_from("<4s4H2LH", tail, at)
    end = size - len(tail) + at
    if end >= 20 and (found := read(end - 20, 20))[:4] == b"PK\6\7":
        _, first_disk, stated, _ = struct.unpack("<4sLQL", found)
        for place in (stated, end - 76):  # the second, where something precedes the file
            if 0 <= place <= end - 76 and (record := read(place, 56))[:4] == b"PK\6\6":
                _, _, _, _, disk, first_disk, _, n, length, start = struct.unpack("<4sQ2H2L4Q", record)
                end = place
                break
        else:
            raise ValueError("ZIP64 end record not found")
    if disk or first_disk:
        raise ValueError("ZIP files in several parts are not read")
    before = end - length - start
    if before < 0:
        raise ValueError("central directory out of place")
    return n, length, start + before, before


def members(read: Read, size: int, chunk: int = 1 << 20) -> Iterator[Member]:
    """Entries of the central directory, which is read in pieces."""
    n, left, at, before = _end(read, size)
    held = b""

    def need(k: int) -> bool:
        nonlocal held, at, left
        while len(held) < k and left:
            take = min(left, max(chunk, k - len(held)))
            held, at, left = held + read(at, take), at + take, left - take
        return len(held) >= k

    for _ in range(n):
        if not need(46) or held[:4] != b"PK\1\2":
            raise ValueError("central directory is damaged")
        _, _, _, flags, method, _, _, _, stored, whole, named, extra, comment, disk, _, _, header = struct.unpack_from("<4s6H3L5H2L", held)
        if not need(46 + named + extra + comment):
            raise ValueError("central directory is damaged")
        name = held[46 : 46 + named].decode("utf-8" if flags & 0x800 else "cp437")
        fields, held = held[46 + named : 46 + named + extra], held[46 + named + extra + comment :]
        while len(fields) >= 4:
            kind, length = struct.unpack_from("<2H", fields)
            if kind == 1:  # ZIP64: in this order, only what does not fit above
                wide = iter(struct.unpack_from(f"<{length // 8}Q", fields, 4))
                if whole == 0xFFFFFFFF:
                    whole = next(wide)
                if stored == 0xFFFFFFFF:
                    stored = next(wide)
                if header == 0xFFFFFFFF:
                    header = next(wide)
            fields = fields[4 + length :]
        yield Member(name, method, flags, stored, header + before)


def data_start(read: Read, member: Member) -> int:
    """Where the bytes of a stored member begin, by its local header."""
    head = read(member.header, 30)
    if head[:4] != b"PK\3\4":
        raise ValueError(f"{member.name}: no local header")
    if member.method or member.flags & 1:
        raise ValueError(f"{member.name}: only stored members can be read by range")
    return member.header + 30 + sum(struct.unpack_from("<2H", head, 26))


def walk(read: Read, size: int, chunk: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(offset, length) of each record of an archive that has no index: of each gzip member, or by Content-Length."""
    at = 0
    if size and read(0, 2) == b"\x1f\x8b":
        unpack, start, left = zlib.decompressobj(31), 0, b""
        while at < size or left:
            if not left:
                left = read(at, min(chunk, size - at))
                at += len(left)
            unpack.decompress(left)
            left = b""
            if unpack.eof:
                left = unpack.unused_data
                yield start, at - len(left) - start
                start, unpack = at - len(left), zlib.decompressobj(31)
        if start != size:
            raise ValueError("archive is cut off")
        return
    while at < size:
        head = b""
        while b"\r\n\r\n" not in head:
            more = read(at + len(head), min(4096, size - at - len(head)))
            if not more:
                raise ValueError("archive is cut off")
            head += more
        head = head.partition(b"\r\n\r\n")[0]
        length = len(head) + 4 + int(_fields(head)["content-length"]) + 4
        yield at, length
        at += length


def spans(read: Read, size: int, most: int = RANGE_BYTES) -> Iterator[tuple[int, list[int]]]:
    """Runs of neighbouring records of a package: (first byte, bytes of each), by its indexes or else by walking."""
    found = list(members(read, size))
    archives = {m.name.rpartition("/")[2]: m for m in found if m.name.endswith((".warc", ".warc.gz"))}
    places: dict[str, list[tuple[int, int]]] = {}
    for m in found:
        if m.name.endswith((".cdxj", ".cdx")):
            for line in read(data_start(read, m), m.stored).decode().splitlines():
                if (cut := line.find("{")) >= 0:
                    place = json.loads(line[cut:])
                    places.setdefault(place["filename"].rpartition("/")[2], []).append((int(place["offset"]), int(place["length"])))
    for name, m in archives.items():
        start = data_start(read, m)
        own = sorted(set(places[name])) if name in places else walk(lambda at, n, s=start: read(s + at, n), m.stored)
        first, sizes = 0, []
        for at, length in own:
            if at + length > m.stored or length <= 0:
                raise ValueError(f"{name}: a record lies outside of it")
            if sizes and (at != first + sum(sizes) or sum(sizes) + length > most):
                yield start + first, sizes
                sizes = []
            if not sizes:
                first = at
            sizes.append(length)
        if sizes:
            yield start + first, sizes


def _fields(head: bytes) -> dict[str, str]:
    found: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t"):
            found[name] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        name = name.strip().lower()
        found[name] = value.strip()
    return found


def parse(raw: bytes) -> tuple[dict[str, str], bytes | None, int]:
    """Fields, payload (null where the record has none of its own) and payload bytes of a record, gzipped or plain.

    A payload that does not have the digest that its record states is an error.
    """
    data = zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw
    if not data.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    length = int(fields["content-length"])
    block = rest[:length]
    if len(block) != length:
        raise ValueError("record is cut off")
    if not fields.get("content-type", "").startswith("application/http"):
        return fields, block, len(block)
    http, _, payload = block.partition(b"\r\n\r\n")
    if fields["warc-type"] == "revisit":
        return fields, None, int(_fields(http).get("content-length", 0))
    kind, _, digest = fields.get("warc-payload-digest", "").partition(":")
    if kind == "sha256" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("payload does not have its digest")
    return fields, payload, len(payload)


def read_packages(spark: SparkSession, packages: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of packages (path): page_id, record_type, record_id, refers_id, uri, payload_digest, payload_bytes, payload.

    First the directories and indexes are read, then runs of records of about RANGE_BYTES, dealt over the cluster, so
    that a large package is read by many tasks. Without `payloads`, that column is not made. Records other than
    responses and revisits are not returned. A damaged package is an error. No packages: an empty result.
    """

    def opened(path: str):  # noqa: ANN202
        store, own = pafs.FileSystem.from_uri(path)
        return store.open_input_file(own)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with opened(path) as file:
                    for start, sizes in spans(lambda at, n, f=file: f.read_at(n, at), file.size()):
                        yield pa.RecordBatch.from_pydict({"path": [path], "start": [start], "sizes": [sizes]}, schema=pa.schema([("path", pa.string()), ("start", pa.int64()), ("sizes", pa.list_(pa.int64()))]))

    fields = [("page_id", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_id", pa.string()), ("uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64())]
    if payloads:
        fields.append(("payload", pa.binary()))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, sizes in zip(*(batch.column(x).to_pylist() for x in ("path", "start", "sizes")), strict=True):
                with opened(path) as file:
                    data, at, out = memoryview(file.read_at(sum(sizes), start)), 0, []
                for size in sizes:
                    head, payload, n = parse(bytes(data[at : at + size]))
                    at += size
                    if head["warc-type"] in ("response", "revisit"):
                        page, refers = head.get("warc-page-id"), head.get("warc-refers-to")
                        digest = head.get("warc-payload-digest", "").rpartition(":")[2] or None
                        row = [int(page) if page else None, head["warc-type"], head["warc-record-id"], refers, head.get("warc-target-uri"), digest, n]
                        out.append([*row, payload] if payloads else row)
                if out:
                    yield pa.RecordBatch.from_pydict({k: x for (k, _), x in zip(fields, zip(*out, strict=True), strict=True)}, schema=pa.schema(fields))

    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    n = common.partitions(spark)
    found = packages.select("path").repartition(n, "path").mapInArrow(locate, "path string, start long, sizes array<long>")
    return found.repartition(n, "path", "start").mapInArrow(fetch, ", ".join(f"{k} {names[t]}" for k, t in fields))


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write all pages into packages and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    One row per row of pages. refers_to is the page_id of the response that a revisit names, else null; null too where
    that response has no page_id. Nulls, ties and repeated rows: as in write_packages. Other columns are ignored.
    """
    spark = pages.sparkSession
    folder = path or f"{common.scratch(spark)}/warc-{uuid.uuid4().hex}"
    packages = write_packages(pages.select(F.col("page_id").cast("long"), "url", "html"), folder)
    records = common.materialize(read_packages(spark, packages, payloads=False), "records")
    shown = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    responses = records.where("record_type = 'response'")
    # every revisit meets one row; a response that many revisits name meets them in as many tasks as its share needs
    named = responses.where(F.col("payload_bytes") >= LEAST_BYTES).select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"))
    revisits = records.where("record_type = 'revisit'").join(named.hint("merge"), "refers_id", "left")
    return responses.select(*shown, F.lit(None).cast("long").alias("refers_to")).unionByName(revisits.select(*shown, "refers_to"))
