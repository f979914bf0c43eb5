"""Web archives in ZIP packages: round trips against brute force, and packages that others wrote, whole and damaged."""

import gzip
import hashlib
import io
import json
import struct
import zipfile
from collections import Counter

import pytest

from quillon.llm import warc


def reader(data):
    return lambda at, n: data[at : at + n]


def brute(pages):
    """(page_id, bytes, digest, type, refers_to) of rows (page_id, html)."""
    first, out = {}, []
    for i, html in sorted(pages, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (html or "").encode()
        own = [i, len(raw), hashlib.sha256(raw).hexdigest()]
        if len(raw) >= 100 and raw in first:
            out.append((*own, "revisit", first[raw]))
        else:
            first.setdefault(raw, i)
            out.append((*own, "response", None))
    return Counter(out)


def got(df):
    return Counter(tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


LONG = "<p>é" * 100
PAGES = [
    (5, "http://a.example/1", LONG), (3, "http://a.example/2", LONG), (9, "http://a.example/ü x\r\nWARC-Type: y", LONG), (9, "http://a.example/", LONG), (9, "http://a.example/", LONG), (None, "u", LONG), (None, None, LONG),
    (1, "u", None), (2, "u", ""), (2, "u", ""), (4, None, "x" * 99), (6, "u", "x" * 99), (7, "u", "y" * 100), (7, "u", "y" * 100), (None, "u", "z" * 100), (None, "u", "z" * 100), (8, "u", "WARC/1.1\r\n\r\n\r\nPK\5\6" * 20),
    (10, "u", "long " * 600_000), (2**62, "u", "big"), (-4, "u", LONG + "2"),
]


@pytest.fixture(scope="module")
def pages(spark):
    from pyspark.sql import functions as F

    made = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(4)
    return made.withColumns({x: F.lit(1) for x in ("payload", "digest", "size", "n", "first", "path", "record_type", "refers_id")})


def test_odd_pages(pages):
    assert got(warc.archive_pages(pages)) == brute([(i, html) for i, _, html in PAGES])
    assert warc.archive_pages(pages.where("false")).collect() == []


def test_whole_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    twice = table.unionByName(table.withColumn("page_id", table.page_id + 10**6).where("page_id % 3 = 0"))
    assert got(warc.archive_pages(twice)) == brute([(r["page_id"], r["html"]) for r in twice.collect()])


def test_one_page_a_thousand_times(spark):
    hot = spark.range(2000).selectExpr("if(id % 2 = 0, id, null) AS page_id", "'u' AS url", f"if(id % 4 < 3, '{LONG}', concat('{LONG}', id)) AS html")
    found = got(warc.archive_pages(hot))
    assert found == brute([(r["page_id"], r["html"]) for r in hot.collect()])
    assert sum(n for (_, _, _, kind, to), n in found.items() if kind == "revisit" and to == 0) == 1499


def test_packages_roll_and_payloads_return(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PACKAGE_RECORDS", 2)
    packages = warc.write_packages(pages, str(tmp_path / "many"))
    assert packages.count() > 4 and all(zipfile.is_zipfile(r["path"]) for r in packages.collect())
    assert sum(r["records"] for r in packages.collect()) == len(PAGES)
    found = [r for r in warc.read_packages(spark, packages).collect() if r["record_type"] == "response"]
    want = {(html or "").encode() for _, _, html in PAGES}
    assert {bytes(r["payload"]) for r in found} == want
    assert len({r["record_id"] for r in found}) == len(found)
    assert {r["uri"] for r in found} >= {"http://a.example/2", "u"}


def foreign(index=True, gz=True, comment=b"", before=b"", method=zipfile.ZIP_STORED, n=5):
    """A package as another writer may make it: several members, its own field order, folded fields."""
    out, body, lines = io.BytesIO(), io.BytesIO(), []
    for i in range(n):
        block = f"HTTP/1.1 200 OK\r\nX: {i}\r\n\r\npage {i}".encode()
        raw = b"WARC/1.0\r\nContent-Length: %d\r\nWARC-Record-ID: <urn:x:%d>\r\nwarc-type: response\r\nX-Note: a\r\n b\r\nContent-Type: application/http;msgtype=response\r\n\r\n%s\r\n\r\n" % (len(block), i, block)
        raw = gzip.compress(raw) if gz else raw
        lines.append(f"com,example)/{i} 2020 " + json.dumps({"offset": str(body.tell()), "length": str(len(raw)), "filename": "own.warc" + ".gz" * gz}))
        body.write(raw)
    out.write(before)
    with zipfile.ZipFile(out, "a" if before else "w", method) as z:
        z.writestr("pages/pages.jsonl", "{}\n" * 100, zipfile.ZIP_DEFLATED)
        z.writestr("archive/own.warc" + ".gz" * gz, body.getvalue())
        if index:
            z.writestr("indexes/index.cdxj", "\n".join(reversed(lines)))
        z.comment = comment
    return out.getvalue()


def payloads(data):
    read = reader(data)
    return [warc.parse(read(start + sum(sizes[:k]), sizes[k]))[1] for start, sizes in warc.spans(read, len(data), 300) for k in range(len(sizes))]


@pytest.mark.parametrize("index", [True, False])
@pytest.mark.parametrize("gz", [True, False])
@pytest.mark.parametrize("comment,before", [(b"", b""), (b"ends PK\5\6 here " * 50, b""), (b"", b"#!/bin/sh\n" * 7)])
def test_foreign_packages(index, gz, comment, before):
    assert payloads(foreign(index, gz, comment, before)) == [f"page {i}".encode() for i in range(5)]


def test_zip64_directory(monkeypatch):
    """Limits lowered: zipfile writes ZIP64 fields and end records, as for files beyond 4 GB."""
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    for before in (b"", b"x" * 31):
        data = foreign(before=before)
        assert b"PK\6\6" in data and b"PK\6\7" in data
        assert payloads(data) == [f"page {i}".encode() for i in range(5)]


def test_directory_in_pieces():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(70_000):  # more than the classic end record can count
            z.writestr(zipfile.ZipInfo(f"m{i}"), b"")
    data = out.getvalue()
    found = list(warc.members(reader(data), len(data), chunk=1000))
    assert [m.name for m in found] == [f"m{i}" for i in range(70_000)]


def test_damage_is_an_error():
    data = foreign()
    for bad in (data[:-30], b"", b"no zip", data[: len(data) // 2]):
        with pytest.raises(ValueError):
            payloads(bad)
    with pytest.raises(ValueError, match="stored"):
        payloads(foreign(method=zipfile.ZIP_DEFLATED))
    whole = warc.page_record(1, "u", hashlib.sha256(b"abc").hexdigest(), 3, b"abc")
    assert warc.parse(whole)[1] == b"abc"
    with pytest.raises(ValueError, match="digest"):
        warc.parse(whole.replace(b"abc", b"abd"))
    with pytest.raises(ValueError, match="cut off"):
        warc.parse(whole[:-8])
    at = data.index(b"PK\1\2")
    with pytest.raises(ValueError):
        list(warc.members(reader(data[:at] + b"XX" + data[at + 2 :]), len(data)))
    n = struct.pack("<H", 3)
    assert data[-22 + 10 : -22 + 12] == n
