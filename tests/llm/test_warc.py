from __future__ import annotations

import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from routelore.llm import warc

PAGES = "page_id long, url string, html string"


def test_round_trip(spark, tmp_path):
    long, other = "ä" * 600, "b" * 1000
    rows = [(1, "http://a/\r\nX: y", long), (5, "http://b/", long), (3, None, long), (7, "http://c/", None), (8, "http://d/", ""), (9, "http://e/", "short"), (10, "http://f/", "short"),
            (11, "http://g/", other), (11, "http://g/", other), (None, "http://h/", other), (12, "http://i/", "\r\n\r\nWARC/1.1\r\n" * 20_000)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("payload", F.lit("clash")).repartition(3)
    got = warc.round_trip(pages, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        page, url, html = next(x for x in rows if x[0] == r.page_id and x[1] == r.url)
        raw = (html or "").encode()
        best = max((x[0] for x in rows if (x[2] or "") == (html or "") and x[0] is not None), default=None)
        revisit = len(raw) >= 1000 and best is not None and page != best
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", best if revisit else None)
        assert r.payload == (None if revisit else raw)
    assert warc.round_trip(pages.limit(0), str(tmp_path / "none")).collect() == []


def zip_bytes(files, zip64=False, comment=b"", method=zipfile.ZIP_STORED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        z.comment = comment
        for name, data in files.items():
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=zip64) as f:
                f.write(data)
    return out.getvalue()


@pytest.mark.parametrize("zip64", [False, True])
def test_members(zip64):
    files = {"archive/ä.warc.gz": b"x" * 1000, "indexes/index.cdxj": b"", "z": b"PK\x05\x06" * 9}
    data = zip_bytes(files, zip64, b"comment " * 100)
    found = warc.members(lambda offset, length: data[offset : offset + length], len(data))
    assert {n: data[a : a + size] for n, (a, size) in found.items()} == files
    deflated = io.BytesIO()
    with zipfile.ZipFile(deflated, "w") as z:
        z.writestr("a", b"y" * 99, zipfile.ZIP_DEFLATED)
    data = deflated.getvalue()
    assert warc.members(lambda o, n: data[o : o + n], len(data)) == {}


def test_zip64_directory():
    """All sizes and places in ZIP64 fields, and a ZIP64 end record."""
    import struct

    body, name = b"hello", b"archive/a"
    local = struct.pack("<4sHHHHHLLLHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, 5, 5) + body
    extra = struct.pack("<HHQQQ", 1, 24, 5, 5, 0)
    central = struct.pack("<4sHHHHHHLLLHHHHHLL", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    at = len(local)
    end64 = struct.pack("<4sQHHLLQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    data = local + central + end64 + struct.pack("<4sLQL", b"PK\x06\x07", 0, at + len(central), 1) + struct.pack("<4sHHHHLLH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    found = warc.members(lambda o, n: data[o : o + n], len(data))
    assert [data[a : a + n] for a, n in found.values()] == [body]


def test_archives_roll_and_lack_an_index(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"page {i} " * 50) for i in range(60)], PAGES).coalesce(1)
    archives = warc.write_archives(warc.with_record_types(pages), str(tmp_path), archive_bytes=2000, zip64=True)
    assert archives.count() > 3 and archives.agg(F.sum("records")).first()[0] == 60
    bare = zip_bytes({warc.DATA: open_member(archives.first().path)})
    (tmp_path / "bare.wacz").write_bytes(bare)
    ranges = warc.record_ranges(spark.createDataFrame([(str(tmp_path / "bare.wacz"),)], "path string"))
    assert warc.read_records(ranges).count() == archives.first().records
    small = warc.record_ranges(archives, range_bytes=300)
    assert sorted(r.page_id for r in warc.read_records(small).collect()) == list(range(60))


def open_member(path):
    with zipfile.ZipFile(path) as z:
        return z.read(warc.DATA)


def foreign(kind, number, payload, head=b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"):
    block = head + payload
    fields = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: <urn:uuid:%d>" % number, b"WARC-Target-URI: http://x/%d?\\u" % number, b"Content-Length: %d" % len(block)]
    fields += [b"Content-Type: application/http; msgtype=response"] if head else [b"Content-Type: application/warc-fields"]
    return b"\r\n".join(fields) + b"\r\n\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("index", ["two", "gzipped", "deflated", "none"])
def test_several_members_of_another_writer(spark, tmp_path, index):
    import gzip
    import json

    texts = {f"archive/part{k}.warc{'.gz' if k < 2 else ''}": [foreign(b"warcinfo", 100 * k, b"software: x", b"")] + [foreign(b"response", 100 * k + i, b"page %d " % i * (50 * i)) for i in range(1, 30)] for k in range(3)}
    files, lines = {}, {}
    for name, records in texts.items():
        parts = [gzip.compress(r) for r in records] if name.endswith(".gz") else records
        files[name] = b"".join(parts)
        at = 0
        for k, p in enumerate(parts):
            lines.setdefault(name, []).append(f"x,{k:03d})/ 2020 " + json.dumps({"filename": name.rpartition("/")[2], "offset": str(at), "length": str(len(p))}))
            at += len(p)
    own = {n: "\n".join(["!meta {}", *reversed(x)]).encode() for n, x in lines.items()}  # not in the order of the data
    both = b"\n".join(own.values())
    if index == "two":
        files |= {f"indexes/i{k}.cdxj": v for k, v in enumerate(list(own.values())[:2])}  # the third member is in no index
    elif index == "gzipped":
        files["indexes/all.cdx.gz"] = gzip.compress(both[:999]) + gzip.compress(both[999:])
    data = zip_bytes(files)
    if index == "deflated":
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, raw in files.items():
                z.writestr(name, raw, zipfile.ZIP_STORED)
            z.writestr("indexes/all.cdxj", both, zipfile.ZIP_DEFLATED)
        data = out.getvalue()
    (tmp_path / "other.wacz").write_bytes(data)
    archive = spark.createDataFrame([(str(tmp_path / "other.wacz"),)], "path string")
    for size in (500, 1 << 20):
        got = {r.record_id: r for r in warc.read_records(warc.record_ranges(archive, size)).collect()}
        assert got.keys() == {f"urn:uuid:{100 * k + i}" for k in range(3) for i in range(30)}
        for i in range(1, 30):
            r = got[f"urn:uuid:{100 + i}"]
            assert (r.page_id, r.record_type, r.payload, r.url, r.payload_bytes) == (None, "response", b"page %d " % i * (50 * i), f"http://x/{100 + i}?\\u", len(b"page %d " % i * (50 * i)))
        assert got["urn:uuid:200"].record_type == "warcinfo" and got["urn:uuid:200"].payload == b"software: x"


def test_members_that_cannot_be_read_are_errors(spark, tmp_path):
    import gzip

    packed = {"packed": zip_bytes({"archive/a.warc.gz": b"x" * 99}, method=zipfile.ZIP_DEFLATED), "cut": zip_bytes({"archive/a.warc.gz": gzip.compress(foreign(b"response", 1, b"x" * 99))[:-9]})}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("archive/a.warc.gz", b"x" * 99, zipfile.ZIP_DEFLATED)
    packed["packed"] = out.getvalue()
    for name, match in (("packed", "not stored"), ("cut", "cut off")):
        (tmp_path / name).write_bytes(packed[name])
        with pytest.raises(Exception, match=match):
            warc.record_ranges(spark.createDataFrame([(str(tmp_path / name),)], "path string")).collect()


def test_long_member_is_scanned_in_steps():
    """No step holds more than its own bytes, whatever the member's size."""
    import gzip

    data = b"".join(gzip.compress(foreign(b"response", i, b"z" * 5000), mtime=0) for i in range(40))
    asked = []

    def read(offset, length):
        asked.append(length)
        return data[offset : offset + length]

    places = list(warc.gzip_places(warc.stream(read, 0, len(data), step=64)))
    assert max(asked) <= 64 and len(places) == 40 and sum(n for _, n in places) == len(data)
    assert all(gzip.decompress(data[a : a + n]).startswith(b"WARC/") for a, n in places)
