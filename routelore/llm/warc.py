"""WARC records in ZIP-packaged archives: written by tasks, read back by byte ranges.

An archive is a ZIP file whose members are stored, not deflated: ``archive/data.warc.gz`` (one gzip member per WARC record) and
``indexes/index.cdxj`` (one line per record with its place). Reading takes two steps: the end records and the central directory,
both also in their ZIP64 form, give the place of every member, and the indexes give ranges of records; then the ranges are dealt
out and read where they lie. Nothing is extracted, and no archive is read whole. Files are reached through ``pyarrow.fs``, by the
path's own scheme; each task attempt writes under a name of its own, and only the files of committed tasks are listed.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from routelore.llm.shared import salted_join
from routelore.sources.staging import scratch_folder, stage_table

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PAGE = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records after which a task starts the next archive, and bytes read at once.
ARCHIVE_BYTES, RANGE_BYTES = 64 << 20, 1 << 20
LEAST_BYTES = 1000


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def with_record_types(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html (null as empty) with payload_digest (SHA-1) and refers_to.

    Of equal payloads of at least ``least_bytes`` bytes the record with the largest page_id is the response and the others refer to
    it. Rows that repeat the largest page_id are all responses; a null page_id counts below all others.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    own = pages.select("page_id", "url", payload.alias("payload")).withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    same = own.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
    same = stage_table(same.where("n > 1").drop("n"), "equal_payloads")
    typed = salted_join(own, same, ["payload_digest", "payload_bytes"], ["page_id", "url"])
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    return typed.select("page_id", "url", "payload", "payload_digest", refers.alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit that has the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    name = "" if page_id is None else page_id
    fields = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z",
              f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        fields.append("WARC-Target-URI: " + json.dumps(url)[1:-1])
    if refers_to is not None:
        fields += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """The fields of a WARC record and its payload (None for a revisit), with the payload's size by the HTTP head.

    record_id and refers_to_id are kept as written, less their brackets; page_id and refers_to are the numbers in ids of this writer's
    records, whose payloads must have their digest. Records of other kinds have their whole block as payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if len(block) < int(fields["content-length"]):
        raise ValueError("the record is cut off")
    kind, size, payload = fields["warc-type"], None, block
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    digest = fields.get("warc-payload-digest")
    if digest and digest.startswith("sha1:") and len(digest) == 37:
        digest = base64.b32decode(digest[5:].upper()).hex()
    ids = {k: fields[k].strip("<>") if k in fields else None for k in ("warc-record-id", "warc-refers-to")}
    own = (ids["warc-record-id"] or "").startswith(PAGE)
    page = lambda k: int(ids[k][len(PAGE):]) if (ids[k] or "").startswith(PAGE) and ids[k] != PAGE else None
    if own and kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("payload differs from its digest")
    url = fields.get("warc-target-uri")
    payload = None if kind == "revisit" else payload
    return {"page_id": page("warc-record-id"), "url": json.loads(f'"{url}"') if own and url is not None else url, "payload": payload,
            "payload_bytes": size if kind == "revisit" else len(payload), "payload_digest": digest, "record_type": kind, "refers_to": page("warc-refers-to"),
            "record_id": ids["warc-record-id"], "refers_to_id": ids["warc-refers-to"]}


def write_archives(typed: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, zip64: bool = False) -> DataFrame:
    """Writes the records of ``with_record_types`` and returns the written list of archives (path, records)."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        system.create_dir(base, recursive=True)

        def close(data: list[bytes], lines: list[str]) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.wacz"
            with system.open_output_stream(f"{base}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                for member, parts in ((DATA, data), (INDEX, [x.encode() for x in lines])):
                    with z.open(zipfile.ZipInfo(member), "w", force_zip64=zip64) as m:
                        for part in parts:
                            m.write(part)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(lines)], pa.int64())], names=["path", "records"])

        data, lines, size = [], [], 0
        for b in batches:
            for page_id, url, payload, digest, refers_to in zip(*(b.column(c) for c in ("page_id", "url", "payload", "payload_digest", "refers_to"))):
                raw = record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py())
                gzip = zlib.compressobj(5, zlib.DEFLATED, 31)
                part = gzip.compress(raw) + gzip.flush()
                lines.append(json.dumps({"filename": DATA.rpartition("/")[2], "page": page_id.as_py(), "offset": size, "length": len(part)}) + "\n")
                data.append(part)
                size += len(part)
                if size >= archive_bytes:
                    yield close(data, lines)
                    data, lines, size = [], [], 0
        if lines:
            yield close(data, lines)

    return stage_table(typed.mapInArrow(written, "path string, records long"), "archives")


def directory(read, size: int) -> dict[str, tuple[int, int, int]]:
    """Of every member where its data lies (offset, bytes) and how it is packed (0: stored, 8: deflated), from the central directory.
    ``read(offset, length)`` gives bytes."""
    tail_at = max(0, size - (22 + 65535))
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, total, length, start, _ = struct.unpack("<HHHHLLH", tail[at + 4 : at + 22])
    locator = tail[at - 20 : at] if at >= 20 else b""
    if locator[:4] == b"PK\x06\x07":
        (end64,) = struct.unpack("<Q", locator[8:16])
        total, length, start = struct.unpack("<QQQ", read(end64, 56)[32:56])
    entries, found, p = read(start, length), {}, 0
    for _ in range(total):
        if entries[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed, plain, n, extra, comment = struct.unpack("<H8xLLHHH", entries[p + 10 : p + 34])
        (local,) = struct.unpack("<L", entries[p + 42 : p + 46])
        name = entries[p + 46 : p + 46 + n].decode()
        q, stop = p + 46 + n, p + 46 + n + extra
        while q + 4 <= stop:
            tag, m = struct.unpack("<HH", entries[q : q + 4])
            if tag == 1:  # ZIP64: only the fields that did not fit, in this order
                wide = iter(struct.unpack(f"<{m // 8}Q", entries[q + 4 : q + 4 + m // 8 * 8]))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                local = next(wide) if local == 0xFFFFFFFF else local
            q += 4 + m
        head = read(local, 30)
        found[name] = (local + 30 + sum(struct.unpack("<HH", head[26:30])), packed, method)
        p = stop + comment
    return found


def members(read, size: int) -> dict[str, tuple[int, int]]:
    """Place of the data (offset, length) of every stored member."""
    return {name: (at, length) for name, (at, length, method) in directory(read, size).items() if method == 0}


def stream(read, offset: int, length: int, method: int = 0, step: int = RANGE_BYTES) -> Iterator[bytes]:
    """A member's bytes in steps, inflated if it is deflated."""
    inflate = zlib.decompressobj(-15) if method == 8 else None
    for at in range(offset, offset + length, step):
        part = read(at, min(step, offset + length - at))
        yield inflate.decompress(part) if inflate else part


def index_places(read, found: dict[str, tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """Member, offset and length of every record that the archive's indexes list, read in steps.

    A line is JSON, after sort key and time if it has these; ``filename`` names a member of ``archive/`` (it may be left out where there
    is one only). Indexes may be gzipped or deflated."""
    data = [n for n in found if n.startswith("archive/")]
    for name, (offset, length, method) in found.items():
        if not name.startswith("indexes/") or not name.endswith((".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz")):
            continue
        parts, rest = stream(read, offset, length, method), b""
        for part in plain_text(parts) if name.endswith(".gz") else parts:
            *lines, rest = (rest + part).split(b"\n")
            yield from filter(None, (place(line, data) for line in lines))
        yield from filter(None, [place(rest, data)])


def place(line: bytes, data: list[str]) -> tuple[str, int, int] | None:
    at = line.find(b"{")
    if at < 0 or line.startswith(b"!"):  # a head line or blank
        return None
    own = json.loads(line[at:])
    member = "archive/" + own["filename"].rpartition("/")[2] if "filename" in own else data[0] if len(data) == 1 else None
    if member not in data:
        raise ValueError(f"an index line names no member of the archive: {line[:200]!r}")
    return member, int(own["offset"]), int(own["length"])


def plain_text(parts: Iterator[bytes]) -> Iterator[bytes]:
    """The text of concatenated gzip members."""
    gunzip = zlib.decompressobj(31)
    for part in parts:
        while part:
            yield gunzip.decompress(part)
            part = gunzip.unused_data
            gunzip = zlib.decompressobj(31) if gunzip.eof else gunzip


def gzip_places(parts: Iterator[bytes]) -> Iterator[tuple[int, int]]:
    """Offset and length of every gzip member, found by inflating the stream step by step; a step's text is dropped at once."""
    gunzip, start, at = zlib.decompressobj(31), 0, 0
    for part in parts:
        while part:
            left = len(part)
            gunzip.decompress(part)
            part = gunzip.unused_data
            at += left - len(part)
            if gunzip.eof:
                yield start, at - start
                gunzip, start = zlib.decompressobj(31), at
    if at > start:
        raise ValueError("the last gzip member is cut off")


def plain_places(read, offset: int, length: int) -> Iterator[tuple[int, int]]:
    """Offset and length of every record of an uncompressed member, from one head to the next."""
    at = 0
    while at < length:
        head = b""
        while b"\r\n\r\n" not in head:
            more = read(offset + at + len(head), min(4096, length - at - len(head)))
            if not more:
                raise ValueError("the last record is cut off")
            head += more
        head = head[: head.index(b"\r\n\r\n") + 4]
        size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        yield at, len(head) + size + 4
        at += len(head) + size + 4


def record_ranges(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Byte ranges (path, offset, length) of whole records, about ``range_bytes`` each, from the archives' indexes.

    A member that no index names is scanned in steps for its records. Members must be stored: a deflated one is an error, as
    ranges of it can't be read."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column("path").to_pylist()):
            system, name = opened(path)
            with system.open_input_file(name) as f:
                read = lambda offset, length: f.read_at(length, offset)
                found = directory(read, f.size())
                data = {n: v for n, v in found.items() if n.startswith("archive/") and not n.endswith("/")}
                for n, (_, _, method) in data.items():
                    if method != 0:
                        raise ValueError(f"{path}: {n} is not stored")
                rows, open_, named = [], {}, set()

                def listed() -> Iterator[tuple[str, int, int]]:
                    for found_place in index_places(read, found):
                        named.add(found_place[0])
                        yield found_place
                    for n, (at, length, _) in data.items():
                        if n not in named:
                            scan = gzip_places(stream(read, at, length)) if n.endswith(".gz") else plain_places(read, at, length)
                            yield from ((n, *x) for x in scan)

                for member, offset, length in listed():
                    first, size = open_.get(member, (offset, 0))
                    if size and (size + length > range_bytes or offset != first + size):
                        rows.append((data[member][0] + first, size))
                        first, size = offset, 0
                    open_[member] = (first, size + length)
                    if len(rows) >= 10_000:
                        yield batch(path, rows)
                        rows = []
                rows += [(data[n][0] + first, size) for n, (first, size) in open_.items()]
                if rows:
                    yield batch(path, rows)

    def batch(path: str, rows: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), *(pa.array(c, pa.int64()) for c in zip(*rows))], names=["path", "offset", "length"])

    return archives.select("path").mapInArrow(ranges, "path string, offset long, length long")


def read_records(ranges: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the ranges: page_id, url, payload (on request; null for revisits), payload_bytes, payload_digest,
    record_type, refers_to, and both ids as text. Digests of this writer's payloads are checked."""
    names = ["page_id", "url", *["payload"] * payload, "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "refers_to_id"]
    types = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "record_id": pa.string(), "refers_to_id": pa.string()}
    sql = {"page_id": "long", "url": "string", "payload": "binary", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long", "record_id": "string", "refers_to_id": "string"}

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, offset, length in zip(*(b.column(c).to_pylist() for c in ("path", "offset", "length"))):
                system, name = opened(path)
                with system.open_input_file(name) as f:
                    raw = f.read_at(length, offset)
                rows = []
                while raw:
                    if raw.startswith(b"WARC/"):
                        size = next(plain_places(lambda at, n: raw[at : at + n], 0, len(raw)))[1]  # noqa: B023
                        rows.append(parsed(raw[:size]))
                        raw = raw[size:]
                        continue
                    gunzip = zlib.decompressobj(31)
                    rows.append(parsed(gunzip.decompress(raw)))
                    raw = gunzip.unused_data
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types[c]) for c in names], names=names)

    return ranges.mapInArrow(records, ", ".join(f"{c} {sql[c]}" for c in names))


def round_trip(pages: DataFrame, folder: str | None = None, payload: bool = True) -> DataFrame:
    """Writes the pages as archives below ``folder`` (by default the session's shared folder) and reads all records back.

    Null html is an empty payload; repeated pages give repeated records; other columns are left out; an empty table gives none.
    """
    folder = folder or f"{scratch_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    archives = write_archives(with_record_types(pages), folder)
    ranges = stage_table(record_ranges(archives), "record_ranges")
    parts = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return read_records(ranges.repartition(parts, "path", "offset"), payload)
