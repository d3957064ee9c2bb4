"""WARC records in ZIP packages, read in place.

A package is a ZIP file with stored (not compressed) members: ``archive/*.warc.gz``
whose records are gzip members of their own, and ``indexes/*.cdxj`` that say where each
record lies. The reader opens a package by its last bytes: the end record, the ZIP64
end record and its locator where sizes or counts don't fit, then the central
directory. A record is at the member's data plus the offset in its index, so it is
read by ranges of the package, and nothing is extracted. What the indexes don't tell of
is scanned record after record, by ranges as well.

Work is spread by ranges: index lines are grouped to about ``SPAN`` bytes of one member,
and only these places are shuffled. A package of any size is thus read by many tasks,
and a task holds one span. Files are opened by pyarrow, for any file system it knows.

Cases: a package that can't be read gives one row in ``directory`` with its error and
no records, as does an empty file; a member that is compressed or encrypted is listed with stored = false
and isn't read. Index lines that don't parse or point outside are passed over, and what they should tell of is
scanned. A record that doesn't unpack or parse has a null status and body and its error; the scan goes on behind
it. Keys are of any type, and are strings in records. Null urls and
bodies are written without the header or as an empty block with its mark, and come back null; urls with line ends,
blanks or braces come back as they were. Repeated rows are records of their own. Packages of an
empty table are none; names of the input beside key, url and body don't matter.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.session import fresh_path, settle

SPAN = 8 << 20
TAIL = 22 + 65535 + 20
ROLL = 256 << 20  # a package is closed beyond this size


def open_file(path: str):  # noqa: ANN201 - a pyarrow.NativeFile
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def create_file(path: str):  # noqa: ANN201 - a pyarrow.NativeFile
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    return system.open_output_stream(name)


# ---- ZIP


class Zip:
    """Writes stored members one after another; ``zip64`` asks for the large records even where they aren't needed."""

    def __init__(self, out, zip64: bool = False) -> None:  # noqa: ANN001
        self.out, self.zip64, self.at, self.entries = out, zip64, 0, []

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        """A member whose size is told after its data, in a descriptor."""
        raw = name.encode()
        self.entry = [raw, self.at, 0, 0]
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self.write(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x808, 0, 0, 0x21, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), len(extra)) + raw + extra)

    def add(self, data: bytes) -> None:
        self.entry[2] = zlib.crc32(data, self.entry[2])
        self.entry[3] += len(data)
        self.write(data)

    def end(self) -> None:
        self.write(struct.pack("<IIQQ", 0x08074B50, self.entry[2], self.entry[3], self.entry[3]))
        self.entries.append(self.entry)

    def close(self) -> None:
        start = self.at
        for name, at, crc, size in self.entries:
            big = self.zip64 or max(at, size) >= 0xFFFFFFFF
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if big else b""
            size, at = (0xFFFFFFFF, 0xFFFFFFFF) if big else (size, at)
            self.write(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x808, 0, 0, 0x21, crc, size, size, len(name), len(extra), 0, 0, 0, 0, at) + name + extra)
        size, count = self.at - start, len(self.entries)
        if self.zip64 or count > 0xFFFE or self.at >= 0xFFFFFFFF:
            end = self.at
            self.write(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, count, count, size, start))
            self.write(struct.pack("<IIQI", 0x07064B50, 0, end, 1))
            size, start, count = 0xFFFFFFFF, 0xFFFFFFFF, 0xFFFF
        self.write(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, count, count, size, start, 0))
        self.out.close()


def zip_members(file) -> list[tuple[str, bool, int, int]]:  # noqa: ANN001
    """(name, stored, offset of the data, size) of the members, from the central directory."""
    total = file.size()
    tail_at = max(0, total - TAIL)
    tail = file.read_at(total - tail_at, tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] > len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, size, start = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":
        (where,) = struct.unpack_from("<Q", tail, at - 12)
        head = file.read_at(56, where)
        if head[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory where its locator points")
        count, size, start = struct.unpack_from("<QQQ", head, 32)
    if start + size > total:
        raise ValueError("central directory beyond the end of the file")
    directory, out, p = file.read_at(size, start), [], 0
    for _ in range(count):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", directory, p + 8)
        packed, plain, n, e, c = struct.unpack_from("<IIHHH", directory, p + 20)
        (offset,) = struct.unpack_from("<I", directory, p + 42)
        name = directory[p + 46 : p + 46 + n].decode("utf-8", "replace")
        q, stop = p + 46 + n, p + 46 + n + e
        while q + 4 <= stop:  # of the ZIP64 field, only what didn't fit is there, in this order
            tag, length = struct.unpack_from("<HH", directory, q)
            if tag == 1:
                r = q + 4
                if plain == 0xFFFFFFFF:
                    (plain,), r = struct.unpack_from("<Q", directory, r), r + 8
                if packed == 0xFFFFFFFF:
                    (packed,), r = struct.unpack_from("<Q", directory, r), r + 8
                if offset == 0xFFFFFFFF:
                    (offset,) = struct.unpack_from("<Q", directory, r)
            q += 4 + length
        p = stop + c
        head = file.read_at(30, offset)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {name}")
        a, b = struct.unpack_from("<HH", head, 26)
        out.append((name, method == 0 and not flags & 1, offset + 30 + a + b, packed))
    return out


# ---- WARC


_SAFE = "".join(c for c in map(chr, range(33, 127)) if c != "%")


def field(name: str, value: str | None) -> list[str]:
    """Header lines of a value; one that a header can't hold as it is (line ends, outer blanks) is percent-encoded, and says so."""
    if value is None:
        return []
    if value == value.strip() and value.isprintable():
        return [f"{name}: {value}"]
    return [f"{name}: {quote(value, safe=_SAFE)}", f"{name}-Encoding: percent"]


def record_bytes(url: str | None, key: object, body: str | None) -> bytes:
    """One response record, a gzip member of its own."""
    html = (body or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + b"Content-Length: %d\r\n" % len(html) + (b"X-Body: null\r\n" if body is None else b"") + b"\r\n" + html
    digest = base64.b32encode(hashlib.sha1(html, usedforsecurity=False).digest()).decode()
    head = [
        "WARC/1.1",
        "WARC-Type: response",
        f"WARC-Record-ID: <urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{key}|{digest}'.encode(), usedforsecurity=False).digest())}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        *field("WARC-Target-URI", url),
        *field("WARC-Key", None if key is None else str(key)),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(block)}",
    ]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 5, mtime=0)


def parse_record(data: bytes) -> dict:
    """type, url, key, status, body, digest_ok and error of a record's bytes."""
    row = dict.fromkeys(("type", "url", "key", "status", "body", "digest_ok", "error"))
    try:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC header")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = int(fields["content-length"])
        if len(rest) < size:
            raise ValueError("record is cut short")
        url, key = (unquote(x) if x is not None and fields.get(n + "-encoding") == "percent" else x for n in ("warc-target-uri", "warc-key") for x in [fields.get(n)])
        row |= {"type": fields.get("warc-type"), "url": url, "key": key}
        if fields.get("content-type", "").startswith("application/http"):
            http, _, body = rest[:size].partition(b"\r\n\r\n")
            words = http.split(b"\r\n", 1)[0].split()
            row["status"] = int(words[1])
            row["body"] = None if b"\r\nX-Body: null" in http else body.decode("utf-8", "replace")
            told = fields.get("warc-payload-digest")
            row["digest_ok"] = told == "sha1:" + base64.b32encode(hashlib.sha1(body, usedforsecurity=False).digest()).decode() if told else None
    except (ValueError, KeyError, IndexError) as error:
        row |= {"status": None, "body": None, "error": str(error)}
    return row


def plain(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def scan_member(file, start: int, size: int) -> Iterator[tuple[int, int]]:  # noqa: ANN001
    """(offset, length) of the records of an archive member, or a part of one, that no index tells of.

    What can't be unpacked is one record, up to where the next one is found.
    """
    at, first = 0, file.read_at(min(2, size), start)
    if first == b"\x1f\x8b":
        while at < size:
            box, used = zlib.decompressobj(31), 0
            try:
                while not box.eof and at + used < size:
                    piece = file.read_at(min(1 << 20, size - at - used), start + at + used)
                    while piece and not box.eof:
                        box.decompress(piece, 1 << 22)
                        used += len(piece) - len(box.unconsumed_tail) - len(box.unused_data)
                        piece = box.unconsumed_tail
            except zlib.error:
                used = next_record(file, start + at + 1, size - at - 1) + 1
            yield at, used
            at += used
        return
    while at < size:
        head = b""
        while b"\r\n\r\n" not in head and at + len(head) < size:
            head += file.read_at(min(1 << 14, size - at - len(head)), start + at + len(head))
        stop = head.find(b"\r\n\r\n")
        length = [int(n) for k, _, n in (x.partition(b":") for x in head[:stop].split(b"\r\n")) if k.lower() == b"content-length" and n.strip().isdigit()] if stop >= 0 else []
        used = min(size - at, stop + 4 + length[0] + 4) if length else size - at
        yield at, used
        at += used


def next_record(file, start: int, size: int) -> int:  # noqa: ANN001
    """Bytes before the next gzip member that holds a WARC record; ``size`` if there is none."""
    at = 0
    while at < size:
        piece = file.read_at(min((1 << 20) + 2, size - at), start + at)
        spot = piece.find(b"\x1f\x8b\x08")
        while 0 <= spot < 1 << 20:
            try:
                if zlib.decompressobj(31).decompress(file.read_at(min(4096, size - at - spot), start + at + spot), 5) == b"WARC/":
                    return at + spot
            except zlib.error:
                pass
            spot = piece.find(b"\x1f\x8b\x08", spot + 1)
        at += 1 << 20
    return size


def index_lines(file, start: int, size: int) -> Iterator[bytes]:  # noqa: ANN001
    """Lines of an index, packed or not, read by ranges; they end where it can't be unpacked."""
    box = zlib.decompressobj(31) if file.read_at(min(2, size), start) == b"\x1f\x8b" else None
    held = b""
    for at in range(0, size, 1 << 20):
        piece = file.read_at(min(1 << 20, size - at), start + at)
        while piece:
            if box is None:
                text, piece = piece, b""
            else:
                try:
                    text = box.decompress(piece, 1 << 22)
                except zlib.error:
                    return
                piece = box.unconsumed_tail
                if box.eof:
                    piece, box = box.unused_data, zlib.decompressobj(31)
            *lines, held = (held + text).split(b"\n")
            yield from lines
    yield held


def told(line: bytes) -> tuple[str, int, int] | None:
    """(file name, offset, length) of an index line; none if it is something else."""
    parts = line.split(b" ", 2)
    try:
        at = json.loads(parts[2])
        return str(at["filename"]), int(at["offset"]), int(at["length"])
    except (ValueError, KeyError, IndexError, TypeError):
        return None


# ---- DataFrames


def write_packages(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", folder: str | None = None, zip64: bool = True) -> DataFrame:
    """Packages of the rows, at least one a task that has rows, under ``folder``; gives (package, records).

    The list is checkpointed, so a package that a lost task began isn't in it.
    """
    where = folder or fresh_path(pages.sparkSession, "packages")
    rows = pages.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{body}`").cast("string").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box, lines, name, offset = None, [], "", 0

        def finish() -> pa.RecordBatch:
            box.end()
            box.begin("indexes/index.cdxj")
            box.add("".join(sorted(lines)).encode())
            box.end()
            box.begin("datapackage.json")
            box.add(json.dumps({"profile": "data-package", "resources": [{"path": "archive/data.warc.gz"}, {"path": "indexes/index.cdxj"}]}).encode())
            box.end()
            box.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(lines)], pa.int64())], ["package", "records"])

        for batch in batches:
            for k, u, b in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if box is None:
                    name, lines, offset = f"{where}/{uuid.uuid4().hex}.zip", [], 0
                    box = Zip(create_file(name), zip64)
                    box.begin("archive/data.warc.gz")
                data = record_bytes(u, k, b)
                box.add(data)
                lines.append(f"{quote(u or '-', safe=_SAFE)} 20240101000000 " + json.dumps({"offset": offset, "length": len(data), "filename": "data.warc.gz"}) + "\n")
                offset += len(data)
                if offset > ROLL:
                    yield finish()
                    box = None
        if box is not None:
            yield finish()

    return settle(rows.mapInArrow(run, "package string, records bigint"))


def directory(packages: DataFrame) -> DataFrame:
    """(package, member, stored, offset, size, error) of every member of (package)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path in batch.column(0).to_pylist():
                try:
                    with open_file(path) as file:
                        rows += [(path, *m, None) for m in zip_members(file)]
                except (OSError, ValueError, struct.error) as error:
                    rows.append((path, None, None, None, None, f"{type(error).__name__}: {error}"))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["package", "member", "stored", "offset", "size", "error"])

    return packages.select("package").where("package is not null").distinct().mapInArrow(run, "package string, member string, stored boolean, offset bigint, size bigint, error string")


def locate(packages: DataFrame) -> DataFrame:
    """(package, start, length): the range of every record in its package, by the indexes, or by a scan where a member has none."""
    members = directory(packages).where("stored")
    own = members.groupBy("package").agg(F.collect_list(F.struct("member", "offset", "size")).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                starts, lengths = array("q"), array("q")
                archives = {m["member"].removeprefix("archive/"): m for m in listed if m["member"].startswith("archive/") and m["member"].endswith((".warc", ".warc.gz"))}
                last = [n.rpartition("/")[2] for n in archives]
                short = {n.rpartition("/")[2]: m for n, m in archives.items() if last.count(n.rpartition("/")[2]) == 1}
                ranges: dict[str, list[tuple[int, int]]] = {n: [] for n in archives}
                with open_file(path) as file:
                    for m in listed:
                        if not (m["member"].startswith("indexes/") and m["member"].endswith((".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz"))):
                            continue
                        for name, at, n in filter(None, map(told, index_lines(file, m["offset"], m["size"]))):
                            archive = archives.get(name.removeprefix("archive/")) or short.get(name.rpartition("/")[2])
                            if archive and 0 <= at and 0 < n <= archive["size"] - at:
                                ranges[archive["member"].removeprefix("archive/")].append((at, n))
                    for name, m in archives.items():
                        done = 0
                        for at, n in [*sorted(set(ranges[name])), (m["size"], 0)]:
                            if at > done:  # no line tells of these bytes
                                for a, size in scan_member(file, m["offset"] + done, at - done):
                                    starts.append(m["offset"] + done + a)
                                    lengths.append(size)
                            if n:
                                starts.append(m["offset"] + at)
                                lengths.append(n)
                            done = max(done, at + n)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(starts), pa.string()), pa.array(np.asarray(starts)), pa.array(np.asarray(lengths))], ["package", "start", "length"])

    return own.mapInArrow(run, "package string, start bigint, length bigint").distinct()


def records(packages: DataFrame) -> DataFrame:
    """(package, start, type, url, key, status, body, digest_ok, error) of every record."""
    spans = settle(locate(packages).groupBy("package", F.floor(F.col("start") / SPAN).alias("span")).agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("places")))
    count = spans.count()
    tasks = max(1, min(count, max(count // 16, 2 * packages.sparkSession.sparkContext.defaultParallelism)))  # places are few bytes, but what they name isn't
    types = {"package": pa.string(), "start": pa.int64(), "type": pa.string(), "url": pa.string(), "key": pa.string(), "status": pa.int32(), "body": pa.string(), "digest_ok": pa.bool_(), "error": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                with open_file(path) as file:
                    first, last = places[0]["start"], max(p["start"] + p["length"] for p in places)
                    near = last - first <= 4 * SPAN
                    block = file.read_at(last - first, first) if near else b""
                    for p in places:
                        data = block[p["start"] - first : p["start"] - first + p["length"]] if near else file.read_at(p["length"], p["start"])
                        try:
                            row = parse_record(plain(data))
                        except (OSError, EOFError, zlib.error) as error:
                            row = dict.fromkeys(("type", "url", "key", "status", "body", "digest_ok")) | {"error": str(error)}
                        rows.append({"package": path, "start": p["start"], **row})
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in types.items()], names=list(types))

    kinds = "package string, start bigint, type string, url string, key string, status int, body string, digest_ok boolean, error string"
    spread = spans.repartition(tasks, "package", "span").select("package", "places")
    return spread.mapInArrow(run, kinds)


def read_back(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, n_bytes, digest_ok): ``pages`` as read out of packages written from them."""
    found = records(write_packages(pages))
    return found.select(F.col("key").cast(pages.schema["page_id"].dataType).alias("page_id"), "url", F.col("body").alias("html"), F.octet_length("body").cast("bigint").alias("n_bytes"), "digest_ok")


ORACLE = """
SELECT page_id, url, html, octet_length(encode(html))::BIGINT AS n_bytes, true AS digest_ok FROM pages
"""
