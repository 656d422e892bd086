"""Web archives in ZIP packages: written by Spark's text writer, read back by ranges.

A package is a ZIP file with two stored members: ``archive/data.warc.gz``, one gzip member per WARC record, and
``indexes/index.cdxj``, one line per record (key, timestamp, JSON) with its place. As members are stored, a record is read
from the package by its offset, without extraction: end record, central directory (ZIP64 throughout), index, then ranges.

Packages of other writers are read too: any number of stored ``archive/*.warc`` or ``.warc.gz`` members, and any
``indexes/*.cdx``, ``.cdxj`` or ``.gz`` of either. An archive that no index names is scanned for its records.
"""

from __future__ import annotations

import base64
import binascii
import gzip
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT_BYTES = 1000
_BROADCAST_ROWS = 200_000
_PIECE = 1 << 18
_RANGE = 1 << 20
_BREAK = b"\n"
_MIME = {"response": "text/html", "revisit": "warc/revisit"}
_RECORDS = {"path": pa.string(), "record_id": pa.string(), "record_type": pa.string(), "url": pa.string(), "date": pa.string(),
            "payload_bytes": pa.int64(), "payload_digest": pa.string(), "intact": pa.bool_(), "refers_to_id": pa.string(),
            "payload": pa.binary()}


# ---- WARC records

def record(kind: str, page: int | None, url: str | None, payload: bytes, size: int, digest: str, refers: int | None) -> bytes:
    """One WARC record. A revisit has no payload of its own, but the size and digest of the one it repeats."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload if kind == "response" else b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
              ("WARC-Target-URI", _clean(url)), ("WARC-Payload-Digest", f"sha1:{digest}"),
              ("Content-Type", "application/http; msgtype=response")]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", f"<urn:page:{refers}>")]
    fields.append(("Content-Length", str(len(body))))
    head = "WARC/1.1\r\n" + "".join(f"{n}: {v}\r\n" for n, v in fields if v) + "\r\n"
    return head.encode() + body + b"\r\n\r\n"


def _clean(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in url or "")


def surt(url: str) -> str:
    """The key of an address in an index: its host from the last label to the first, then its path."""
    host, slash, path = url.partition("://")[2].partition("/")
    return f"{','.join(reversed(host.lower().split('.')))}){slash}{path}" if host else url or "-"


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, in lower case, and payload of each record in ``raw``: the body of an HTTP message, else the block."""
    at = 0
    while at < len(raw):
        if raw[at:at + 2] == b"\r\n":  # what ends the record before
            at += 2
            continue
        fields, start = _head(raw, at)
        at = start + int(fields["content-length"])
        if at > len(raw):
            raise ValueError("a WARC record is cut off")
        block = raw[start:at]
        if fields.get("content-type", "").startswith("application/http"):
            http, _, block = block.partition(b"\r\n\r\n")
            for line in http.decode("latin-1").split("\r\n")[1:]:
                name, _, value = line.partition(":")
                if name.lower() == "content-length":
                    fields["http-content-length"] = value.strip()
        yield fields, block


def _head(raw: bytes, at: int) -> tuple[dict[str, str], int]:
    """Header fields of the record at ``at``, and where its block starts."""
    end = raw.find(b"\r\n\r\n", at)
    if raw[at:at + 5] != b"WARC/" or end < 0:
        raise ValueError("not a WARC record")
    lines = raw[at:end].decode("utf-8", "replace").split("\r\n")
    return {n.lower(): v.strip() for n, _, v in (line.partition(":") for line in lines[1:])}, end + 4


def declared_digest(value: str | None) -> tuple[str, str] | None:
    """Algorithm and lower-case hex of a digest in a header, which may be in base 32; null if it is neither."""
    kind, _, digest = (value or "").partition(":")
    kind = kind.lower().replace("-", "")
    if kind not in ("md5", "sha1", "sha256", "sha512"):
        return None
    size = 2 * hashlib.new(kind).digest_size
    if len(digest) == size and all(c in "0123456789abcdef" for c in digest.lower()):
        return kind, digest.lower()
    try:
        found = base64.b32decode(digest.upper() + "=" * (-len(digest) % 8)).hex()
    except binascii.Error:
        return None
    return (kind, found) if len(found) == size else None


# ---- ZIP packages

class Package:
    """The bytes of a package, piece by piece, from its records. Only the index is held until the end."""

    def __init__(self) -> None:
        self.at, self.members, self.lines = 0, [], []

    def _out(self, data: bytes) -> bytes:
        self.at += len(data)
        return data

    def _open(self, name: str) -> bytes:
        self.name, self.start, self.crc, self.size = name.encode(), self.at, 0, 0
        # Stored, sizes in a descriptor behind the data.
        return self._out(struct.pack("<4s5H3I2H", b"PK\x03\x04", 45, 0x0808, 0, 0, 0x21, 0, 0xFFFFFFFF, 0xFFFFFFFF,
                                     len(self.name), 20) + self.name + struct.pack("<2H2Q", 1, 16, 0, 0))

    def _data(self, data: bytes) -> bytes:
        self.crc, self.size = zlib.crc32(data, self.crc), self.size + len(data)
        return self._out(data)

    def _close(self) -> bytes:
        self.members.append((self.name, self.start, self.crc, self.size))
        return self._out(struct.pack("<4sI2Q", b"PK\x07\x08", self.crc, self.size, self.size))

    def pieces(self, records: Iterator[tuple[dict, bytes]]) -> Iterator[bytes]:
        yield self._open(DATA)
        data = self.at
        for line, raw in records:
            packed = gzip.compress(raw, 1, mtime=0)
            place = {"filename": DATA.rpartition("/")[2], "offset": str(self.at - data), "length": str(len(packed))}
            self.lines.append(f"{surt(line.get('url') or '')} 19700101000000 {json.dumps(line | place)}")
            yield self._data(packed)
        yield self._close()
        yield self._open(INDEX)
        yield self._data("".join(line + "\n" for line in sorted(self.lines)).encode("utf-8", "surrogatepass"))
        yield self._close()
        start = self.at
        for name, offset, crc, size in self.members:
            extra = struct.pack("<2H3Q", 1, 24, size, size, offset)
            yield self._out(struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45, 0x0808, 0, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF,
                                        len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra)
        size, n, end = self.at - start, len(self.members), self.at
        yield self._out(struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, size, start))
        yield self._out(struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1))
        # The comment takes up the line break that the text writer ends a file with.
        yield self._out(struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, len(_BREAK)) + _BREAK)


def lines(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The same bytes as lines without their line breaks, a quarter of a megabyte or more each."""
    held = bytearray()
    for piece in pieces:
        held += piece
        if len(held) >= _PIECE and (cut := held.rfind(_BREAK)) >= 0:
            yield bytes(held[:cut])
            del held[:cut + 1]
    if held:
        yield bytes(held[:held.rfind(_BREAK)])


def directory(read, length: int) -> dict[str, tuple[int, int]]:
    """Offset and size of the data of each stored member. ``read(offset, n)`` reads a range of the package."""
    tail_at = max(0, length - 65_557 - 20)
    tail = read(tail_at, length - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, n, size, start, _ = struct.unpack("<4s4H2IH", tail[at:at + 22])
    locator = tail[at - 20:at] if at >= 20 else b""
    if locator[:4] == b"PK\x06\x07":
        end = read(struct.unpack("<4sIQI", locator)[2], 56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        n, size, start = struct.unpack("<4sQ2H2I4Q", end)[7:10]
    entries, found, at = read(start, size), {}, 0
    for _ in range(n):
        if entries[at:at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method = struct.unpack_from("<H", entries, at + 10)[0]
        packed, plain, name_n, extra_n, comment_n = struct.unpack_from("<2I3H", entries, at + 20)
        offset = struct.unpack_from("<I", entries, at + 42)[0]
        name = entries[at + 46:at + 46 + name_n].decode()
        extra, place = entries[at + 46 + name_n:at + 46 + name_n + extra_n], 0
        while place + 4 <= len(extra):
            kind, extra_size = struct.unpack_from("<2H", extra, place)
            if kind == 1:  # the 64-bit values of those fields that are full
                values = iter(struct.unpack_from(f"<{extra_size // 8}Q", extra, place + 4))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                offset = next(values) if offset == 0xFFFFFFFF else offset
            place += 4 + extra_size
        if method == 0:
            local = read(offset, 30)
            found[name] = (offset + 30 + sum(struct.unpack("<2H", local[26:30])), packed)
        at += 46 + name_n + extra_n + comment_n
    return found


def _open(path: str):
    """A file of any store that Arrow knows, for reads of ranges."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    store, place = fs.FileSystem.from_uri(path)
    return store.open_input_file(place)


# ---- Spark jobs

def payloads(pages: DataFrame, min_bytes: int = REVISIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """Pages with their ``payload``, its size and digest; and the digests that repeat, with the page that others revisit.

    Only sizes and digests are grouped.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"),
                        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn(
        "payload_digest", F.sha1("payload"))
    repeated = rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(
        F.max("page_id").alias("first_page"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        F.col("payload_digest").alias("of_digest"), "first_page")
    return rows, repeated


def write_archives(pages: DataFrame, path: str, min_bytes: int = REVISIT_BYTES) -> None:
    """Write one package for each task, through Spark's own writer, so lost tasks leave nothing behind."""
    rows, repeated = payloads(pages, min_bytes)
    if repeated.count() <= _BROADCAST_ROWS:  # else both sides are shuffled
        repeated = F.broadcast(repeated)
    joined = rows.join(repeated, (F.col("payload_digest") == F.col("of_digest")) & (F.col("payload_bytes") >= min_bytes), "left")
    other = F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    planned = joined.select(
        "page_id", "url", F.when(other, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "payload_bytes",
        "payload_digest", F.when(other, F.col("first_page")).alias("refers_to"), other.alias("is_revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in batches:
                names = ("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to", "is_revisit")
                for page, url, payload, size, digest, refers, revisit in zip(
                        *(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)):
                    kind = "revisit" if revisit else "response"
                    raw = record(kind, page, url, payload, size, digest, refers)
                    yield {"url": _clean(url), "digest": f"sha1:{digest}", "mime": _MIME[kind]}, raw

        for line in lines(Package().pieces(records())):
            yield pa.RecordBatch.from_pydict({"line": pa.array([line], pa.binary())})

    planned.mapInArrow(run, "line binary").select(F.col("line").cast("string").alias("value")).write.option(
        "lineSep", _BREAK.decode()).text(path)


def _indexed(read, members: dict[str, tuple[int, int]]) -> dict[str, list[tuple[int, int]]]:
    """Offset and length of the records that the indexes name, for each archive."""
    found: dict[str, set] = {}
    for name, (start, size) in members.items():
        plain = name.removesuffix(".gz")
        if not name.startswith("indexes/") or not plain.endswith((".cdx", ".cdxj")):
            continue
        raw = read(start, size)
        raw = raw if plain == name else gzip.decompress(raw)
        for line in raw.decode("utf-8", "surrogatepass").splitlines():
            at = line.find("{")
            if at < 0:  # a header, or the older form with columns
                continue
            entry = json.loads(line[at:])
            if {"filename", "offset", "length"} <= entry.keys():
                found.setdefault(f"archive/{entry['filename']}", set()).add((int(entry["offset"]), int(entry["length"])))
    return {name: sorted(places) for name, places in found.items()}


def _scan(read, size: int, packed: bool) -> Iterator[tuple[int, int]]:
    """Offset and length of each gzip member, or each plain record, of an archive, read piece by piece."""
    at = 0
    while at < size:
        place = at
        if packed:
            member = zlib.decompressobj(31)
            while not member.eof:
                piece = read(at, min(_PIECE, size - at))
                if not piece:
                    raise ValueError("an archive ends within a gzip member")
                member.decompress(piece)
                at += len(piece) - len(member.unused_data)
        else:
            piece = read(at, min(_PIECE, size - at))
            blank = len(piece) - len(piece.lstrip(b"\r\n"))
            if blank == len(piece):
                at += blank
                continue
            place = at + blank
            fields, start = _head(read(place, min(_PIECE, size - place)), 0)
            at = place + start + int(fields["content-length"])
        yield place, at - place


def index(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``packed`` (whether in gzip members), ``offset`` and ``lengths`` of ranges of neighbouring records, of about
    a megabyte each."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with _open(place) as file:
                    read = lambda offset, n: file.read_at(n, offset)
                    members = directory(read, length)
                    indexed, found = _indexed(read, members), []
                    for name, (start, size) in sorted(members.items()):
                        packed = name.endswith(".warc.gz")
                        if not name.startswith("archive/") or not (packed or name.endswith(".warc")):
                            continue
                        within = lambda offset, n: read(start + offset, n)
                        begin, end, sizes = 0, 0, []
                        for offset, n in indexed.get(name) or _scan(within, size, packed):
                            if sizes and (offset != end or offset + n - begin > _RANGE):
                                found.append((place, packed, start + begin, sizes))
                                sizes = []
                            begin, end = offset if not sizes else begin, offset + n
                            sizes.append(n)
                        if sizes:
                            found.append((place, packed, start + begin, sizes))
                if found:
                    yield pa.RecordBatch.from_pydict({
                        "path": [f[0] for f in found], "packed": [f[1] for f in found],
                        "offset": pa.array([f[2] for f in found], pa.int64()),
                        "lengths": pa.array([f[3] for f in found], pa.list_(pa.int64()))})

    return files.mapInArrow(run, "path string, packed boolean, offset long, lengths array<long>")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the packages below ``path``, read by range: ``path`` of the package, ``record_id``, ``record_type``, ``url``,
    ``date``, ``payload_bytes``, ``payload_digest`` (hex SHA-1), ``intact``, ``refers_to_id`` and ``payload``.

    ``intact`` tells whether the payload has the digest that the record names, and is null where it names none that is
    known. A revisit has the size and digest that it gives for the payload it repeats, null where it gives none, and a null
    payload. Fields that a record lacks are null. A gzip member is held in full, a plain record too. A file that is no ZIP
    package, or an archive that is cut off, ends the job.
    """
    ranges = index(spark, path).repartition(max(2 * spark.sparkContext.defaultParallelism, 8))

    def row(place: str, fields: dict[str, str], payload: bytes) -> tuple:
        declared, revisit = declared_digest(fields.get("warc-payload-digest")), fields.get("warc-type") == "revisit"
        if revisit:
            size = fields.get("http-content-length")
            size, intact = int(size) if size and size.isdigit() else None, None
            digest = declared[1] if declared and declared[0] == "sha1" else None
        else:
            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
            intact = hashlib.new(declared[0], payload).hexdigest() == declared[1] if declared else None
        return (place, fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"),
                fields.get("warc-date"), size, digest, intact, fields.get("warc-refers-to"), None if revisit else payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, packed, offset, sizes in zip(*(c.to_pylist() for c in batch.columns)):
                with _open(place) as file:
                    raw, found, at = file.read_at(sum(sizes), offset), [], 0
                for size in sizes:
                    part = raw[at:at + size]
                    at += size
                    found += [row(place, *x) for x in parse(gzip.decompress(part) if packed else part)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*found), _RECORDS.values())],
                                                     names=list(_RECORDS))

    return ranges.mapInArrow(run, "path string, record_id string, record_type string, url string, date string, "
                                  "payload_bytes long, payload_digest string, intact boolean, refers_to_id string, payload binary")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``, ``url`` and ``payload`` of each
    record that ``write_archives`` wrote below ``path``. A response whose payload does not have the digest that its record
    names is an error. A revisit has the size and digest of the payload that it repeats, and a null payload.
    """
    page = lambda column: F.regexp_extract(column, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    rows = read_records(spark, path).withColumn("payload_digest", F.when(
        F.coalesce("intact", F.col("record_type") == "revisit"), F.col("payload_digest")).otherwise(F.raise_error(
            F.concat(F.lit("the payload does not match its digest: "), F.coalesce("record_id", F.lit("?"))))))
    return rows.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       page("refers_to_id").alias("refers_to"), "url", "payload")


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to packages below ``path``, and read all records back, without payloads.

    A null html counts as empty. Of pages with equal payloads of ``REVISIT_BYTES`` or more, that of the largest id is
    the response, and the others refer to it; rows that share the largest id are all responses. A null id is never the
    largest, unless there is no other: then all are responses. A null url is left out of the record. Repeated rows give
    a record each, an empty table none.
    """
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
