"""Legacy archives: ARC files are written, read by version, converted to WARC and read back.

An ARC file begins with a version block, whose header line has the declared length as its last field.  Version 1
names five fields per record and version 2 ten; a record is its header line and as many bytes as declared.
The converter gives each record what WARC asks for: a type (warcinfo, response, resource), a record
identifier made from its address, time and block, the time in the new format, and SHA-256 digests of block and
payload.  Records with a payload of at least ``REVISIT_BYTES`` that an earlier record has too become revisits.

Archives are bounded in size, one per output file, and written and read through Spark's own sources
(text and binary files), so any store that Spark reaches will do and a lost task is done again.  Each record is a
gzip member of its own, so it can be sought and read alone.

Defined results: a null text is an empty payload; white space in an address is percent-encoded, a null address
is ``urn:none``; a null id is written as an empty header and comes after all others; of repeated rows
with one id and payload none revisits the other, and each has its own record identifier; a header line that cannot be
read (no declared length, a version that is not known, too few fields) is skipped, up to the next that can, and
counted; a record cut off by the end of its file has what is there; a page id or length that is no number of 64 bits is null
or 0; other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwatch.llm.common import keep, keyed_join
from postwatch.session import new_folder

#: Bytes of an archive before compression, unless one record has more.
ARCHIVE_BYTES = 32 << 20
REVISIT_BYTES = 100
#: The fields of a record's header line in both versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
PLACE = "X-Page-Id"
NO_ADDRESS = "urn:none"
#: Closes every output file: the last byte of a gzip member, the highest of the size of a member under 16 MB.
LAST_BYTE = "\0"
#: Bytes of a compressed archive that are read at once.
PART = 4096


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def number(text: bytes | None) -> int | None:
    """A whole number of 64 bits; null for anything else."""
    if not text or not re.fullmatch(rb"[+-]?[0-9]{1,19}", text):
        return None
    found = int(text)
    return found if -(1 << 63) <= found < 1 << 63 else None


def packed(records: list[bytes]) -> pa.RecordBatch:
    """One archive: a gzip member per record, without the last byte."""
    members = [gzip.compress(r, 1, mtime=0) for r in records]
    if members[-1][-1]:
        members.append(gzip.compress(b"", 1, mtime=0))
    return pa.RecordBatch.from_arrays([pa.array([b"".join(members)[:-1]], pa.binary())], ["archive"])


def unpacked(data: bytes) -> bytes:
    """All members of a gzip file, up to what is none; data that is none at all is given back as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    view, at, out = memoryview(data), 0, []
    while at < len(view):
        # Read in small parts, as what a member leaves of a part is copied.
        member = zlib.decompressobj(31)
        while not member.eof and at < len(view):
            part = view[at : at + PART]
            try:
                out.append(member.decompress(part))
            except zlib.error:
                return b"".join(out)
            at += len(part)
        at -= len(member.unused_data)
    return b"".join(out)


def _partition() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def _address(url: str | None) -> bytes:
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], (url or "").encode("utf-8", "replace")) or NO_ADDRESS.encode()


def arc_start(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 postwatch\n{FIELDS[version]}\n".encode()
    if version == 1:
        return f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body)}\n".encode() + body
    return f"filedesc://{name} 0.0.0.0 {date} text/plain 200 - - 0 {name} {len(body)}\n".encode() + body


def arc_record(version: int, url: str | None, ip: str, date: str, kind: str, block: bytes, offset: int, name: str) -> bytes:
    head = b"%s %s %s %s" % (_address(url), ip.encode(), date.encode(), kind.encode())
    if version == 2:
        head += b" 200 %s - %d %s" % (_sha(block)[:32].encode(), offset, name.encode())
    return b"%s %d\n%s" % (head, len(block), block)


def http_block(page_id, html: bytes) -> bytes:
    head = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n"
        f"{PLACE}: {'' if page_id is None else page_id}\r\n\r\n"
    )
    return head.encode() + html


def arc_files(batches, date: str, size: int):
    """Archives of a task's pages, versions 1 and 2 in turn."""
    made, held, n = 0, [], 0
    for batch in batches:
        ids, urls, pages = (batch.column(k).to_pylist() for k in ("page_id", "url", "html"))
        for page_id, url, html in zip(ids, urls, pages):
            block = http_block(page_id, (html or "").encode("utf-8", "replace"))
            if held and n + len(block) > size:
                yield packed(held)
                made, held, n = made + 1, [], 0
            # Spark names a task's files by its partition and their number.
            version, name = 1 + made % 2, f"part-{_partition():05d}-c{made:03d}"
            if not held:
                held.append(arc_start(version, name, date) + b"\n")
                n = len(held[0])
            held.append(arc_record(version, url, "0.0.0.0", date, "text/html", block, n, name) + b"\n")
            n += len(held[-1])
    if held:
        yield packed(held)


def arc_records(data: bytes, skipped: list[int] | None = None):
    """Records ``(url, ip, date, content type, block, offset)`` of an archive, the version block left out.

    The places of lines that cannot be read are added to ``skipped``; nothing is raised for them.
    """
    at, fields_of = 0, len(FIELDS[1].split())
    while at < len(data):
        stop = data.find(b"\n", at)
        line = data[at:] if stop < 0 else data[at:stop]
        if stop >= 0 and line.startswith(b"filedesc://"):
            declared = line.rsplit(b" ", 1)[-1]
            length = int(declared) if declared.isdigit() and len(declared) < 19 else None
            body = data[stop + 1 : stop + 1 + (length or 0)].split(b"\n")
            version = number(body[0].split(b" ", 1)[0])
            if version in FIELDS:
                fields_of = len(FIELDS[version].split())
                at = stop + 1 + length
                continue
            if length and len(body) > 1 and body[1].startswith(b"URL ") and body[1].endswith(b" Archive-length"):
                # A version that is not known, but says what its lines hold.
                fields_of = len(body[1].split())
        else:
            fields = line.rsplit(b" ", fields_of - 1)
            if stop >= 0 and len(fields) == fields_of and fields[-1].isdigit() and len(fields[-1]) < 19:
                length = int(fields[-1])
                url, ip, date, kind = (x.decode("utf-8", "replace") for x in fields[:4])
                yield url, ip, date, kind, data[stop + 1 : stop + 1 + length], at
                at = stop + 1 + length
                continue
        if line.strip() and skipped is not None:
            skipped.append(at)
        if stop < 0:
            return
        at = stop + 1


def parse_arc(data: bytes):
    """Records ``(url, ip, date, content type, block)`` of an archive."""
    for *record, _ in arc_records(data):
        yield tuple(record)


def split_http(block: bytes) -> tuple[bytes, bytes] | None:
    """Header and payload of an HTTP response."""
    if not block.startswith(b"HTTP/"):
        return None
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[: end + 4], block[end + 4 :])


def header_value(head: bytes, name: str) -> bytes | None:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].strip() if m else None


def described(url: str, date: str, block: bytes, at: str) -> dict:
    """What WARC asks for besides what ARC has; ``at`` is the archive and the record's offset in it."""
    http = split_http(block)
    payload = http[1] if http else block
    place = header_value(http[0], PLACE) if http else None
    stamp = (date + "00000000000000")[:14] if date.isdigit() else "19700101000000"
    stamp = f"{stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:]}Z"
    return {
        "record": str(uuid.uuid5(uuid.NAMESPACE_URL, f"{url} {stamp} {_sha(block)} {at}")),
        "url": url, "stamp": stamp, "kind": "response" if http else "resource",
        "place": number(place),
        "digest": _sha(payload), "size": len(payload),
    }


NARROW = "record string, url string, stamp string, kind string, place long, digest string, size long"
NARROW_TYPES = [
    ("record", pa.string()), ("url", pa.string()), ("stamp", pa.string()), ("kind", pa.string()),
    ("place", pa.int64()), ("digest", pa.string()), ("size", pa.int64()),
]


#: Kind of a row of the index that counts, as its size, the lines of an archive that could not be read.
SKIPPED = "skipped"


def _unpacked(batch):
    """Name and bytes of each archive."""
    for path, x in zip(batch.column("path").to_pylist(), batch.column("content")):
        data = x.as_py()
        yield path.rsplit("/", 1)[-1], unpacked(data)


def arc_index(batches):
    for batch in batches:
        for name, data in _unpacked(batch):
            skipped: list[int] = []
            rows = [described(url, date, block, f"{name} {at}") for url, _, date, _, block, at in arc_records(data, skipped)]
            if skipped:
                rows.append(dict.fromkeys((n for n, _ in NARROW_TYPES), None) | {"kind": SKIPPED, "size": len(skipped)})
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in NARROW_TYPES], [n for n, _ in NARROW_TYPES])


def arc_blocks(batches):
    names = ["record", "stamp", "ip", "content_type", "url", "kind", "digest", "size", "place", "block"]
    for batch in batches:
        for name, data in _unpacked(batch):
            held, n = [], 0
            for url, ip, date, kind, block, at in arc_records(data):
                d = described(url, date, block, f"{name} {at}")
                held.append((d["record"], d["stamp"], ip, kind, url, d["kind"], d["digest"], d["size"], d["place"], block))
                n += len(block)
                if n > 4 << 20:
                    yield _blocks(held, names)
                    held, n = [], 0
            if held:
                yield _blocks(held, names)


def _blocks(rows, names):
    types = [pa.string()] * 7 + [pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


#: Fixed value: what closes a record.
CLOSE = b"\r\n\r\n"


def warc_record(row: dict) -> bytes:
    """One record, without the two line ends that close it."""
    block, kind = row["block"], row["kind"]
    extra = ""
    if row["first_record"] is not None:
        kind = "revisit"
        block = split_http(block)[0] if split_http(block) else b""
        extra = (
            f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:uuid:{row['first_record']}>\r\n"
            f"WARC-Refers-To-Target-URI: {row['first_url']}\r\nWARC-Refers-To-Date: {row['first_stamp']}\r\n"
        )
    content = "application/http; msgtype=response" if row["kind"] == "response" else row["content_type"]
    head = (
        f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{row['record']}>\r\n"
        f"WARC-Target-URI: {row['url']}\r\nWARC-Date: {row['stamp']}\r\nWARC-IP-Address: {row['ip']}\r\n{extra}"
        f"WARC-Payload-Digest: sha256:{row['digest']}\r\nWARC-Block-Digest: sha256:{_sha(block)}\r\n"
        f"Content-Type: {content}\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return head.encode() + block


def warc_files(batches, size: int):
    held, n, made = [], 0, 0

    def start(first: str):
        body = b"software: postwatch\r\nformat: WARC File Format 1.0\r\n"
        name = uuid.uuid5(uuid.NAMESPACE_URL, f"warcinfo {_partition()} {made} {first}")
        return (
            f"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n"
            f"Content-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
        ).encode() + body + CLOSE

    for batch in batches:
        for row in batch.to_pylist():
            record = warc_record(row) + CLOSE
            if held and n + len(record) > size:
                yield packed(held)
                held, n, made = [], 0, made + 1
            if not held:
                held.append(start(row["record"]))
            held.append(record)
            n += len(record)
    if held:
        yield packed(held)


def parse_warc(data: bytes):
    """Records ``(header, block)`` of an archive, by their declared lengths."""
    at = 0
    while True:
        at = data.find(b"WARC/1.", at)
        end = data.find(b"\r\n\r\n", at) if at >= 0 else -1
        if end < 0:
            return
        head = data[at : end + 2]
        length = number(header_value(head, "Content-Length"))
        if length is None or length < 0:
            at += 7
            continue
        at = end + 4 + length
        yield head, data[end + 4 : at]


READ = "record string, url string, stamp string, kind string, refers string, place long, size long, digest string, whole boolean"
READ_TYPES = [
    ("record", pa.string()), ("url", pa.string()), ("stamp", pa.string()), ("kind", pa.string()), ("refers", pa.string()),
    ("place", pa.int64()), ("size", pa.int64()), ("digest", pa.string()), ("whole", pa.bool_()),
]


def warc_rows(batches):
    def text(x):
        return None if x is None else x.decode("utf-8", "replace")

    def bare(x):
        return None if x is None else x.removeprefix(b"<urn:uuid:").removesuffix(b">").decode("utf-8", "replace")

    for batch in batches:
        for _, data in _unpacked(batch):
            rows = []
            for head, block in parse_warc(data):
                kind = text(header_value(head, "WARC-Type"))
                if kind == "warcinfo":
                    continue
                http = split_http(block)
                digest = text(header_value(head, "WARC-Payload-Digest") or b"").removeprefix("sha256:")
                place = header_value(http[0], PLACE) if http else None
                size = len(http[1] if http else block)
                if kind == "revisit" and http:
                    size = max(0, number(header_value(http[0], "Content-Length")) or 0)
                whole = kind == "revisit" or digest == _sha(http[1] if http else block)
                rows.append((
                    bare(header_value(head, "WARC-Record-ID")), text(header_value(head, "WARC-Target-URI")),
                    text(header_value(head, "WARC-Date")), kind, bare(header_value(head, "WARC-Refers-To")),
                    number(place), size, digest, whole,
                ))
            columns = zip(*rows) if rows else [[]] * len(READ_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, READ_TYPES)], [n for n, _ in READ_TYPES])


def _write(archives: DataFrame, folder: str) -> None:
    """One file per row: its bytes and the last one."""
    (
        archives.select(F.col("archive").cast("string"))
        .write.option("lineSep", LAST_BYTE).option("maxRecordsPerFile", 1).option("compression", "none").text(folder)
    )


def _files(spark, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select("path", "content")


def write_arc(pages: DataFrame, folder: str, date: str = "20200101000000", size: int = ARCHIVE_BYTES) -> None:
    """Legacy archives of ``pages (page_id, url, html)``."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    _write(rows.mapInArrow(lambda b: arc_files(b, date, size), "archive binary"), folder)


def convert(spark, arc_folder: str, warc_folder: str, revisit_bytes: int = REVISIT_BYTES, size: int = ARCHIVE_BYTES) -> int:
    """Convert all legacy archives in a folder; gives the number of lines that could not be read.

    The earliest record of a payload is the one with the smallest page id in its HTTP header (none: last),
    then the smallest time and identifier.  Only narrow rows are grouped, and the archives are read twice.
    """
    index = keep(_files(spark, arc_folder).mapInArrow(arc_index, NARROW), "arc-index")
    skipped = index.filter(F.col("kind") == SKIPPED).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    index = index.filter(F.col("kind") != SKIPPED)
    order = F.struct(F.col("place").isNull().alias("last"), "place", "stamp", "record", "url")
    firsts = keep(
        index.filter(F.col("size") >= revisit_bytes)
        .groupBy(F.col("digest").alias("first_digest"))
        .agg(F.min(order).alias("f"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("first_digest", F.col("f.record").alias("first_record"), F.col("f.url").alias("first_url"),
                F.col("f.stamp").alias("first_stamp"), F.col("f.place").alias("first_place")),
        "firsts",
    )
    rows = _files(spark, arc_folder).mapInArrow(
        arc_blocks,
        "record string, stamp string, ip string, content_type string, url string, kind string, digest string, "
        "size long, place long, block binary",
    )
    joined = keyed_join(rows, firsts, [("digest", "first_digest")], ["record"])
    # The first record itself, and rows that repeat its id, are no revisits.
    own = F.col("place").eqNullSafe(F.col("first_place")) & (F.col("place").isNotNull() | (F.col("record") == F.col("first_record")))
    short = F.col("size") < revisit_bytes
    for name in ("first_record", "first_url", "first_stamp"):
        joined = joined.withColumn(name + "_", F.when(own | short, None).otherwise(F.col(name)))
    out = joined.select(
        "record", "stamp", "ip", "content_type", "url", "kind", "digest", "block",
        *[F.col(n + "_").alias(n) for n in ("first_record", "first_url", "first_stamp")],
    )
    _write(out.mapInArrow(lambda b: warc_files(b, size), "archive binary"), warc_folder)
    return skipped


def read_warc(spark, folder: str) -> DataFrame:
    """Records of all archives: ``(record, url, stamp, kind, refers, place, size, digest, whole)``.

    ``place`` is the page id, ``size`` and ``digest`` those of the full payload, and ``whole`` tells whether
    the payload read has the digest written.
    """
    return _files(spark, folder).mapInArrow(warc_rows, READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages to legacy archives, those to WARC, and the records read back, with ``refers_to`` as page id."""
    spark = pages.sparkSession
    arc, warc = new_folder(spark, "arc"), new_folder(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    found = keep(read_warc(spark, warc), "records")
    wanted = found.filter("refers IS NOT NULL").select(F.col("refers").alias("wanted")).distinct()
    named = keep(
        found.select("record", "place").join(wanted, F.col("record") == F.col("wanted"), "left_semi")
        .groupBy(F.col("record").alias("first_record")).agg(F.min("place").alias("refers_to")),
        "named",
    )
    return keyed_join(found, named, [("refers", "first_record")], ["record"])
