"""What the archive converter does with headers that it cannot read, and whether records can be sought."""

import gzip
import re
import zlib

import pytest
from pyspark.sql import functions as F

from postwatch.llm import registry, warc
from postwatch.session import new_folder

DATE = "20200101000000"


def record(version=1, url="http://x", block=b"b\nc", offset=0):
    return warc.arc_record(version, url, "1.2.3.4", "20210203040506", "text/html", block, offset, "n")


def parsed(data):
    skipped = []
    found = [(r[0], r[4]) for r in warc.arc_records(data, skipped)]
    return found, len(skipped)


GOOD = ("http://x", b"b\nc")


@pytest.mark.parametrize("start, n_skipped", [
    (b"filedesc://n 0.0.0.0 20200101000000 text/plain\n1 0 p\nURL IP-address\n\n", 3),
    (b"filedesc://n 0.0.0.0 20200101000000 text/plain 0\n\n", 1),
    (b"filedesc://n 0.0.0.0 20200101000000 text/plain 99999999999999999999999999\n\n", 1),
    (b"filedesc://n 0.0.0.0 20200101000000 text/plain x\nx y\n\n", 2),
    (b"", 0),
    (b"\xff\xfe\x00 junk\n", 1),
])
def test_unreadable_version_blocks_are_skipped_and_counted(start, n_skipped):
    assert parsed(start + record() + b"\n") == ([GOOD], n_skipped)


def test_an_unknown_version_is_read_by_its_own_fields():
    body = b"3 0 p\nURL IP-address Archive-date Content-type Extra Archive-length\n"
    start = b"filedesc://n 0.0.0.0 20200101000000 text/plain %d\n" % len(body) + body
    own = b"http://x 1.2.3.4 20210203040506 text/html more 3\nb\nc\n"
    found, n = parsed(start + b"\n" + own)
    assert found == [GOOD] and n > 0


def test_cut_and_odd_records():
    start = warc.arc_start(1, "n", DATE) + b"\n"
    assert parsed(start + record()[:-2]) == ([("http://x", b"b")], 0)
    assert parsed(start + b"http://x 1.2.3.4 20210203040506 text/html\n" + record()) == ([GOOD], 1)
    assert parsed(start + b"http://x 1.2.3.4 2021 text/html -3\n" + record()) == ([GOOD], 1)
    assert parsed(b"no line end") == ([], 1) and parsed(b"") == ([], 0)


def test_numbers():
    assert [warc.number(x) for x in (None, b"", b"x", b"12", b"-7", b"9223372036854775807", b"9223372036854775808", b"1" * 5000)] == [
        None, None, None, 12, -7, 2**63 - 1, None, None]


def test_warc_with_odd_headers():
    import pyarrow as pa

    def made(head, block):
        return f"WARC/1.0\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + warc.CLOSE

    revisit = b"HTTP/1.1 200 OK\r\nContent-Length: many\r\nX-Page-Id: 123456789012345678901234567890\r\n\r\n"
    data = (
        made("WARC-Type: revisit\r\nWARC-Payload-Digest: \xff\xfe\r\n", revisit) + made("WARC-Type: resource\r\n", b"x")
        + b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: " + b"9" * 6000 + b"\r\n\r\nlost\r\n\r\n" + made("", b"HTTP/1.1 200 OK\r\n")
    )
    batch = pa.RecordBatch.from_arrays([pa.array(["f"]), pa.array([data], pa.binary())], ["path", "content"])
    found = [r for b in warc.warc_rows([batch]) for r in b.to_pylist()]
    assert [(r["kind"], r["place"], r["size"]) for r in found] == [("revisit", None, 0), ("resource", None, 1), (None, None, 0)]


def members(data):
    """Members of a gzip file, each read alone."""
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return out


@pytest.fixture(scope="module")
def files(spark):
    registry.ship(spark)
    long = "<p>" + "x" * 200
    rows = [(i, f"http://h/{i % 5}", long if i % 3 == 0 else f"<p>page {i}" + "é" * 80) for i in range(24)]
    rows += [(7, "http://h/2", "<p>page 7" + "é" * 80)] * 3 + [(None, None, None), (99, "a b", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumn("kind", F.lit(1)).withColumn("place", F.lit("p"))
    arc, out = new_folder(spark, "arc"), new_folder(spark, "warc")
    warc.write_arc(pages, arc, size=1500)
    assert warc.convert(spark, arc, out, size=2500) == 0
    return spark, rows, arc, out


def stored(spark, folder):
    return {r["path"].rsplit("/", 1)[1]: bytes(r["content"]) for r in spark.read.format("binaryFile").load(folder).collect()}


def test_arc_names_and_offsets_find_the_records(files):
    spark, rows, arc, _ = files
    found = n = 0
    for name, data in stored(spark, arc).items():
        whole = gzip.decompress(data)
        assert b"".join(members(data)) == whole
        for url, ip, date, kind, block, at in warc.arc_records(whole):
            n += 1
            head = whole[at : whole.index(b"\n", at)].split(b" ")
            if len(head) == 10:
                assert int(head[7]) == at
                part, number = re.fullmatch(rb"part-(\d+)-c(\d+)", head[8]).groups()
                assert name.startswith(f"part-{part.decode()}-") and f"-c{number.decode()}." in name
                found += 1
    assert n == len(rows) and found > 5


def test_each_warc_record_is_a_member_with_its_own_id(files):
    spark, rows, _, out = files
    ids, kinds = [], []
    for data in stored(spark, out).values():
        for one in members(data):
            (head, block), = warc.parse_warc(one)
            ids.append(warc.header_value(head, "WARC-Record-ID"))
            kinds.append(warc.header_value(head, "WARC-Type"))
            assert one.endswith(warc.CLOSE)
    assert len(ids) == len(set(ids)) and kinds.count(b"warcinfo") == len(stored(spark, out))
    assert len(ids) - kinds.count(b"warcinfo") == len(rows)
    got = sorted((str(r["place"]), r["size"], r["whole"]) for r in warc.read_warc(spark, out).collect())
    assert got == sorted((str(i), len((html or "").encode()), True) for i, _, html in rows)


def test_skipped_lines_are_counted_over_all_archives(spark):
    registry.ship(spark)
    folder, out = new_folder(spark, "arc"), new_folder(spark, "warc")
    texts = [(warc.arc_start(1, "n", DATE) + b"\nnot a header\n" + record()).decode(), "filedesc://x\nnothing here"]
    spark.createDataFrame([(t,) for t in texts], "value string").write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(folder)
    assert warc.convert(spark, folder, out) == 3
    assert [(r["url"], r["kind"]) for r in warc.read_warc(spark, out).collect()] == [("http://x", "resource")]


def test_large_pages_and_empty_tables(spark):
    registry.ship(spark)
    big = "x" * (17 << 20)
    pages = spark.createDataFrame([(1, "http://big", big), (2, "http://big", big)], "page_id long, url string, html string")
    got = sorted((r["place"], r["kind"], r["refers_to"], r["size"], r["whole"]) for r in warc.round_trip(pages).collect())
    assert got == [(1, "response", None, 17 << 20, True), (2, "revisit", 1, 17 << 20, True)]
    assert warc.round_trip(pages.limit(0)).collect() == []
