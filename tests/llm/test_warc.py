import base64
import hashlib
import io
import struct

import pytest
import zstandard

from millrace.llm import warc
from millrace.llm.common import Shared, table
from millrace.llm.queries import OP8_SQL, op8_warc
from tests.oracle import compare

RECORDS = [warc.make_record(i, f"http://a.example/{i}", b"<html>%d</html>" % i * (i * 50), None) for i in range(6)] + [warc.make_record(9, None, b"x", 3)]
DICTIONARY = b"<html></html>WARC-Type: response HTTP/1.1 200 OK" * 30


def pack(records=RECORDS, dictionary=DICTIONARY):
    return b"".join(warc.archive(iter(records), dictionary))


def unpack(data):
    return list(warc.read_archive(io.BytesIO(data).read))


def test_query_equals_the_oracle(spark, sf):
    compare(op8_warc(spark, sf), OP8_SQL, sf)


@pytest.mark.parametrize("dictionary", [None, DICTIONARY])
def test_round_trip_one_frame_for_each_record(dictionary):
    data = pack(dictionary=dictionary)
    assert unpack(data) == RECORDS
    frames = data.count(warc.ZSTD_FRAME)
    assert frames >= len(RECORDS) + (dictionary is not None)
    assert (struct.unpack("<I", data[:4])[0] == warc.DICTIONARY_FRAME) == (dictionary is not None)


def test_plain_dictionary_is_read_too():
    known = zstandard.ZstdCompressionDict(DICTIONARY)
    frame = zstandard.ZstdCompressor(dict_data=known).compress(RECORDS[2])
    assert unpack(struct.pack("<II", warc.DICTIONARY_FRAME, len(DICTIONARY)) + DICTIONARY + frame) == [RECORDS[2]]


def test_one_byte_at_a_time():
    data = io.BytesIO(pack())
    assert list(warc.read_archive(lambda n: data.read(1))) == RECORDS


def test_records_larger_than_a_read():
    big = warc.make_record(1, None, bytes(range(256)) * 4000, None)
    assert unpack(pack([big, RECORDS[0], big])) == [big, RECORDS[0], big]


def test_damage_is_found():
    data = pack()
    for bad in (data[:-3], data[:20], data + b"junk", data[:-40] + bytes(1) + data[-39:]):
        with pytest.raises(warc.WarcError):
            unpack(bad)
    record = RECORDS[3]
    for bad in (
        record.replace(b"WARC/1.1", b"WARC/0.9"),
        record[:-4],
        record.replace(b"Content-Length: ", b"Content-Length: 1", 1),
        record.replace(b"<html>3", b"<html>4", 1),
        record.replace(b"WARC-Type: response", b"WARC-Type: strange"),
        record.replace(b"WARC-Record-ID: <urn", b"WARC-Record-ID: <xrn"),
        record.replace(b"sha1:", b"md5:"),
        record.replace(b"HTTP/1.1", b"FTP /1.1"),
        RECORDS[6].replace(b"identical-payload-digest", b"other"),
    ):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)


def test_digest():
    assert warc.payload_digest(b"") == base64.b32encode(hashlib.sha1(b"").digest()).decode() == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def test_odd_rows(spark):
    long = "é" * 200_000
    rows = [(5, "u", long), (3, "u\r\nX: y", long), (7, None, None), (6, "", ""), (None, "n", long), (None, "n", "alone"), (8, "é", "once"), (3, "u", long), (9, "a b", "twice"), (10, "c", "twice")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, sha int")
    shared = Shared.create(spark, "warc-test")
    got = warc.read(spark, shared, warc.write(pages, shared), payload=True).collect()
    seen = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got), key=str)
    n = len(long.encode())
    assert seen == sorted([(5, "revisit", 3, n), (3, "response", None, n), (3, "response", None, n), (7, "revisit", 6, 0), (6, "response", None, 0), (None, "revisit", 3, n), (None, "response", None, 5), (8, "response", None, 4), (9, "response", None, 5), (10, "revisit", 9, 5)], key=str)
    assert {r.url for r in got if r.page_id == 3} == {"u", "u%0D%0AX:%20y"} and {r.url for r in got if r.page_id == 7} == {None}
    assert all(warc.payload_digest(r.payload) == r.payload_digest for r in got if r.record_type == "response")
    short = Shared.create(spark, "warc-test")
    assert {r.record_type for r in warc.read(spark, short, warc.write(pages, short, least_bytes=6)).where("page_id IN (9, 10)").collect()} == {"response"}
    none = Shared.create(spark, "warc-test")
    assert warc.write(pages.limit(0), none) == [] and warc.read(spark, none, []).count() == 0


def test_dictionary_is_fitted_and_used(spark):
    sf = "/root/testdata/sf0.01"
    shared = Shared.create(spark, "warc-test")
    names = warc.write(table(spark, sf, "pages"), shared)
    assert names and all(shared.read(n)[:4] == struct.pack("<I", warc.DICTIONARY_FRAME) for n in names)
