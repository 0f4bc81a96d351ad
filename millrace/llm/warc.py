"""WARC archives in Zstandard: one frame for each record, the dictionary in a leading skippable frame.

Writing deals the rows so that equal payloads know their smallest id, and every task writes one
archive.  Reading opens archives one at a time, loads the dictionary, decodes frame by frame and
holds one record; versions, headers, lengths and digests are checked.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Shared, as_bytes, hashed_sample, record_batch

#: Parameters.  The dictionary is fitted on SAMPLE pages at most, SAMPLE_BYTES of each.
LEVEL, DICTIONARY, SAMPLE, SAMPLE_BYTES, SALTS, FEED = 3, 32 << 10, 400, 16 << 10, 16, 1 << 16
#: Fixed values of the formats.
VERSION = b"WARC/1.1"
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:millrace:page:"


class WarcError(ValueError):
    """An archive that breaks the format."""


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_value(text: str) -> str:
    """On one line, without white space or control characters."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; ``refers_to`` makes it a revisit, whose block has the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_URN}{'none' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_value(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_URN}{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    page_id: int | None
    url: str | None
    record_type: str
    payload_bytes: int
    payload_digest: str
    refers_to: int | None
    payload: bytes | None


def _headers(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise WarcError(f"no header line: {line[:80]!r}")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def _number(headers: dict[str, str], name: str) -> int:
    value = headers.get(name, "")
    if not value.isascii() or not value.isdigit():
        raise WarcError(f"{name} is {value!r}")
    return int(value)


def _page(value: str | None) -> int | None:
    m = re.fullmatch(rf"<{_URN}(-?\d+|none)>", value or "")
    if not m:
        raise WarcError(f"record id is {value!r}")
    return None if m[1] == "none" else int(m[1])


def parse_record(data: bytes) -> Record:
    """Checks and takes apart one record."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not blank or version != VERSION:
        raise WarcError(f"no {VERSION.decode()} record: {version[:40]!r}")
    headers = _headers(lines)
    length = _number(headers, "content-length")
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"the block has {len(rest) - 4} bytes; Content-Length is {length}")
    http, blank, payload = rest[:length].partition(b"\r\n\r\n")
    status, *lines = http.split(b"\r\n")
    if not blank or not status.startswith(b"HTTP/"):
        raise WarcError("the block has no HTTP header")
    size = _number(_headers(lines), "content-length")
    kind = headers.get("warc-type", "")
    algorithm, _, digest = headers.get("warc-payload-digest", "").partition(":")
    if algorithm != "sha1" or not re.fullmatch("[A-Z2-7]{32}", digest):
        raise WarcError("no SHA-1 payload digest")
    refers_to = None
    if kind == "response":
        if len(payload) != size:
            raise WarcError(f"the payload has {len(payload)} bytes; its Content-Length is {size}")
        if payload_digest(payload) != digest:
            raise WarcError("the payload digest differs")
    elif kind == "revisit":
        if payload or headers.get("warc-profile") != REVISIT_PROFILE:
            raise WarcError("a revisit with a payload or of another profile")
        refers_to = _page(headers.get("warc-refers-to"))
    else:
        raise WarcError(f"record type {kind!r}")
    return Record(_page(headers.get("warc-record-id")), headers.get("warc-target-uri"), kind, size, digest, refers_to, payload if kind == "response" else None)


# -- archives -------------------------------------------------------------------------------


def archive(records: Iterator[bytes], dictionary: bytes | None, level: int = LEVEL) -> Iterator[bytes]:
    """The bytes of an archive, piece by piece."""
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if dictionary:
        packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
        yield struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed
    press = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True, write_content_size=True)
    for r in records:
        yield press.compress(r)


def read_archive(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """The records of an archive, one for each frame; ``read(n)`` gives at most n bytes, none at the end."""
    data = read(FEED)
    while len(data) < 8 and (more := read(FEED)):
        data += more
    dictionary = None
    if len(data) >= 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_FRAME:
        size = struct.unpack("<I", data[4:8])[0]
        while len(data) < 8 + size and (more := read(FEED)):
            data += more
        if len(data) < 8 + size:
            raise WarcError("the dictionary is cut short")
        found, data = data[8 : 8 + size], data[8 + size :]
        if found[:4] == ZSTD_FRAME:
            found = zstandard.ZstdDecompressor().decompress(found)
        dictionary = zstandard.ZstdCompressionDict(found)
    plain = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while data or (data := read(FEED)):
        while len(data) < 4 and (more := read(FEED)):
            data += more
        if data[:4] != ZSTD_FRAME:
            raise WarcError(f"no frame begins here: {data[:4]!r}")
        frame, out = plain.decompressobj(), []
        try:
            while True:
                out.append(frame.decompress(data))
                if frame.eof:
                    data = frame.unused_data
                    break
                if not (data := read(FEED)):
                    raise WarcError("a frame is cut short")
        except zstandard.ZstdError as e:
            raise WarcError(str(e)) from e
        yield b"".join(out)


def fit_dictionary(pages: DataFrame, id_col: str, html_col: str, size: int = DICTIONARY) -> bytes | None:
    """A dictionary from a bounded sample drawn by a hash of the id; None if there is too little to learn."""
    rows = pages.select(F.col(id_col).alias("i"), F.substring(F.coalesce(html_col, F.lit("")), 1, SAMPLE_BYTES).alias("t"))
    samples = [make_record(r.i, None, r.t.encode(), None) for r in hashed_sample(rows, "i", SAMPLE).collect()]
    if sum(map(len, samples)) < 8 * size or len(samples) < 20:
        return None
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return None


# -- the operators --------------------------------------------------------------------------


def write(pages: DataFrame, shared: Shared, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> list[str]:
    """Writes a record for each row, and gives the archives' names.

    Of rows with equal payloads of at least ``least_bytes`` bytes those with the smallest id are
    responses and the others revisit it; shorter payloads are all responses.  A null payload is
    empty.  A row without an id is a revisit if an equal payload has an id, else a response.
    Repeated rows give a record each; an empty table gives no archive.
    """
    dictionary = fit_dictionary(pages, id_col, html_col)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("sha", F.sha1("html")).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    # A payload's rows are spread over SALTS tasks; every one of these tasks is told the smallest id.
    known = rows.groupBy("sha", "salt").agg(F.min("page_id").alias("least")).groupBy("sha").agg(F.min("least").alias("least"), F.collect_list("salt").alias("salts"))
    known = known.select("sha", "least", F.explode("salts").alias("salt"))
    joined = rows.join(known, ["sha", "salt"]).select("page_id", "url", "html", "least")
    schema = pa.schema([("archive", pa.string()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0

        def records() -> Iterator[bytes]:
            nonlocal n
            for b in batches:
                for i, u, t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), b.column(3).to_pylist()):
                    n += 1
                    yield make_record(i, u, t, k if k is not None and i != k and len(t) >= least_bytes else None)

        found = records()
        first = next(found, None)
        if first is not None:
            name = f"part-{TaskContext.get().partitionId():06d}.warc.zst"

            def whole() -> Iterator[bytes]:
                yield first
                yield from found

            shared.write(name, archive(whole(), dictionary))
            yield record_batch(schema, [name], [n])

    return sorted(r.archive for r in joined.mapInArrow(run, "archive string, records long").collect())


def read(spark: SparkSession, shared: Shared, names: list[str], payload: bool = False) -> DataFrame:
    """A row for each record of the archives: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, archive``.

    ``payload`` adds the payload of responses.  A damaged archive fails with :class:`WarcError`.
    Ids and addresses that were null are null again, payloads that were null are empty; records may be
    repeated and of any length; no archives give no rows.
    """
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string())]
    layout = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string"
    if payload:
        fields, layout = [*fields, ("payload", pa.binary())], layout + ", payload binary"
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, size = [], 0
                with shared.open(name) as f:
                    for data in read_archive(f.read):
                        r = parse_record(data)
                        rows.append((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, name, *([r.payload] if payload else [])))
                        size += 200 + len(r.payload or b"") * payload
                        if size > 1 << 20:
                            yield record_batch(schema, *map(list, zip(*rows)))
                            rows, size = [], 0
                if rows:
                    yield record_batch(schema, *map(list, zip(*rows)))

    paths = spark.createDataFrame([(n,) for n in names], "name string").repartition(max(1, len(names)))
    return paths.mapInArrow(run, layout)
