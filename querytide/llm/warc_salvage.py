"""WARC archives: writing with revisit records, and a reader that salvages what damaged files still hold.

The writer makes one gzip member per record and lets Spark's text writer put them into files, so that any storage Spark
writes to works and lost tasks leave nothing behind. The writer ends each row with a separator; the separator here is
the last byte of a gzip member, the top byte of its length, which is 0 (a record of 16 MiB or more is followed by an
empty member, whose last byte is 0 too).

The reader checks each member or plain record (inflation, version line, length, closing blank lines, digests). After a
failed check it looks for the next gzip or version line that begins a sound record, goes on there and reports the bytes
between as a gap. The content of a damaged member is searched in the same way, as far as it can be inflated.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querytide.session import stored

#: Payloads from this size on are written once; equal ones later on are revisits.
REVISIT_BYTES = 1000
#: How a member and a record begin, and the separator described above.
_MEMBER, _VERSION, _SEPARATOR = b"\x1f\x8b\x08", b"WARC/1.", "\0"
_EMPTY_MEMBER = zlib.compressobj(6, zlib.DEFLATED, 31).flush()
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 16
_HEAD = re.compile(rb"WARC/1\.[01]\r\n((?:[^\r\n:]++:[^\r\n]*+\r\n)++)\r\n")

RECORDS = (
    "path string, start long, bytes long, gap string, record_id string, record_type string, uri string, "
    "refers_to string, payload_bytes long, payload_digest string, payload binary"
)


def with_revisits(pages: DataFrame, id_col: str, uri_col: str, payload_col: str) -> DataFrame:
    """id, uri, payload, digest and refers_to (the id to revisit, or null).

    Of rows with equal payloads of REVISIT_BYTES or more, the one with the largest id is the original, and so is any row
    that shares this id. Null payloads are empty; a row without an id can only revisit. Where the groups of equal
    payloads are few, Spark broadcasts them by the stored table's size and no payload is shuffled."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(uri_col).cast("string").alias("uri"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    large = rows.filter(F.octet_length("payload") >= REVISIT_BYTES)
    groups = large.groupBy("digest").agg(F.max("id").alias("original"), F.count("*").alias("n"))
    shared = stored(groups.filter((F.col("n") > 1) & F.col("original").isNotNull()).drop("n"), "revisits")
    refers = F.when(~F.col("id").eqNullSafe(F.col("original")), F.col("original"))
    return rows.join(shared, "digest", "left").select("id", "uri", "payload", "digest", refers.alias("refers_to"))


def _record(name: str, uri: str, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = [
        ("WARC-Type", "revisit" if refers_to else "response"),
        ("WARC-Record-ID", f"<{name}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
        *([("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", _PROFILE)] if refers_to else []),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = pack.compress(record) + pack.flush()
    return member if member[-1] == 0 else member + _EMPTY_MEMBER


def write_archives(rows: DataFrame, path: str, name: str = "urn:page:", date: str = "2000-01-01T00:00:00Z") -> None:
    """Write with_revisits()'s rows as archives in the folder `path`, one file per task.

    Records are named by `name` and the id (nothing follows `name` where the id is null). White space and control
    characters in a URI are percent-encoded, a null URI is empty. An empty table gives files without records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["uri"] or "")
                own = name if row["id"] is None else f"{name}{row['id']}"
                other = None if row["refers_to"] is None else f"{name}{row['refers_to']}"
                out.append(_member(_record(own, uri, row["payload"], row["digest"], other, date))[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    members = rows.mapInArrow(run, "member binary").select(F.col("member").cast("string"))
    members.write.option("lineSep", _SEPARATOR).text(path)


class Broken(Exception):
    """A check of a member or record has failed; `content` is what the member held, as far as it could be inflated, and
    `stop` the place after the member where that is known."""

    def __init__(self, reason: str, content: bytes = b"", stop: int | None = None) -> None:
        super().__init__(reason)
        self.content, self.stop = content, stop


def _inflate(data: memoryview, start: int) -> tuple[bytes, int]:
    """The content of the member at `start` and the place after it."""
    unpack, out, at = zlib.decompressobj(31), [], start
    try:
        while not unpack.eof:
            if at >= len(data):
                raise Broken("the file ends in a member", b"".join(out))
            before = unpack.copy()
            out.append(unpack.decompress(data[at : at + _CHUNK]))
            at += _CHUNK
    except zlib.error as error:
        out += _until_error(before, data[at : at + _CHUNK])
        raise Broken("a member cannot be inflated", b"".join(out)) from error
    return b"".join(out), min(at, len(data)) - len(unpack.unused_data)


def _until_error(unpack, data: memoryview) -> Iterator[bytes]:
    """What the bytes before the faulty one give."""
    for k in range(len(data)):
        try:
            yield unpack.decompress(data[k : k + 1])
        except zlib.error:
            return


def _digest(text: str) -> str | None:
    """A sha1 header value as lower-case hexadecimal digits; null for other algorithms."""
    kind, _, value = text.partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        return base64.b32decode(value.upper()).hex() if len(value) == 32 else bytes.fromhex(value).hex()
    except (binascii.Error, ValueError) as error:
        raise Broken("a digest cannot be read") from error


def _parse(data: bytes | memoryview, start: int, digests: bool = False) -> tuple[dict, int]:
    """The record at `start` and the place after it; with `digests`, only a record whose block has a digest."""
    head = _HEAD.match(data, start)
    if not head:
        raise Broken("no version line and headers")
    fields = {}
    for line in head[1].decode("utf-8", "replace").split("\r\n")[:-1]:
        key, _, value = line.partition(":")
        fields.setdefault(key.strip().lower(), value.strip())
    if not fields.get("content-length", "").isdecimal():
        raise Broken("no content length")
    first = head.end()
    stop = first + int(fields["content-length"])
    if bytes(data[stop : stop + 4]) != b"\r\n\r\n":
        raise Broken("the record does not end where its length says")
    block = bytes(data[first:stop])
    known = _digest(fields.get("warc-block-digest", ""))
    if digests and not known:
        raise Broken("no block digest")
    if known and known != hashlib.sha1(block).hexdigest():
        raise Broken("the block digest differs")
    kind, payload, size = fields.get("warc-type", ""), block, None
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
        size = int(length[1]) if length else None
    digest = _digest(fields.get("warc-payload-digest", ""))
    if kind == "revisit":
        payload = None
    else:
        size, own = len(payload), hashlib.sha1(payload).hexdigest()
        if digest and digest != own:
            raise Broken("the payload digest differs")
        digest = own
    return {
        "record_id": fields.get("warc-record-id", "").strip("<>"),
        "record_type": kind,
        "uri": fields.get("warc-target-uri"),
        "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": payload,
    }, stop + 4


def _at(data: memoryview, start: int) -> tuple[list[dict], int]:
    """The records of the member, or the plain record, at `start`, and the place after it."""
    if data[start : start + len(_MEMBER)] != _MEMBER:
        record, stop = _parse(data, start)
        return [record], stop
    content, stop = _inflate(data, start)
    records, at = [], 0
    try:
        while at < len(content):
            record, at = _parse(content, at)
            records.append(record)
    except Broken as error:
        raise Broken(str(error), content, stop) from error
    return records, stop


def _inside(error: Broken) -> list[dict]:
    """The sound records of a damaged member's content: after a failed check, from the next sound version line on.

    If the member's own checksum is not there to vouch for the headers, records need a digest, and the fault must show
    in another record of the member: if none fails, it may be in any header, which no digest covers."""
    content, vouched = error.content, error.stop is not None
    records, at, failed = [], content.find(_VERSION), False
    while at >= 0:
        try:
            record, stop = _parse(content, at, digests=not vouched)
            records.append(record)
            at = content.find(_VERSION, stop)
        except Broken:
            failed = True
            at = content.find(_VERSION, at + 1)
    return records if vouched or failed else []


def salvage(content: bytes) -> Iterator[tuple[int, int, str | None, dict]]:
    """(start, bytes, null, record) for each sound record and (start, bytes, reason, {}) for each gap, in order. A damaged
    member is a gap, and the sound records inside it follow with the gap's place."""
    data, at, inside = memoryview(content), 0, []
    while at < len(content):
        try:
            records, stop = _at(data, at)
        except Broken as error:
            reason, stop, more = str(error), error.stop or at, _inside(error)
            while not error.stop and stop < len(content):
                found = [i for i in (content.find(_MEMBER, stop + 1), content.find(_VERSION, stop + 1)) if i >= 0]
                stop = min(found, default=len(content))
                try:
                    if stop < len(content):
                        _at(data, stop)
                    break
                except Broken as other:
                    if _inside(other):
                        break
            yield at, stop - at, reason, {}
            inside = more or inside
            for record in more:
                yield at, stop - at, None, record
        else:
            # A member that holds its bytes as they are shows its records to the search too.
            inside = [] if data[at : at + len(_MEMBER)] == _MEMBER else inside
            for record in records:
                if record not in inside:
                    yield at, stop - at, None, record
        at = stop


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record and every gap of the archives in the folder `path`, as RECORDS names them.

    For records, gap is null, start and bytes tell where the member or plain record lies, the digest is lower-case
    hexadecimal, and payload is null for revisits (their payload_bytes is what the stored HTTP header says) and where
    `payloads` is false. For gaps, gap gives the failed check and the record's columns are null; sound records inside a
    damaged member have the gap's start and bytes. A file is read whole
    by one task, so archives should be cut into files that fit a task's memory (2 GB at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[k])
             for n, k in (c.split() for c in RECORDS.split(", "))]
        )
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, size, name = [], 0, name.as_py()
                for start, length, gap, record in salvage(content.as_py()):
                    size += len(record.get("payload") or b"")
                    if not payloads:
                        record.pop("payload", None)
                    rows.append({"path": name, "start": start, "bytes": length, "gap": gap} | record)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORDS)
