"""WARC archives: a writer with revisit records and a splittable reader.

The writer stores each page as one gzip member. Of pages with equal payloads
the one with the smallest id is a ``response``; the others are ``revisit``
records (RFC-style, profile identical-payload-digest) that carry no payload but
its digest, its length and the id of the response.

The reader needs no index: a task scans its byte range for the gzip magic,
validates each candidate by decoding it up to a complete WARC record, and owns
the records whose members *start* inside the range, reading past its end for
the last one. Within a range it goes on after each record.

What a file's records are is defined by reading it from its first byte: a valid
member is a record and reading goes on after it; over anything else it goes on
at the next valid member. A range can't see whether its first candidate lies
inside a record that began earlier (an archive stored as a payload), so after
the pass each range's first record is compared with where the ranges before it
arrived. Where it starts inside a record, that range is read again from there;
so the records never depend on how a file is split. What is read is written to
the shared folder for that (``payloads=False``: without the payloads).

Files are written to a temporary name and moved, so a task run again replaces
its file; the listing that is read comes from the tasks' results.

Defined results: a null payload counts as empty; a null url gives a record
without target URI; control characters and blanks of a url are
percent-encoded. Rows equal in id and payload, if that id is the smallest, are
each a response. A null id is larger than any other; where all are null each
row is a response. An empty table gives no files and an empty result. Damaged
members are passed over. Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import open_fs, small, stage

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 8 << 20
#: Tasks of a read at most; beyond that a task reads several ranges.
MAX_TASKS = 50_000
_PIECE = 1 << 14
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"
READ_SCHEMA = "file string, offset long, record_type string, record_id string, refers_to_id string, target_uri string, headers map<string,string>, payload_length long, payload_digest string, digest_ok boolean, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: object) -> str:
    return f"<urn:quire:page:{key}>" if key is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'quire:page')}>"


def make_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member holding one record."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    return gzip.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + _END, 6, mtime=0)


def page_record(key: object, url: str | None, payload: bytes, refers_to: object, revisit: bool, date: str) -> bytes:
    name = digest(payload)
    fields = [("WARC-Record-ID", record_id(key)), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{name}"), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return make_record("revisit" if revisit else "response", fields, http + (b"" if revisit else payload))


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write the pages below ``folder``; gives a row per file: ``file, bytes, records``.

    Payloads of fewer than ``least`` bytes are always responses.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("key"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    large = F.octet_length("payload") >= least
    sha = F.unhex(F.sha2("payload", 256))
    # only ids and digests shuffle; pages meet the payloads that occur more than once, without moving where these are few
    seen = rows.where(large).select(sha.alias("sha_"), "key").groupBy("sha_").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
    again = stage(seen.where("n > 1").drop("n"), "warc-repeated")
    rows = rows.withColumn("sha", F.when(large, sha)).join(small(again), F.col("sha") == F.col("sha_"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    rows = rows.select("key", "url", "payload", "first", revisit.alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, n = TaskContext.get().partitionId(), None, 0
        fs, path = open_fs(f"{folder}/part-{part:06d}.warc.gz")
        temporary = f"{path}.{uuid.uuid4().hex}.tmp"
        for batch in batches:
            for key, url, body, to, again in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(temporary)
                    info = b"software: quire\r\nformat: WARC File Format 1.1\r\n"
                    out.write(make_record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, path)}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], info))
                out.write(page_record(key, url, body, to, again, date))
                n += 1
        if out is not None:
            size = out.tell()
            out.close()
            fs.move(temporary, path)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/part-{part:06d}.warc.gz"]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["file", "bytes", "records"])

    done = rows.mapInArrow(write, "file string, bytes long, records long").collect()  # a row a file
    return pages.sparkSession.createDataFrame(done, "file string, bytes long, records long")


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields (names lower-cased) and block of one complete record, else None."""
    head, found, rest = raw.partition(_END)
    if not found or not head.startswith(b"WARC/1."):
        return None
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    n = fields.get("content-length", "")
    if not n.isdigit() or rest[int(n) :] != _END:
        return None
    return fields, rest[: int(n)]


def member_at(read, at: int) -> tuple[tuple[dict[str, str], bytes], int] | None:
    """The record of the gzip member at ``at`` and the offset after it, or None. ``read(offset, n)`` gives bytes."""
    unzip, out, fed = zlib.decompressobj(31), [], 0
    try:
        while not unzip.eof:
            piece = read(at + fed, _PIECE if fed < 4 * _PIECE else 16 * _PIECE)
            if not piece:
                return None
            fed += len(piece)
            out.append(unzip.decompress(piece))
            if len(out) == 1 and not (out[0] or b"WARC/1.").startswith(b"WARC/1."[: max(1, len(out[0]))]):
                return None
    except zlib.error:
        return None
    record = parse_record(b"".join(out))
    return record and (record, at + fed - len(unzip.unused_data))


def records_in(read, size: int, begin: int, end: int, start: int | None = None) -> Iterator[tuple[int, dict[str, str], bytes, int]]:
    """Offset, fields and block of each record whose member starts in [begin, end), and the offset after it.

    ``start``: where the records before arrived, if that is known.
    """
    end = min(end, size)
    if begin >= end:
        return
    window, at = read(begin, end - begin + len(MAGIC) - 1), begin if start is None else max(begin, start)
    while 0 <= (k := window.find(MAGIC, at - begin)) < end - begin:
        got = member_at(read, begin + k)
        if got is None:
            at = begin + k + 1
        else:
            at = got[1]
            yield begin + k, *got[0], at


def read_warc(spark: SparkSession, files: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """One row per record of ``files`` (``file``, ``bytes``): see ``READ_SCHEMA``; ``payload`` is null without ``payloads``."""

    def rows(path: str, begin: int, start: int | None):
        fs, inner = open_fs(path)
        with fs.open_input_file(inner) as f:

            def read(at: int, n: int) -> bytes:
                f.seek(at)
                return f.read(n)

            for at, fields, block, after in records_in(read, f.size(), begin, begin + split_bytes, start):
                kind, body, length, ok = fields.get("warc-type"), None, None, None
                name = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                if kind in ("response", "revisit"):
                    http, _, body = block.partition(_END)
                    m = re.search(rb"(?im)^content-length:\s*(\d+)", http)
                    length = int(m[1]) if m else None
                    if kind == "response":
                        length, own = len(body), digest(body)
                        name, ok = own, name is None or name == own
                    if kind == "revisit" or not payloads:
                        body = None
                yield path, at, kind, fields.get("warc-record-id"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), list(fields.items()), length, name, ok, body, begin, after

    types = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to_id", pa.string()), ("target_uri", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload_length", pa.int64()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_()), ("payload", pa.binary()), ("_begin", pa.int64()), ("_after", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, begin, start in zip(*(batch.column(i).to_pylist() for i in range(3))):
                held, weight = [], 0
                for row in rows(path, begin, start):
                    held.append(row)
                    weight += len(row[10] or b"") + 500
                    if weight > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), types)], schema=types)
                        held, weight = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), types)], schema=types)

    def over(ranges: DataFrame, tasks: int) -> DataFrame:
        schema = f"{READ_SCHEMA}, _begin long, _after long"
        return stage(ranges.repartition(max(1, min(MAX_TASKS, tasks))).mapInArrow(run, schema), "warc-records")

    files = files.where("bytes > 0").select("file", "bytes")
    ranges = files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("begin"), F.lit(None).cast("long").alias("start"))
    found = over(ranges, ranges.count())
    while not (wrong := stage(_inside(found, split_bytes), "warc-again")).isEmpty():
        gone = wrong.select(F.col("file").alias("_file"), "from", "begin")
        marked = found.join(small(gone), (F.col("file") == F.col("_file")) & F.col("_begin").between(F.col("from"), F.col("begin")), "left_anti")
        found = marked.unionByName(over(wrong.select("file", "begin", "start"), wrong.count()))
    return found.drop("_begin", "_after")


def _inside(found: DataFrame, split_bytes: int) -> DataFrame:
    """For each file the first range (``from``) that starts inside a record of those before it, that record's end (``start``) and the range where it lies (``begin``)."""
    ranges = found.groupBy("file", "_begin").agg(F.min("offset").alias("first"), F.max("_after").alias("arrived"))
    before = F.max("arrived").over(Window.partitionBy("file").orderBy("_begin").rowsBetween(Window.unboundedPreceding, -1))
    wrong = ranges.withColumn("before", before).where("first < before")
    wrong = wrong.groupBy("file").agg(F.min(F.struct("_begin", "before")).alias("w"))
    return wrong.select("file", F.col("w._begin").alias("from"), (F.col("w.before") - F.pmod("w.before", F.lit(split_bytes))).alias("begin"), F.col("w.before").alias("start"))


def page_key(uri: str):
    """The page's id from its record's id."""
    return F.regexp_extract(F.col(uri), r"^<urn:quire:page:(.*)>$", 1)
