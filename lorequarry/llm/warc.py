"""WARC archives with revisit records and a two-level capture index."""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequarry.llm.common import materialize, skew_join

#: Compressed bytes after which a task begins a new archive, and captures in an index block.
ARCHIVE_BYTES, BLOCK_LINES = 64_000_000, 1000
#: Bytes of neighbouring records read together.
READ_BYTES = 8_000_000

_CAPTURE = "url_key string, timestamp string, page_id long, archive string, offset long, length long, digest string, record_type string"
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def filesystem(uri: str):
    """The file system and the path of a URI; file, hdfs, s3 and gs URIs work where pyarrow has that file system."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def payload_digest(payload: Column) -> Column:
    """Base32 SHA-1: five hex digits are four base32 digits."""
    hexed = F.sha1(payload)
    digits = F.concat(*(F.lpad(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)))
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", _B32)


def url_key(url: str | None) -> str:
    """The URL with its host reversed (com,example,www)/path?query), lower-cased, without scheme, default port and fragment."""
    try:
        u = urlsplit((url or "").strip())
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return "-)" + (url or "").lower()
    if re.fullmatch(r"[\d.]+|.*:.*", host) is None:
        host = ",".join(reversed(host.split(".")))
    port_text = f":{port}" if port and port not in (80, 443) else ""
    query = f"?{u.query}" if u.query else ""
    return f"{host}{port_text}){(u.path or '/').lower()}{query.lower()}"


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record as a gzip member. A revisit has the HTTP head of its payload, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    head = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", date), ("WARC-Target-URI", clean), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Page-ID", "" if page_id is None else str(page_id))]
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(refers_to)), ("WARC-Refers-To-Page-ID", str(refers_to))]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member; data is fed in small steps, so no rest is copied whole."""
    view, at = memoryview(data), 0
    while at < len(data):
        opener, out, pos = zlib.decompressobj(31), [], at
        while not opener.eof:
            step = view[pos : pos + 16384]
            if not step:
                raise ValueError("an archive ends inside a record")
            out.append(opener.decompress(step))
            pos += len(step)
        pos -= len(opener.unused_data)
        yield at, pos - at, b"".join(out)
        at = pos


def parse(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload (empty in a revisit) of an uncompressed record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    warc = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(warc["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least_payload: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) as WARC archives below path; returns the captures, one row a record.

    Of pages with equal payloads (by SHA-1) of at least least_payload bytes, that with the smallest id is a response and the
    others are revisits of it; all smaller ones are responses. A null html is an empty payload; a null id can only be a
    response of its own or a revisit; repeated rows of the least id are all responses; a null url is about:blank.

    Least ids are pre-aggregated by digest and joined by skew_join, so a payload with very many pages is split, and each
    payload moves once. Every task attempt writes archives under its own name, and the captures name those of the attempt
    that counts, so a task that runs again does no harm.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload")).withColumn("digest", payload_digest(F.col("payload")))
    firsts = rows.where(F.octet_length("payload") >= least_payload).groupBy("digest").agg(F.min("page_id").alias("least"))
    joined = skew_join(rows, firsts, "digest", "left")
    known = joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("least")) & F.col("least").isNotNull(), F.col("least")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        out, name, size, count = None, "", 0, 0
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                rows = []
                d = part.to_pydict()
                for page, url, payload, digest, first in zip(d["page_id"], d["url"], d["payload"], d["digest"], d["refers_to"], strict=True):
                    if out is None or size >= ARCHIVE_BYTES:
                        if out:
                            out.close()
                        name = f"captures-{task.partitionId():06d}-{task.taskAttemptId():08d}-{count:04d}.warc.gz"
                        fs, base = filesystem(path)
                        fs.create_dir(base, recursive=True)
                        out, size, count = fs.open_output_stream(f"{base}/{name}", compression=None), 0, count + 1
                    data = _record(page, url, payload, digest, first, date)
                    out.write(data)
                    rows.append((url_key(url), re.sub(r"\D", "", date), page, name, size, len(data), digest, "response" if first is None else "revisit"))
                    size += len(data)
                types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["url_key", "timestamp", "page_id", "archive", "offset", "length", "digest", "record_type"])
        if out:
            out.close()

    wanted = known.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, _CAPTURE)
    return materialize(wanted, "captures", f"{path}/captures")


def _told(record: bytes, offset: int, length: int, name: str) -> tuple:
    """What read_archives and read_indexed tell of a record; a response's payload must have the digest that its header names."""
    warc, http, payload = parse(record)
    digest, size = warc["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"])
    if warc["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"{name}: the record at {offset} does not match its digest")
    page, first = warc["WARC-Page-ID"], warc.get("WARC-Refers-To-Page-ID")
    return int(page) if page else None, size, digest, warc["WARC-Type"], int(first) if first else None, offset, length, name


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long, length long, archive string"


def read_archives(captures: DataFrame, path: str) -> DataFrame:
    """Every record of the archives that captures name: page_id, payload_bytes, payload_digest, record_type, refers_to, offset, length, archive.

    A scan without the index. The digest of each response's payload is computed anew and held against its header. One archive
    (about ARCHIVE_BYTES) is in a task's memory at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, base = filesystem(path)
                with fs.open_input_file(f"{base}/{name}") as f:
                    data = f.read()
                rows = []
                for offset, length, record in members(data):
                    rows.append(_told(record, offset, length, name))
                    if len(rows) == 4096:
                        yield _records(rows)
                        rows = []
                if rows:
                    yield _records(rows)

    names = captures.select("archive").distinct()
    n = max(1, min(4096, names.count()))  # an archive is a task's worth of work
    return names.repartition(n).mapInArrow(run, _READ)


def read_indexed(spark: SparkSession, path: str) -> DataFrame:
    """Every record that the index lists, with the columns of read_archives, by range reads.

    Blocks give the captures; those of one archive meet in a task in the order of their offsets, and neighbours are read together,
    READ_BYTES at a time. A record must be the page and of the kind that its index line names.
    """

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = [json.loads(x.partition(" ")[2]) for x in zlib.decompress(data).decode().split("\n")]
                _, page, archive, offset, length, _, kind, _ = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(archive, pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64()), pa.array(page, pa.int64()), pa.array(kind, pa.string())], names=["archive", "offset", "length", "page_id", "record_type"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(path)
        opened, f = None, None
        for batch in batches:
            rows, start = list(zip(*(c.to_pylist() for c in batch.columns), strict=True)), 0
            while start < len(rows):
                name, at = rows[start][:2]
                end = start
                while end < len(rows) and rows[end][0] == name and rows[end][1] == at and (end == start or at + rows[end][2] - rows[start][1] <= READ_BYTES):
                    at, end = at + rows[end][2], end + 1
                if name != opened:
                    if f:
                        f.close()
                    opened, f = name, fs.open_input_file(f"{base}/{name}")
                f.seek(rows[start][1])
                data, out = memoryview(f.read(at - rows[start][1])), []
                for _, offset, length, page, kind in rows[start:end]:
                    found = _told(zlib.decompress(data[offset - rows[start][1] :][:length], 31), offset, length, name)
                    if (found[0], found[3]) != (page, kind):
                        raise ValueError(f"{name}: the record at {offset} is not the one in the index")
                    out.append(found)
                yield _records(out)
                start = end
        if f:
            f.close()

    listed = spark.read.parquet(f"{path}/index").select("data").mapInArrow(lines, "archive string, offset long, length long, page_id long, record_type string")
    return listed.repartition("archive").sortWithinPartitions("archive", "offset").mapInArrow(run, _READ)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "offset", "length", "archive"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def build_index(captures: DataFrame, path: str) -> None:
    """Write the two levels: index, compressed blocks of BLOCK_LINES sorted capture lines, and directory, each block's key range.

    Captures are range-partitioned by (key, timestamp, page), so that a host or URL with very many captures is split too. The
    line of a revisit also holds the place of the response with its payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, lines = TaskContext.get().partitionId(), 0, []

        def block() -> pa.RecordBatch:
            keys = [x[0] for x in lines]
            data = zlib.compress("\n".join(f"{k} {json.dumps(v)}" for k, v in lines).encode(), 6)
            return pa.RecordBatch.from_arrays([pa.array([keys[0]]), pa.array([keys[-1]]), pa.array([len(lines)], pa.int64()), pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([data], pa.binary())], names=["first_key", "last_key", "n", "part", "number", "data"])

        for batch in batches:
            d = batch.to_pydict()
            for key, *rest in zip(*(d[k] for k in ("url_key", "timestamp", "page_id", "archive", "offset", "length", "digest", "record_type", "whole")), strict=True):
                rest[-1] = rest[-1] and list(rest[-1].values())
                lines.append((key.replace(" ", "%20"), rest))
                if len(lines) == BLOCK_LINES:
                    yield block()
                    number, lines = number + 1, []
        if lines:
            yield block()

    order = ["url_key", "timestamp", "page_id", "archive", "offset"]
    place = F.struct("page_id", "archive", "offset", "length")
    responses = captures.where("record_type = 'response'").groupBy("digest").agg(F.min(place).alias("r"))
    revisits = skew_join(captures.where("record_type = 'revisit'"), responses, "digest").select(*captures.columns, F.struct("r.archive", "r.offset", "r.length").alias("whole"))
    responses = captures.where("record_type = 'response'").withColumn("whole", F.lit(None).cast("struct<archive:string,offset:bigint,length:bigint>"))
    blocks = responses.unionByName(revisits).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "first_key string, last_key string, n long, part int, number int, data binary")
    stored = materialize(blocks, "index", f"{path}/index")
    stored.select("first_key", "last_key", "n", "part", "number").write.parquet(f"{path}/directory")


def lookup(spark: SparkSession, path: str, url: str) -> Iterator[tuple[dict, bytes]]:
    """The captures of a URL with their payloads: directory, blocks, binary search, then range reads of the archives.

    A revisit comes with the payload of the response it refers to, whatever URL that has. Captures come one after the other, so
    a URL may have very many.
    """
    key = url_key(url).replace(" ", "%20")
    within = (F.col("first_key") <= key) & (F.col("last_key") >= key)
    fs, base = filesystem(path)

    def record(archive: str, offset: int, length: int) -> bytes:
        with fs.open_input_file(f"{base}/{archive}") as f:
            f.seek(offset)
            return parse(zlib.decompress(f.read(length), 31))[2]

    for at in spark.read.parquet(f"{path}/directory").where(within).orderBy("part", "number").toLocalIterator():
        (row,) = spark.read.parquet(f"{path}/index").where((F.col("part") == at["part"]) & (F.col("number") == at["number"])).select("data").collect()
        lines = zlib.decompress(row["data"]).decode().split("\n")
        keys = [line.partition(" ")[0] for line in lines]
        for line in lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]:
            timestamp, page, archive, offset, length, digest, kind, whole = json.loads(line.partition(" ")[2])
            yield {"timestamp": timestamp, "page_id": page, "digest": digest, "record_type": kind}, record(*(whole or (archive, offset, length)))
