"""WARC archives: records are written with an index beside them, and read back by sorted byte ranges.

A page becomes a record of its own gzip member. Pages with an equal payload become one
response and revisits of it. The index has a row for each record (where it is, how long,
URL, digest); readers select rows of the index first and then read only those ranges,
neighbouring ones at once.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, materialise, shared_dir

#: Parts that the rows of one payload are dealt into while its largest id is sought.
SALTS = 1024
#: A new archive is begun after so many bytes.
ROLL = 1_000_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, url string, digest string, record_type string, record_id string, page_id long"
RECORD = "file string, offset long, record_type string, record_id string, url string, digest string, payload_bytes long, refers_to string, payload binary"


def base32_sha1(payload: bytes) -> str:
    """SHA-1 in base32, as WARC headers have it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int | None) -> str:
    """The record's URN; an id that is null gives an empty last part. Pages with the same id have the same."""
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name):
    """The page id in a column of record names; null where there is none."""
    return F.regexp_extract(name, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def _header(lines: list[tuple[str, str]], first: str) -> bytes:
    # a line end within a value would begin a new header
    return (first + "\r\n" + "".join(f"{k}: {v.replace(chr(13), '%0D').replace(chr(10), '%0A')}\r\n" for k, v in lines) + "\r\n").encode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One record, uncompressed: a response with HTTP headers and payload, or a revisit with HTTP headers only."""
    block = _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    if kind == "response":
        block += payload
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record_name(page_id)), ("WARC-Date", date)]
    lines += [("WARC-Target-URI", url)] if url is not None else []
    lines += [("WARC-Payload-Digest", f"sha1:{digest}")]
    lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_to)] if kind == "revisit" else []
    lines += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return _header(lines, "WARC/1.1") + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """A record's type, name, URL, digest, payload and referred record, from its bytes.

    The payload is what follows the HTTP header of an HTTP block, else the block. A
    response's digest is taken from the payload itself and has to agree with the header;
    a revisit has the digest and length that its headers state.
    """
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    field = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(field.get("content-length", len(rest)))
    block = rest[:size]
    if len(block) < size:
        raise ValueError(f"record {field.get('warc-record-id')} ends early")
    length = None
    if field.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        said = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        length = int(said[0]) if said else None
    else:
        payload = block
    kind, digest = field.get("warc-type"), field.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "revisit":
        payload = None
    else:
        length, own = len(payload), base32_sha1(payload)
        if digest is not None and own != digest:
            raise ValueError(f"record {field.get('warc-record-id')} has another digest than it says")
        digest = own
    return {"record_type": kind, "record_id": field.get("warc-record-id"), "url": field.get("warc-target-uri"), "digest": digest, "payload_bytes": length, "refers_to": field.get("warc-refers-to"), "payload": payload}


def deduplicated(pages: DataFrame, least: int = 0, salts: int = SALTS) -> DataFrame:
    """``pages`` (page_id, url, html) with the column refers_to: the largest page_id of the pages with an equal payload, if this one isn't it.

    Payloads are equal if their SHA-1, SHA-256 and length are. Payloads of fewer than ``least`` bytes stay by
    themselves. Null ids are below all others; pages that tie for the largest id are all
    kept. The rows of one payload are dealt into ``salts`` parts, so a payload that a third of the pages have
    is no single task: each part's largest id is taken, then those of the parts, and the join goes by part.
    """
    pages = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    keyed = pages.withColumn("_key", F.concat(F.unhex(F.sha1("html")), F.unhex(F.sha2("html", 256)))).withColumn("_part", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    small = keyed.where(F.octet_length("html") >= least).select("_key", "_part", "page_id")
    parts = small.groupBy("_key", "_part").agg(F.max("page_id").alias("_max"), F.min(F.coalesce("page_id", F.lit(-(1 << 63)))).alias("_min"))
    largest = parts.groupBy("_key").agg(F.max("_max").alias("refers_to"), F.min("_min").alias("_low"), F.collect_list("_part").alias("_parts"))
    # only payloads of several ids can have revisits; a list of parts has ``salts`` members at most
    several = largest.where("_low < refers_to").select("_key", F.explode("_parts").alias("_part"), "refers_to")
    several = materialise(several, "payloads")
    out = keyed.join(several, ["_key", "_part"], "left")
    return out.select("page_id", "url", "html", F.when(F.col("page_id").eqNullSafe(F.col("refers_to")), None).otherwise(F.col("refers_to")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least: int = 0, roll: int = ROLL, level: int = 6, date: datetime | None = None) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as WARC archives into ``folder`` (a URI or path that all executors reach) and returns their index, INDEX.

    Each task writes archives of its own, of about ``roll`` bytes at most, under a name that no other attempt has.
    A record is a gzip member. The index is written when its task has ended, so an archive of an attempt
    that was lost has no row in it and is never read. Null html is an empty payload, a null
    URL leaves the header out.
    """
    stamp = (date or datetime(1970, 1, 1, tzinfo=timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    folder = folder.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]):
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        out, name, offset = None, None, 0
        try:
            for batch in chunks(batches, "html"):
                rows = []
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or offset >= roll:
                        if out is not None:
                            out.close()
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{at}/{name}", compression=None)
                        info = zlib.compressobj(level, wbits=31)
                        lines = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", stamp), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", "0")]
                        offset = out.write(info.compress(_header(lines, "WARC/1.1") + b"\r\n\r\n") + info.flush())
                    kind, digest = "response" if refers_to is None else "revisit", base32_sha1(html)
                    member = zlib.compressobj(level, wbits=31)
                    raw = record(kind, page_id, url, html, digest, None if refers_to is None else record_name(refers_to), stamp)
                    length = out.write(member.compress(raw) + member.flush())
                    rows.append((f"{folder}/{name}", offset, length, url, digest, kind, record_name(page_id), page_id))
                    offset += length
                if rows:
                    names = [x.split()[0] for x in INDEX.split(", ")]
                    longs = {"offset", "length", "page_id"}
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in longs else pa.string()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)
        finally:
            if out is not None:
                out.close()

    return materialise(deduplicated(pages, least).mapInArrow(write, INDEX), "warc-index")


def members(stream, block: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, bytes) of each gzip member of a stream, read block by block."""
    offset, data = 0, b""
    while True:
        if not data and not (data := stream.read(block)):
            return
        unzip, parts, length = zlib.decompressobj(wbits=31), [], 0
        while not unzip.eof:
            if not data and not (data := stream.read(block)):
                raise ValueError(f"the member at {offset} ends early")
            parts.append(unzip.decompress(data))
            length += len(data) - len(unzip.unused_data)
            data = unzip.unused_data
        yield offset, length, b"".join(parts)
        offset += length


def index_archives(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The index of archives that others have written: ``files`` has their URIs in the column file. An archive is read by one task, as a stream.

    Records other than responses, revisits and resources (information, requests) have no row. page_id is read from record names as
    record_name gives them, else null.
    """

    def scan(batches):
        for batch in batches:
            for name in batch.column("file").to_pylist():
                store, at = fs.FileSystem.from_uri(name)
                rows = []
                with store.open_input_stream(at, compression=None) as stream:
                    for offset, length, raw in members(stream):
                        if not raw.startswith(b"WARC/"):
                            raise ValueError(f"{name}: no record at {offset}")
                        lines = dict(x.split(": ", 1) for x in raw.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:] if ": " in x)
                        if lines.get("WARC-Type") in ("response", "revisit", "resource"):
                            r = parsed(raw)
                            rows.append((name, offset, length, r["url"], r["digest"], r["record_type"], r["record_id"]))
                names = [x.split()[0] for x in INDEX.split(", ")[:-1]]
                columns = zip(*rows, strict=True) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in ("offset", "length") else pa.string()) for n, c in zip(names, columns, strict=True)], names)

    found = files.select("file").distinct().mapInArrow(scan, INDEX.rsplit(", ", 1)[0])
    return found.withColumn("page_id", page_of(F.col("record_id")))


def runs(rows: list[tuple[str, int, int]], gap: int, most: int) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(file, begin, end, [(offset, length)]) of sorted ranges, those at most ``gap`` bytes apart in one run of about ``most`` bytes."""
    file, begin, end, members_ = None, 0, 0, []
    for name, offset, length in rows:
        if name != file or offset - end > gap or offset + length - begin > most:
            if members_:
                yield file, begin, end, members_
            file, begin, end, members_ = name, offset, offset, []
        members_.append((offset, length))
        end = max(end, offset + length)
    if members_:
        yield file, begin, end, members_


def read_records(index: DataFrame, payload: bool = True, gap: int = 65_536, most: int = 8_000_000, task_bytes: int = 128_000_000) -> DataFrame:
    """The records of selected rows of an index, as RECORD; without ``payload`` that column is null.

    The rows are dealt out by ranges of (file, offset) and sorted, so a task reads forward; ranges at most
    ``gap`` bytes apart are read at once, ``most`` bytes a time (or one record, if that's longer). A row that is
    selected twice is read once and given twice. Each response's digest is checked.
    """
    selected = index.select("file", "offset", "length")
    total = selected.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // task_bytes))
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = {"offset": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def read(batches):
        opened, store, stream = None, None, None
        for batch in batches:
            rows, held = [], 0
            for file, begin, end, found in runs(list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True)), gap, most):
                if file != opened:
                    store, at = fs.FileSystem.from_uri(file)
                    stream, opened = store.open_input_file(at), file
                data = stream.read_at(end - begin, begin)
                for offset, length in found:
                    raw = zlib.decompress(data[offset - begin : offset - begin + length], wbits=31)
                    r = parsed(raw) | {"file": file, "offset": offset}
                    rows.append([r[n] if n != "payload" or payload else None for n in names])
                    held += r["payload_bytes"] if payload and r["payload"] else 0
                    if len(rows) == 1000 or held > most:
                        yield _batch(rows)
                        rows, held = [], 0
            if rows:
                yield _batch(rows)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)

    return selected.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(read, RECORD)


def archive_folder(spark: SparkSession, label: str = "warc") -> str:
    """A new folder for archives in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the html of ``pages`` as WARC archives, reads them back through their index and says what the records hold.

    A row for each page: page_id, payload_bytes and payload_digest of the full payload, record_type (response or
    revisit), refers_to (the page whose response a revisit refers to). Null html is an
    empty payload; repeated and null ids as in ``deduplicated``; other columns of the table aren't read.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    index = write_archives(pages, archive_folder(spark))
    records = read_records(index, payload=False)
    return records.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", page_of(F.col("refers_to")).alias("refers_to"))


#: The same by SQL: base32 takes five bits of the SHA-1 a time.
OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest FROM h),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to FROM m
"""
