"""WARC archives with a two-level capture index.

Records are gzip members, one after another in an archive file for each writing task. The index holds a line for each
record, sorted by the page's key (its host reversed, then its path) and cut into compressed blocks; the sparse directory
has each block's first key and place. A lookup bisects the directory, reads the blocks' ranges, bisects their lines
and reads the records' ranges.

Files are written and read by executors through pyarrow's file systems, in a folder below spark.checkpoint.dir.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from porelake.llm.common import shared_dir, small_batches, staged

#: Lines of an index block; bytes of records that a reading task is given.
BLOCK_LINES, READ_BYTES = 512, 4 << 20
#: Payloads of fewer bytes are written in full each time.
LEAST_REVISIT = 0
#: The tables have no capture time, so all records carry this one.
DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Archive:
    path: str


def url_key(url: str | None) -> str:
    """The host's labels reversed, `)` and the rest, in lower case: pages of a site sort together. Null gives `-`."""
    if url is None:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname, parts.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    port_text = f":{port}" if port and port != {"http": 80, "https": 443}.get(parts.scheme.lower()) else ""
    return f"{','.join(reversed(host.split('.')))}{port_text}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A record as a gzip member. A revisit's block has the HTTP header only, with the full payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or 'urn:none', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{'null' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(head).encode() + block + b"\r\n\r\n", 4, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC header, HTTP header, payload) of a gzip member; a response whose payload isn't that of its digest is an error."""
    data = gzip.decompress(member)
    end = data.index(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in data[:end].decode().split("\r\n")[1:])
    block = data[end + 4 : end + 4 + int(head["Content-Length"])]
    split = block.index(b"\r\n\r\n")
    http, payload = block[:split], block[split + 4 :]
    if head["WARC-Type"] == "response" and head["WARC-Payload-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode():
        raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
    return head, http, payload


class _Writer:
    """A task's file, under a new name on every attempt."""

    def __init__(self, folder: str, suffix: str) -> None:
        self.name, self.at = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}{suffix}", 0
        fs, path = pafs.FileSystem.from_uri(f"{folder}/{self.name}")
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.file = fs.open_output_stream(path, compression=None)

    def add(self, data: bytes) -> int:
        self.file.write(data)
        self.at += len(data)
        return self.at - len(data)

    def close(self) -> None:
        self.file.close()


class _Ranges:
    """Range reads from the files of a folder, the last file kept open."""

    def __init__(self, folder: str) -> None:
        self.folder, self.name, self.file = folder, None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            if self.file is not None:
                self.file.close()
            fs, path = pafs.FileSystem.from_uri(f"{self.folder}/{name}")
            self.name, self.file = name, fs.open_input_file(path)
        return self.file.read_at(length, offset)


_RECORDS = "page_id long, key string, file string, offset long, length int"
_DIRECTORY = "first_key string, last_key string, file string, offset long, length int, lines int"


def write_archive(pages: DataFrame, least_revisit: int = LEAST_REVISIT) -> Archive:
    """A record for each row of pages, with its index, in a new folder of the shared directory.

    Of the rows with equal payloads of at least least_revisit bytes, those with the largest page_id are responses (repeated
    rows of that id too), the others revisits; a null id is never the largest unless all are null. Null html is the empty
    payload. Digests are aggregated before the join, so a payload that many pages share costs one row for each task.
    """
    spark = pages.sparkSession
    small_batches(spark)
    path = shared_dir(spark)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(f"{path}/archives", ".warc.gz")
        for batch in batches:
            keys, offsets, lengths = [], [], []
            for page_id, url, html, sha1, winner, revisit in zip(*(batch.column(i).to_pylist() for i in range(6))):
                member = record(page_id, url, (html or "").encode("utf-8", "replace"), bytes.fromhex(sha1), winner, revisit)
                keys.append(url_key(url)), offsets.append(writer.add(member)), lengths.append(len(member))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string()), pa.array([writer.name] * n, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int32())], ["page_id", "key", "file", "offset", "length"])
        writer.close()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, held = _Writer(f"{path}/index", ".cdxz"), []

        def out(lines: list[tuple[str, str]]) -> pa.RecordBatch:
            data = zlib.compress("\n".join(text for _, text in lines).encode(), 6)
            row = [lines[0][0], lines[-1][0], writer.name, writer.add(data), len(data), len(lines)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32()))], ["first_key", "last_key", "file", "offset", "length", "lines"])

        for batch in batches:
            for key, file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(4))):
                held.append((key, json.dumps([key, file, offset, length])))
                if len(held) == BLOCK_LINES:
                    yield out(held)
                    held = []
        if held:
            yield out(held)
        writer.close()

    rows = pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "cast(html as string) as html").withColumn("sha1", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    winners = staged(rows.where(F.octet_length(F.coalesce("html", F.lit(""))) >= least_revisit).groupBy("sha1").agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))  # written first: AQE splits the hot keys of a join of plain shuffles
    revisit = F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner"))
    typed = rows.join(winners, "sha1", "left").select("page_id", "url", "html", "sha1", "winner", revisit.alias("revisit"))
    written = staged(typed.mapInArrow(records, _RECORDS))
    order = ["key", "page_id", "file", "offset"]
    written.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "file", "offset", "length").mapInArrow(blocks, _DIRECTORY).write.parquet(f"{path}/directory")
    return Archive(path)


def lookup(spark: SparkSession, archive: Archive, keys: DataFrame) -> DataFrame:
    """keys (key string) -> (key, file, offset, length): the place of every record that has one of the keys.

    Keys may repeat and may have no record; null keys and an empty table give no rows. Each index file holds a range of
    keys, so a key goes to the files whose range has it (a bisection over a row for each file), meets their part of the
    directory there, and is bisected in it and then in the blocks that are left. A key of many records has several files.
    """
    directory = spark.read.schema(_DIRECTORY).parquet(f"{archive.path}/directory")
    wanted = keys.select("key").where("key is not null").distinct()
    index = f"{archive.path}/index"
    ends = directory.groupBy("file").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last")).orderBy("first", "last", "file").collect()
    shared = spark.sparkContext.broadcast(([r["first"] for r in ends], [r["last"] for r in ends], [r["file"] for r in ends]))

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts, names = shared.value
        for batch in batches:
            got = [(key, names[i]) for key in batch.column(0).to_pylist() for i in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.string()) for k in (0, 1)], ["key", "file"])

    def places(own: pa.Table, part: pa.Table) -> pa.Table:
        rows = sorted(zip(*(part.column(k).to_pylist() for k in ("first_key", "last_key", "offset", "length"))))
        firsts, lasts = [r[0] for r in rows], [r[1] for r in rows]
        got = [(key, name, *rows[i][2:]) for key, name in zip(own.column("key").to_pylist(), own.column("file").to_pylist()) for i in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key))]
        return pa.table([pa.array([x[k] for x in got], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int32()))], names=["key", "file", "offset", "length"])

    small_batches(spark)
    out = wanted.mapInArrow(files, "key string, file string").groupBy("file").cogroup(directory.groupBy("file")).applyInArrow(places, "key string, file string, offset long, length int")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, at, lines, keys_in = _Ranges(index), None, [], []
        for batch in batches:
            got = []
            for key, file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if at != (file, offset):
                    at = (file, offset)
                    lines = [json.loads(x) for x in zlib.decompress(ranges.read(file, offset, length)).decode().split("\n")]
                    keys_in = [x[0] for x in lines]
                got.extend(lines[bisect.bisect_left(keys_in, key) : bisect.bisect_right(keys_in, key)])
            cols = list(zip(*got)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int32()))], ["key", "file", "offset", "length"])

    return out.repartition("file", "offset").sortWithinPartitions("file", "offset", "key").mapInArrow(entries, "key string, file string, offset long, length int")


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def read_records(archive: Archive, places: DataFrame, payloads: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of the records at places (file, offset, length).

    payload is null for a revisit; its length and digest are those of the payload that it refers to. Without payloads they
    are read and verified, but don't leave the worker. Tasks get ranges of files with about READ_BYTES of records.
    """
    archives = f"{archive.path}/archives"
    number = lambda text: None if text == "<urn:page:null>" else int(text[len("<urn:page:") : -1])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = _Ranges(archives)
        for batch in batches:
            got: list[tuple] = []
            for file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                head, http, payload = parse_record(ranges.read(file, offset, length))
                revisit = head["WARC-Type"] == "revisit"
                size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: ")).split()[1])
                refers = number(head["WARC-Refers-To"]) if revisit else None
                got.append((number(head["WARC-Record-ID"]), head["WARC-Target-URI"], size, head["WARC-Payload-Digest"][5:], head["WARC-Type"], refers, None if revisit or not payloads else payload.decode()))
            cols = list(zip(*got)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]).select(names)

    names = [c.split()[0] for c in _READ.split(", ")][: 7 if payloads else 6]
    n = 1 + int(places.agg(F.sum("length")).first()[0] or 0) // READ_BYTES
    small_batches(places.sparkSession)
    return places.select("file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(rows, ", ".join(_READ.split(", ")[: len(names)]))


def keys_of(pages: DataFrame) -> DataFrame:
    """(key): the index keys of all urls of pages."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string())], ["key"])

    return pages.selectExpr("cast(url as string) as url").distinct().mapInArrow(rows, "key string")


def round_trip(pages: DataFrame, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): archives pages, looks all their keys up in the index and reads the records back.

    Null html is the empty payload, null urls have a key of their own; repeated rows are records of their own, and equal ids
    with the largest one all responses; null ids lose to any other. Payloads of any length are written whole. An empty table
    gives no rows; other columns are not looked at.
    """
    archive = write_archive(pages, least_revisit)
    found = staged(lookup(pages.sparkSession, archive, keys_of(pages)))
    return read_records(archive, found, payloads=False).drop("url")


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
w AS (SELECT d, max(page_id) AS m FROM p GROUP BY d),
a AS (SELECT d, array_to_string(list_transform(range(0, 8), lambda i: list_transform([CAST('0x' || substr(d, 5 * i + 1, 5) AS INTEGER)], lambda v:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v >> 15) % 32, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v >> 10) % 32, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v >> 5) % 32, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + v % 32, 1))[1]), '') AS b32 FROM w)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, a.b32 AS payload_digest,
    CASE WHEN p.page_id = w.m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN p.page_id = w.m THEN NULL ELSE w.m END AS refers_to
FROM p JOIN w ON p.d = w.d JOIN a ON p.d = a.d
"""
