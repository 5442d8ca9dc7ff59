"""A deterministic sharded WARC writer and its reader.

Writing:

1. Digests. Records of equal payloads of ``REVISIT_BYTES`` or more share one response, the
   one with the smallest page_id; a small table has (page_id, digest, first) of the others. A digest that
   many records have isn't shuffled.
2. Range sort. Bounds on page_id come from a sample that depends on the ids alone,
   so the shards are the same in every run; their number follows the bytes, and each is a task of its own. An id that holds
   more rows than a shard (null, above all) is cut by a hash of the digest. Records and the rows of that
   small table go through one shuffle by shard, sorted by page_id with the small rows
   first: the writer then knows of each record whether it is a revisit, and payloads are
   moved once and never joined.
3. Each shard is written as gzip members, one per record, with headers and digests made
   anew; a file is closed when its compressed size reaches ``roll_bytes``.
4. Commit. A file gets a temporary name of its attempt and is renamed when whole;
   equal attempts write equal bytes. The manifest (names, sizes, checksums) is
   renamed into place last. Readers open what the manifest names and nothing else.

Reading: files of the manifest are dealt to tasks, read member by member and checked
against the digests in their headers.

Null html is an empty payload, a null url has no target header, null page_ids sort last
and have no header. Repeated (page_id, payload) rows: the first is the
response, the others revisit it; they lie in one shard. Very long payloads are one record each, held in memory one at a time. An empty table gives a manifest without files. Other
columns of the table are not read. The folder is opened by ``pyarrow.fs``, so its scheme must be one that pyarrow knows.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waytrace.llm.common import id_ranges, part_number, shared_dir, skew_join, staged, table

REVISIT_BYTES = 100
SHARD_BYTES = 32 << 20
ROLL_BYTES = 64 << 20
LEVEL = 5
DATE = "2024-01-01T00:00:00Z"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "name string, records long, bytes long, sha256 string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}:{digest}'.encode()).digest()[:16])}>"


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    headers = [*headers, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode()) + squeeze.compress(block) + squeeze.compress(b"\r\n\r\n") + squeeze.flush()


def _uri(url: str | None) -> list[tuple[str, str]]:
    return [] if url is None else [("WARC-Target-URI", "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))]


def response(page_id: int | None, url: str | None, payload: bytes, digest: str) -> bytes:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    return _member([("WARC-Type", "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE), *_uri(url), *_page(page_id, len(payload), digest), ("Content-Type", "application/http; msgtype=response")], block)


def revisit(page_id: int | None, url: str | None, size: int, digest: str, first: int | None) -> bytes:
    refers = [] if first is None else [("X-Refers-To-Page", str(first))]
    return _member([("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE), ("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", record_id(first, digest)), *refers, *_uri(url), *_page(page_id, size, digest), ("Content-Type", "application/http; msgtype=response")], b"HTTP/1.1 200 OK\r\n\r\n")


def _page(page_id: int | None, size: int, digest: str) -> list[tuple[str, str]]:
    return ([] if page_id is None else [("X-Page-Id", str(page_id))]) + [("X-Payload-Length", str(size)), ("WARC-Payload-Digest", f"sha256:{digest}")]


class _Shard:
    """The open file of one shard."""

    def __init__(self, store: fs.FileSystem, folder: str, shard: int) -> None:
        self.store, self.folder, self.shard, self.part, self.out = store, folder, shard, 0, None

    def add(self, member: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:05d}-{self.part:04d}.warc.gz"
            self.temporary = f"{self.folder}/_tmp-{uuid.uuid4().hex}-{self.name}"
            self.out, self.records, self.size, self.sum = self.store.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
            info = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, self.name)), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            self._put(info)
        self._put(member)
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sum.update(data)
        self.size += len(data)

    def close(self) -> list[tuple]:
        if self.out is None:
            return []
        self.out.close()
        self.store.move(self.temporary, f"{self.folder}/{self.name}")
        self.out, self.part = None, self.part + 1
        return [(self.name, self.records, self.size, self.sum.hexdigest())]


def write_warc(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> list[dict]:
    """Write ``pages`` (page_id, url, html) below ``folder`` and return the manifest's rows."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    small = staged(base.select("page_id", "digest", "size"), "digests")
    total, n = small.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    shards = max(1, -(-total // shard_bytes))
    ranges = id_ranges(small, "page_id", shards, max(1, -(-n // shards)))

    large = small.where(F.col("size") >= REVISIT_BYTES).select("page_id", "digest")
    groups = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = skew_join(large, staged(groups, "groups"), "digest", counts="n").where("page_id > first OR (page_id IS NULL AND first IS NOT NULL)").select("page_id", "digest", "first")
    rows = base.select(F.lit(1).alias("kind"), "page_id", "digest", F.lit(None).cast("long").alias("first"), "url", "payload", "size")
    hints = later.select(F.lit(0).alias("kind"), "page_id", "digest", "first", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("payload"), F.lit(0).cast("long").alias("size"))
    both = part_number(rows.unionByName(hints), "page_id", ranges, F.xxhash64("digest"), "shard")
    sorted_rows = (
        both.select("shard", "page_id", "kind", "digest", "first", "url", "payload", "size")
        .repartitionById(ranges[2], F.col("shard"))
        .sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "kind", "digest", "url")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        now, page, known, done = None, object(), {}, set()
        for batch in batches:
            closed = []
            for shard, page_id, kind, digest, first, url, payload, size in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or now.shard != shard:
                    closed += now.close() if now else []
                    now, page = _Shard(store, path, shard), object()
                if page_id != page:
                    page, known, done = page_id, {}, set()
                if kind == 0:
                    known[digest] = first
                    continue
                if size >= REVISIT_BYTES and (digest in known or digest in done):
                    now.add(revisit(page_id, url, size, digest, known.get(digest, page_id)))
                else:
                    now.add(response(page_id, url, payload.encode(), digest))
                    done.add(digest)
                if now.size >= roll_bytes:
                    closed += now.close()
            yield _manifest(closed)
        yield _manifest(now.close() if now else [])

    def _manifest(files: list[tuple]) -> pa.RecordBatch:
        schema = pa.schema([("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, f, strict=True)) for f in files], schema=schema)

    files = sorted((r.asDict() for r in sorted_rows.mapInArrow(write, MANIFEST).collect()), key=lambda r: r["name"])
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/_tmp-manifest") as out:
        out.write(json.dumps({"date": DATE, "files": files}, sort_keys=True).encode())
    store.move(f"{path}/_tmp-manifest", f"{path}/manifest.json")
    return files


def members(stream: pa.NativeFile) -> Iterator[bytes]:
    """The records of a file of gzip members, one in memory at a time."""
    squeezed = b""
    while squeezed := squeezed or stream.read(1 << 18):
        one, parts = zlib.decompressobj(31), []
        while True:
            parts.append(one.decompress(squeezed))
            if one.eof:
                break
            if not (squeezed := stream.read(1 << 18)):
                raise ValueError("the file ends inside a record")
        squeezed = one.unused_data
        yield b"".join(parts)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; the block's digest is checked."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(headers["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"damaged record {headers.get('WARC-Record-ID')}")
    return headers, block


def read_warc(spark: SparkSession, folder: str, files: list[dict] | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record in the files of the manifest."""
    if files is None:
        store, path = fs.FileSystem.from_uri(folder)
        with store.open_input_stream(f"{path}/manifest.json") as held:
            files = json.loads(held.read())["files"]
    names = spark.createDataFrame([(f["name"], f["sha256"]) for f in files], "name string, sha256 string").repartition(max(1, len(files)))
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    number = lambda text: None if text is None else int(text)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for name in (n for batch in batches for n in batch.column(0).to_pylist()):
            found = []
            with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                for headers, block in map(parse, members(stream)):
                    if headers["WARC-Type"] == "warcinfo":
                        continue
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    if headers["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(headers["X-Payload-Length"]):
                            raise ValueError(f"{name}: the payload of {headers['WARC-Record-ID']} is damaged")
                    found.append((number(headers.get("X-Page-Id")), int(headers["X-Payload-Length"]), digest, headers["WARC-Type"], number(headers.get("X-Refers-To-Page"))))
                    if len(found) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)
                        found = []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)

    return names.mapInArrow(read, RECORDS)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all ``pages`` as WARC files in the shared folder, then read these."""
    folder = f"{shared_dir(spark)}/waytrace-warc-{uuid.uuid4().hex}"
    return read_warc(spark, folder, write_warc(table(spark, sf_dir, "pages"), folder))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
q AS (SELECT page_id, n, sha256(body) AS digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first,
             row_number() OVER (PARTITION BY digest ORDER BY page_id NULLS LAST) AS nth FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND nth > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND nth > 1 THEN first END AS refers_to
FROM r
"""
