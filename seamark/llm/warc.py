"""A deterministic sharded WARC writer, and its reader.

Pages are range-partitioned and sorted by page_id; one shard is one range, and there are as many as SHARD_BYTES asks for. A shard's
records go, each a gzip member of its own, to files that roll by compressed size. Headers and digests are made anew from the payload; dates and record ids follow from the
input alone, so a task that runs again writes the same bytes. A file is written under a temporary name and moved when whole; the
list of files is a manifest, itself moved into place last. Only what the manifest names is read.

Of equal payloads of at least 1000 bytes the one with the largest page_id is a response and the others are revisits.

Defined results: a null html is the empty payload; a null page_id is the least and never the response of others; rows repeated
with the page_id of the response are responses too; a null url is urn:x-unknown; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Ranges, delete_folder, join_dealt, new_folder, small_batches

#: Payload bytes of a shard, compressed bytes of a file and of what one task reads, least payload of a revisit, zlib level.
SHARD_BYTES, FILE_BYTES, READ_BYTES, REVISIT_BYTES, LEVEL = 24 << 20, 8 << 20, 64 << 20, 1_000, 6
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed by the format
MANIFEST = "name string, shard int, part int, records long, bytes long, sha256 string"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    uri = (url or "urn:x-unknown").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


class _Shard:
    """The open file of a shard; `close` moves it into place and notes it."""

    def __init__(self, files: pafs.FileSystem, folder: str, shard: int, limit: int, notes: list):
        self.files, self.folder, self.shard, self.limit, self.notes = files, folder, shard, limit, notes
        self.part, self.stream = 0, None

    def add(self, record: bytes) -> None:
        member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        data = member.compress(record) + member.flush()
        if self.stream and self.bytes + len(data) > self.limit:
            self.close()
        if not self.stream:
            self.name = f"pages-{self.shard:05d}-{self.part:05d}.warc.gz"
            self.temporary = f"{self.folder}/_{self.name}.{uuid.uuid4().hex}"
            self.stream, self.bytes, self.records, self.sum = self.files.open_output_stream(self.temporary), 0, 0, hashlib.sha256()
        self.stream.write(data)
        self.sum.update(data)
        self.bytes += len(data)
        self.records += 1

    def close(self) -> None:
        if self.stream:
            self.stream.close()
            self.files.move(self.temporary, f"{self.folder}/{self.name}")
            self.notes.append({"name": self.name, "shard": self.shard, "part": self.part, "records": self.records, "bytes": self.bytes, "sha256": self.sum.hexdigest()})
            self.stream, self.part = None, self.part + 1


_MANIFEST_SCHEMA = pa.schema([("name", pa.string()), ("shard", pa.int32()), ("part", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])


def _write_batches(folder: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by shard, page_id and kind: what a page refers to comes before it."""
        files, path = pafs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        shard, page, refers, notes = None, object(), {}, []
        for b in batches:
            for r in b.to_pylist():
                if shard is None or r["shard"] != shard.shard:
                    if shard:
                        shard.close()
                    shard, page = _Shard(files, path, r["shard"], limit, notes), object()
                if r["page_id"] != page:
                    page, refers = r["page_id"], {}
                if r["kind"] == 0:
                    refers[r["digest"]] = r["refers_to"]
                    continue
                shard.add(make_record(page, r["url"], (r["html"] or "").encode(), r["digest"], refers.get(r["digest"])))
            if notes:
                yield pa.RecordBatch.from_pylist(notes, schema=_MANIFEST_SCHEMA)
                notes.clear()
        if shard:
            shard.close()
        yield pa.RecordBatch.from_pylist(notes, schema=_MANIFEST_SCHEMA)

    return run


class WarcArchive:
    """Archives in `path`, a folder that all executors share (in the checkpoint folder if not given)."""

    def __init__(self, spark: SparkSession, path: str | None = None, file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES):
        self.spark, self.path, self.file_bytes, self.shard_bytes = spark, path or new_folder(spark, "warc"), file_bytes, shard_bytes
        small_batches(spark)

    def write(self, pages: DataFrame) -> None:
        payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
        pages = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n"))
        total, rows = pages.agg(F.sum("n"), F.count("*")).first()
        ranges = Ranges(pages, "page_id", rows, max(1, min(-(-(total or 0) // self.shard_bytes), rows)))
        groups = pages.where(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1 and refers_to is not null")
        large = pages.where(F.col("n") >= REVISIT_BYTES).select("page_id", "digest")
        again = join_dealt(large, groups.select("digest", "refers_to"), "digest", F.col("page_id"), counts=groups.select("digest", F.col("copies").alias("n"))).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
        both = pages.withColumn("kind", F.lit(1)).unionByName(again.distinct().withColumn("kind", F.lit(0)), allowMissingColumns=True)
        both = both.select(ranges.column().alias("shard"), "page_id", "kind", "digest", "refers_to", "url", "html")
        written = both.repartitionById(ranges.n, F.col("shard")).sortWithinPartitions("shard", "page_id", "kind", "digest").mapInArrow(_write_batches(self.path, self.file_bytes), MANIFEST)
        written.write.mode("overwrite").json(f"{self.path}/_manifest-new")
        self._commit()

    def _commit(self) -> None:
        """Drop what lost tasks left under temporary names, then put the manifest in place."""
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        files = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for left in files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/_pages-*")):
            files.delete(left.getPath(), False)
        delete_folder(self.spark, f"{self.path}/_manifest")
        files.rename(jvm.org.apache.hadoop.fs.Path(f"{self.path}/_manifest-new"), jvm.org.apache.hadoop.fs.Path(f"{self.path}/_manifest"))

    def manifest(self) -> DataFrame:
        return self.spark.read.schema(MANIFEST).json(f"{self.path}/_manifest")

    def read(self, with_payload: bool = False) -> DataFrame:
        """One row a record: page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload (null for revisits)]."""
        files, size = self.manifest().agg(F.count("*"), F.sum("bytes")).first()
        tasks = max(min(files, 2 * self.spark.sparkContext.defaultParallelism), -(-(size or 0) // READ_BYTES), 1)
        names = self.manifest().select("name", "sha256").repartition(tasks, "name")
        schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
        return names.mapInArrow(_read_batches(self.path, with_payload), schema + ", payload binary" * with_payload)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers (names in lower case), HTTP headers and payload of one record; ValueError if lengths or digests differ."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    n = int(fields["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n" or f"sha1:{hashlib.sha1(block).hexdigest()}" != fields["warc-block-digest"]:
        raise ValueError(f"record {fields['warc-record-id']}: damaged block")
    http, _, payload = block.partition(b"\r\n\r\n")
    if fields["warc-type"] == "response" and f"sha1:{hashlib.sha1(payload).hexdigest()}" != fields["warc-payload-digest"]:
        raise ValueError(f"record {fields['warc-record-id']}: damaged payload")
    return fields, http, payload


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one in memory at a time."""
    unpack, parts, data = zlib.decompressobj(31), [], stream.read(size)
    while data:
        parts.append(unpack.decompress(data))
        if unpack.eof:
            yield b"".join(parts)
            data, unpack, parts = unpack.unused_data, zlib.decompressobj(31), []
        else:
            data = b""
        data = data or stream.read(size)
    if parts:
        raise ValueError("a file ends inside a record")


def _read_batches(folder: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = pafs.FileSystem.from_uri(folder)
        types = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
        schema = pa.schema(types + [("payload", pa.binary())] * with_payload)
        for b in batches:
            for name in b.column("name").to_pylist():
                rows = []
                with files.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for data in members(stream):
                        f, http, payload = parse_record(data)
                        lengths = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
                        row = {"page_id": int(f["x-page-id"]) if f["x-page-id"] else None, "url": f["warc-target-uri"], "payload_bytes": int(lengths["Content-Length"]), "payload_digest": f["warc-payload-digest"][5:], "record_type": f["warc-type"], "refers_to": int(f["x-refers-to-page-id"]) if "x-refers-to-page-id" in f else None}
                        if with_payload:
                            row["payload"] = payload if f["warc-type"] == "response" else None
                        rows.append(row)
                        if len(rows) == 256:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = WarcArchive(spark)
    archive.write(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return archive.read().drop("url")


OP4_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages
), last AS (
  SELECT html, max(page_id) AS page_id, count(*) AS copies FROM p WHERE n >= 1000 GROUP BY html HAVING count(*) > 1
)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN last.page_id IS NOT NULL AND last.page_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last.page_id <> p.page_id THEN last.page_id END AS refers_to
FROM p LEFT JOIN last ON p.html = last.html
"""
