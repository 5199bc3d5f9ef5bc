"""WARC archives: a deterministic sharded writer, and a reader that goes by the manifest.

Records are range-sorted by page id and payload digest. Shards are ranges of that order, cut where a running sum of the exact
bytes passes a multiple of the shard size, so the same pages always give the same files, and a shard is bounded however the ids
are spread: it is at most the shard size and one key's rows. Beyond MOST_SHARDS shards, 1.6 TB of payload, shards grow instead;
each is still written as a stream, in files of the rolling size. Of records with equal payloads that with the smallest page id
is the response and the others revisit it. Each record is a gzip member; a file that has reached the rolling size is
closed and the next begun. A file is written under a temporary name of its attempt's own and moved to its final name when
whole; a task that runs again makes the same bytes under the same name. The manifest, a table that Spark commits as a whole,
lists the files with sizes and digests: files that it doesn't list don't exist for the reader.

Payloads go through one shuffle, next to the rows that say which page is each payload's first.

Defined results: a null html is an empty payload; a null page_id comes first in order and is never the smallest unless all
are null; of repeated rows with the smallest id the first is the response; an empty table gives no files. Further columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, fresh_path, parts_for, running, staged, worker_state

SHARD_BYTES, ROLL_BYTES, MOST_SHARDS = 32 << 20, 16 << 20, 50_000
#: What a record weighs besides its payload.
HEADERS = 512
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "shard long, file string, records long, bytes long, sha256 string, first_id long, last_id long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if uri.startswith("s3a://") else uri)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One record as a gzip member, with all headers and digests made anew."""
    digest = base32_sha1(payload)
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "response":
        body += payload
    uri = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page: {refers_to}")
    lines += [f"X-Payload-Length: {len(payload)}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(body)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


class _Files:
    """Writes one task's records: rolls files, moves each to its final name, and collects the manifest's rows."""

    def __init__(self, folder: str, roll: int) -> None:
        self.fs, self.root = _open(folder)
        self.roll, self.attempt = roll, uuid.uuid4().hex
        self.out, self.shard, self.number, self.done = None, None, 0, []

    def write(self, shard: int, page_id: int | None, data: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.number = shard, 0
        if self.out is None:
            self.temporary = f"{self.root}/_temporary/{self.attempt}-{shard:06d}-{self.number:05d}"
            self.out = self.fs.open_output_stream(self.temporary, compression=None)
            self.digest, self.size, self.records, self.first = hashlib.sha256(), 0, 0, page_id
        self.out.write(data)
        self.digest.update(data)
        self.size, self.records, self.last = self.size + len(data), self.records + 1, page_id
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.out, name = None, f"part-{self.shard:06d}-{self.number:05d}.warc.gz"
        try:
            self.fs.move(self.temporary, f"{self.root}/{name}")
        except OSError:  # some stores don't replace: an earlier attempt's file has the same bytes
            if self.fs.get_file_info(f"{self.root}/{name}").size != self.size:
                raise
            self.fs.delete_file(self.temporary)
        self.done.append((self.shard, name, self.records, self.size, self.digest.hexdigest(), self.first, self.last))
        self.number += 1


def _shards(seen: DataFrame, shard_bytes: int) -> tuple[DataFrame, list[tuple]]:
    """seen with its shards, and the first key of each shard but the first: at most MOST_SHARDS small rows, for the driver."""
    rows, total = seen.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0))).first()
    each = max(shard_bytes, -(-total // MOST_SHARDS))
    # Nulls come first, as in the order of records.
    dealt = running(seen, [], ["page_id", "digest"], "weight", "_ends", rows)
    dealt = staged(dealt.withColumn("shard", F.expr(f"cast((_ends - weight) div {each} as int)")).drop("_ends", "weight"), "warc-shards")
    firsts = dealt.groupBy("shard").agg(F.min(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "digest")).alias("k")).select("shard", "k.*").collect()
    # A key that is larger than a shard leaves shard numbers out.
    return dealt, sorted((r.known, r.page_id or 0, r.digest, r.shard) for r in firsts)


def _shard_of(firsts: list[tuple]):
    """The shard of (page_id, digest), from the shards' first keys."""
    keys, numbers = [f[:3] for f in firsts], [f[3] for f in firsts]

    @F.arrow_udf("int")
    def shard(page_id: pa.Array, digest: pa.Array) -> pa.Array:
        each = zip(page_id.to_pylist(), digest.to_pylist(), strict=True)
        return pa.array([numbers[bisect_right(keys, (p is not None, p or 0, d)) - 1] for p, d in each], pa.int32())

    return shard(F.col("page_id"), F.col("digest"))


def write(pages: DataFrame, folder: str | None = None, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, least_revisit: int = 0) -> str:
    """Writes pages (page_id, url, html) as WARC files with a manifest; returns the folder."""
    spark = pages.sparkSession
    bound_batches(spark)
    folder = folder or fresh_path(spark, "warc")
    fs, root = _open(folder)
    fs.create_dir(f"{root}/_temporary", recursive=True)
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.cast("binary").alias("payload"), F.sha1(html.cast("binary")).alias("digest"))
    # The digests alone, to find each payload's first page; the payloads are read again when they are written.
    size = F.octet_length("payload").cast("long")
    seen = staged(rows.select("page_id", "digest", size.alias("n")).groupBy("page_id", "digest").agg(F.sum(F.col("n") + HEADERS).alias("weight"), F.max("n").alias("most")), "warc-digests")
    dealt, keys = _shards(seen, shard_bytes)
    firsts = dealt.where(F.col("most") >= least_revisit).groupBy("digest").agg(F.min("page_id").alias("first"))
    said = dealt.join(firsts, "digest").select("shard", "page_id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "first")
    shard = _shard_of(keys) if keys else F.lit(0)
    both = rows.select(shard.alias("shard"), "page_id", "digest", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("first")).unionByName(said)
    n = 1 + max((k[3] for k in keys), default=0)
    in_order = both.repartitionById(n, "shard").sortWithinPartitions("shard", "page_id", "digest", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("warc")
        files = _Files(folder, roll_bytes)
        key, first, open_ = None, None, False
        for b in batches:
            shard, page, digest, kind, url, payload, lead = (c.to_pylist() for c in b.columns)
            for k in range(b.num_rows):
                if kind[k] == 0:
                    key, first, open_ = (page[k], digest[k]), lead[k], True
                    continue
                if key != (page[k], digest[k]):  # smaller than those that are compared: all are responses
                    files.write(shard[k], page[k], record(page[k], url[k], payload[k], "response", None))
                    continue
                fresh = open_ and page[k] == first
                files.write(shard[k], page[k], record(page[k], url[k], payload[k], "response" if fresh else "revisit", None if fresh else first))
                open_ = open_ and not fresh
        files.close()
        columns = list(zip(*files.done, strict=True)) or [()] * 7
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in MANIFEST.split(", ")])

    in_order.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    fs.delete_dir(f"{root}/_temporary")
    return folder


def _records(stream, check) -> Iterator[tuple]:
    """The records of a file of gzip members, read in pieces."""
    unpack, held = zlib.decompressobj(31), []
    while data := stream.read(1 << 20):
        check(data)
        while data:
            held.append(unpack.decompress(data))
            data = unpack.unused_data
            if unpack.eof:
                yield _parse(b"".join(held))
                unpack, held = zlib.decompressobj(31), []
    if any(held):
        raise ValueError("the last record is cut short")


def _parse(raw: bytes) -> tuple:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(body)}":
        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
    number = lambda k: int(fields[k]) if k in fields else None
    digest, payload = fields["WARC-Payload-Digest"].removeprefix("sha1:"), None
    if fields["WARC-Type"] == "response":
        payload = body.partition(b"\r\n\r\n")[2]
        if base32_sha1(payload) != digest:
            raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
    return number("X-Page-Id"), fields["WARC-Target-URI"], fields["WARC-Type"], number("X-Refers-To-Page"), payload, number("X-Payload-Length"), digest


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the files in the manifest, as RECORD; a revisit has no payload of its own. Sizes and digests are verified."""
    bound_batches(spark)
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    n = parts_for(manifest.count(), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("warc")
        fs, root = _open(folder)
        names = [f.split()[0] for f in RECORD.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for name, records, size, sha256 in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                digest, rows, held, seen, total = hashlib.sha256(), [], 0, 0, 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:

                    def check(data: bytes) -> None:
                        nonlocal total
                        digest.update(data)
                        total += len(data)

                    for r in _records(stream, check):
                        rows.append(r)
                        seen, held = seen + 1, held + len(r[4] or b"")
                        if held > 1 << 22 or len(rows) >= 4096:
                            yield batch(rows)
                            rows, held = [], 0
                if (seen, total, digest.hexdigest()) != (records, size, sha256):
                    raise ValueError(f"{name} is not the file in the manifest")
                if rows:
                    yield batch(rows)

    return manifest.select("file", "records", "bytes", "sha256").repartition(n, "file").mapInArrow(run, RECORD)
