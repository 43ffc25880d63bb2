"""Deterministic sharded WARC archives: write, commit, read back.

Records are sorted by key and cut into contiguous key ranges of near equal bytes; the ranges follow
from the data alone, not from sampling or from the number of executors. The task of a range writes its
records one gzip member each and begins a new file when the compressed size reaches a limit. It
writes to names of its own attempt and returns a list of its files. When all lists are stored, the
files named in them get their final names and the manifest is written; files of lost or repeated
attempts are in no list and are never read.

Of records with equal payloads the one with the smallest key keeps it, the others
are revisits that refer to it. Headers, record ids and digests are made anew from the rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwise.llm.common import shared_path, stored, table, whole_text

# Compressed bytes at which a file is closed.
FILE_BYTES = 256 << 20
# Key buckets by which the ranges are cut, and again within a bucket that is too large.
BUCKETS = 4096
LEAST_BYTES = 0
DATE = "2026-01-01T00:00:00Z"
LEVEL = 5
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: int, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{key}/{digest}/{copy}')}>"


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [f"{name}: {_line(value)}" for name, value in headers if value is not None]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""])
    return head.encode() + block + b"\r\n\r\n"


def _line(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def page_record(key: int | None, url: str | None, payload: bytes, digest: str, copy: int, first: int | None) -> bytes:
    """A response with its payload, or a revisit where ``first`` names the key of the response."""
    headers = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", record_id(key, digest, copy)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Page-ID", None if key is None else str(key)),
        ("WARC-Payload-Length", str(len(payload))),
    ]
    block = HTTP + payload
    if first is not None:
        block = HTTP
        headers += [
            ("WARC-Profile", REVISIT),
            ("WARC-Refers-To", record_id(first, digest, 0)),
            ("WARC-Refers-To-Page-ID", str(first)),
        ]
    headers += [("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/http; msgtype=response")]
    return record(headers, block)


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class _Files:
    """Files of one key range, written below the folder of this attempt."""

    def __init__(self, path: str, shard: int, limit: int) -> None:
        self.system, self.root = _filesystem(path)
        self.attempt, self.shard, self.limit = uuid.uuid4().hex, shard, limit
        self.sink, self.listed = None, []

    def add(self, data: bytes) -> None:
        if self.sink is None:
            number = len(self.listed)
            name = f"{self.shard:06d}-{number:05d}.warc.gz"
            temporary = f"_temporary/{self.attempt}-{name}"
            self.system.create_dir(f"{self.root}/_temporary", recursive=True)
            self.sink = self.system.open_output_stream(f"{self.root}/{temporary}", compression=None)
            self.listed.append([self.shard, name, temporary, 0, 0])
            info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(SPACE, name)}>")]
            info += [("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
            self._write(_member(record(info, b"software: postwise\r\nformat: WARC File Format 1.1\r\n")))
        self._write(_member(data))
        self.listed[-1][3] += 1
        if self.listed[-1][4] >= self.limit:
            self.close()

    def _write(self, member: bytes) -> None:
        self.sink.write(member)
        self.listed[-1][4] += len(member)

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()
            self.sink = None


def key_ranges(sizes: DataFrame, target: int | None) -> list[tuple[int, int]]:
    """Contiguous key ranges (first, last) of about ``target`` bytes; ``sizes`` has ``key`` and ``bytes``.

    Without a target there are 256 ranges, of 2 to 256 MB each. The driver holds 4,096 sums, and
    4,096 more for every bucket that is larger than a range.
    """
    bounds = sizes.agg(F.min("key").alias("low"), F.max("key").alias("high"), F.sum("bytes").alias("total")).first()
    if bounds["low"] is None:
        return []
    target = target or min(256 << 20, max(2 << 20, int(bounds["total"]) // 256))
    open_, done = [(int(bounds["low"]), int(bounds["high"]))], []
    while open_:
        widths = {low: -(-(high - low + 1) // BUCKETS) for low, high in open_}
        bucket = None
        for low, high in open_:
            inside = F.col("key").between(low, high)
            first = F.lit(low) + F.floor((F.col("key") - low) / F.lit(widths[low]).cast("decimal(20,0)")) * widths[low]
            bucket = F.when(inside, first) if bucket is None else bucket.when(inside, first)
        found = sizes.select(bucket.cast("decimal(20,0)").alias("first"), "bytes").filter("first IS NOT NULL")
        rows = found.groupBy("first").agg(F.sum("bytes").alias("bytes")).collect()
        ends = {int(r["first"]): int(r["bytes"]) for r in rows}
        later = []
        for first, total in ends.items():
            owner = max(low for low, _ in open_ if low <= first)
            last = min(first + widths[owner] - 1, dict(open_)[owner])
            if total > target and last > first:
                later.append((first, last))
            else:
                done.append((first, last, total))
        open_ = later
    ranges, filled = [], 0
    for first, last, total in sorted(done):
        if ranges and filled + total <= target:
            ranges[-1], filled = (ranges[-1][0], last), filled + total
        else:
            ranges.append((first, last))
            filled = total
    return ranges


def write_archives(
    pages: DataFrame,
    path: str,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least_bytes: int = LEAST_BYTES,
    shard_bytes: int | None = None,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write one record per row to WARC files below ``path``; returns the manifest.

    Null payloads are empty; null keys are spread over the shards, stand first in each, and are never referred to by another key. Among rows with equal key
    and payload the first is the response and the others revisit it. Payloads below
    ``least_bytes`` are all responses. ``path`` must be a folder that all executors reach.
    An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    body = whole_text(payload).cast("binary")
    rows = pages.select(
        F.col(f"`{key}`").cast("long").alias("key"),
        F.col(f"`{url}`").cast("string").alias("url"),
        body.alias("payload"),
    ).withColumn("digest", F.unhex(F.sha1("payload")))
    slim = stored(rows.select("key", "digest", F.octet_length("payload").cast("long").alias("bytes")), "digests")
    ranges = key_ranges(slim.filter("key IS NOT NULL").withColumn("bytes", F.col("bytes") + 512), shard_bytes)
    # Payloads that occur more than once, with their smallest key.
    linked = slim.filter(F.col("bytes") >= least_bytes)
    firsts = linked.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1")
    plan = linked.select("key", "digest").join(firsts, "digest").groupBy("key", "digest").agg(F.min("first").alias("first"))
    empty = [F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload")]
    both = plan.select("key", "digest", F.lit(0).alias("kind"), "first", *empty).unionByName(
        rows.select("key", "digest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("first"), "url", "payload")
    )
    starts = [first for first, _ in ranges[1:]]
    shard = F.size(F.filter(F.lit(starts).cast("array<bigint>"), lambda s: s <= F.col("key"))) if starts else F.lit(0)
    # Rows without a key have no place in the order: they are spread by payload, beside the copies' plan.
    spread = F.pmod(F.xxhash64("digest"), F.lit(max(1, len(ranges)))).cast("int")
    shard = F.when(F.col("key").isNull(), spread).otherwise(shard)
    order = ["shard", "key", "digest", "kind", "url"]
    dealt = both.withColumn("shard", shard).repartition(max(1, len(ranges)), "shard").sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: _Files | None = None
        listed: list[list] = []
        same, first, copy = None, None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256).to_pydict()
                for s, k, d, kind, f, u, p in zip(*(part[c] for c in names), strict=True):
                    if files is None or files.shard != s:
                        if files is not None:
                            files.close()
                            listed += files.listed
                        files = _Files(path, s, file_bytes)
                    if (k, d) != same:
                        same, first, copy = (k, d), None, 0
                    if kind == 0:
                        first = f
                        continue
                    digest = base64.b32encode(d).decode()
                    refers = None
                    if first is not None and (first != k or copy):
                        refers = first
                    files.add(page_record(k, u, p, digest, copy, refers))
                    copy += 1
        if files is not None:
            files.close()
            listed += files.listed
        columns = list(zip(*listed, strict=True)) or [[]] * 5
        kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=listing)

    names = ["shard", "key", "digest", "kind", "first", "url", "payload"]
    listing = ["shard", "file", "temporary", "records", "bytes"]
    schema = "shard int, file string, temporary string, records long, bytes long"
    made = stored(dealt.select(*names).mapInArrow(write, schema), "archives")
    return commit(spark, made, path)


def commit(spark: SparkSession, made: DataFrame, path: str) -> DataFrame:
    """Give the listed files their final names, then write the manifest; a repeated task finds its work done."""

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            if batch.num_rows:
                system, root = _filesystem(path)
                for name, temporary in zip(*(batch.column(k).to_pylist() for k in (1, 2)), strict=True):
                    if system.get_file_info(f"{root}/{temporary}").type != fs.FileType.NotFound:
                        system.move(f"{root}/{temporary}", f"{root}/{name}")
            yield batch

    named = made.mapInArrow(rename, made.schema).select("shard", "file", "records", "bytes")
    named.write.mode("overwrite").parquet(f"{path}/_manifest")
    return spark.read.schema(named.schema).parquet(f"{path}/_manifest")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a file of gzip members."""
    view, at = memoryview(data), 0
    while at < len(view):
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            chunk = view[at : at + 65536]
            if not len(chunk):
                raise ValueError("the archive ends inside a record")
            parts.append(unpacker.decompress(chunk))
            at += len(chunk)
        at -= len(unpacker.unused_data)
        whole = b"".join(parts)
        head, _, rest = whole.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        length = int(headers["Content-Length"])
        if rest[length:] != b"\r\n\r\n":
            raise ValueError("the record does not have its stated length")
        yield headers, rest[:length]


READ = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The page records of the files in the manifest of ``path``; every digest is checked.

    A revisit has no payload. ``payloads=False`` leaves the column null.
    """
    manifest = spark.read.parquet(f"{path}/_manifest").select("file")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    files = files.withColumn("file", F.element_at(F.split("path", "/"), -1)).join(manifest, "file", "left_semi")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows: list[tuple] = []
                size = 0
                for headers, block in parse(batch.column(0)[i].as_py()):
                    if headers["WARC-Type"] == "warcinfo":
                        continue
                    if headers["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
                        raise ValueError(f"block digest of {headers['WARC-Record-ID']}")
                    digest, body = headers["WARC-Payload-Digest"].removeprefix("sha1:"), None
                    if headers["WARC-Type"] == "response":
                        body = block.partition(b"\r\n\r\n")[2]
                        if base32_sha1(body) != digest or len(body) != int(headers["WARC-Payload-Length"]):
                            raise ValueError(f"payload digest of {headers['WARC-Record-ID']}")
                    numbers = [headers.get(n) for n in ("WARC-Page-ID", "WARC-Payload-Length", "WARC-Refers-To-Page-ID")]
                    key, length, refers = (None if x is None else int(x) for x in numbers)
                    url = headers.get("WARC-Target-URI")
                    rows.append((key, url, length, digest, headers["WARC-Type"], refers, body if payloads else None))
                    size += len(body) if payloads and body else 0
                    if len(rows) >= 4096 or size > 8 << 20:
                        yield _records(rows)
                        rows, size = [], 0
                yield _records(rows)

    return files.select("content").mapInArrow(read, READ)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.name for f in READ]
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every page written to archives and read back."""
    path = shared_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    found = read_archives(spark, path, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
