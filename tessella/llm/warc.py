"""WARC archives and their two-level capture index.

``write_archives`` turns pages into WARC/1.1 records (one ``response`` per distinct payload, ``revisit`` for the
rest) and writes them through Spark's text writer with the record terminator as line separator, so every part file
is a valid archive in whatever store the shared folder is.  ``read_archives`` parses the files again by
Content-Length.  ``build_index`` sorts captures by reversed-host URL key into zlib-compressed blocks (the second
level), then writes a sparse directory of them apart, in key order: first and last key, file, offset and length of each
block (the first level).  ``lookup`` binary-searches the directory by byte position, reads the blocks that can hold the
key by range, bisects their lines, and reads just the records' byte ranges, all through Hadoop's file system: it starts
no job and loads neither level.

Payloads that occur once are written where they are read; a bitmap of fixed size tells them.  The others travel
compressed through the one shuffle that joins them to their decision.  The join is on page_id, the decision per payload
is an aggregate, so equal payloads by the million meet in no task.

Null html is an empty payload; null urls are written as an empty target; equal page_ids with equal payloads are one
capture each and, if theirs is the largest id, each a response; empty tables give empty archives and an empty index.
Captures with equal keys may fill many blocks; a lookup gives them all, ties in order of the captures' text.  page_id is
a long.
Payloads shorter than ``min_bytes`` are never revisits.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.bitmap import bitmap, may_hold
from tessella.tables import scratch_path, stored, table

END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def surt(url: str) -> str:
    """Reversed-host key: ``http://www.a.example:80/x?q`` becomes ``example,a)/x?q``."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").lower()
        port = parts.port
    except ValueError:
        return url.strip().lower()
    host = re.sub(r"^www\d*\.", "", host)
    key = ",".join(reversed(host.split("."))) if host else ""
    if port and (parts.scheme, port) not in (("http", 80), ("https", 443)):
        key += f":{port}"
    return f"{key}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def _key(digest: str) -> int:
    """64 bits of a digest."""
    return int.from_bytes(base64.b32decode(digest)[:8], "little", signed=True)


def _captures(pages: DataFrame, payload: bool, known=None, repeated: bool = True) -> DataFrame:
    """page_id, url, digest, size and, if wanted, the compressed payload of each row; with a bitmap ``known``, only of
    rows whose digest it may hold (or, not ``repeated``, surely does not)."""
    id_type = dict(pages.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                raw = [(x.as_py() or "").encode() for x in part.column(2)]
                digests = [digest_of(x) for x in raw]
                if known is not None:
                    own = [k for k, d in enumerate(digests) if may_hold(known, _key(d)) == repeated]
                    part, raw, digests = part.take(pa.array(own, pa.int64())), [raw[k] for k in own], [digests[k] for k in own]
                cols = [part.column(0), part.column(1), pa.array(digests, pa.string()), pa.array(map(len, raw), pa.int64())]
                if payload:
                    cols.append(pa.array([zlib.compress(x, 6) for x in raw], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "digest", "size", "packed"][: len(cols)])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {id_type}, url string, digest string, size long" + ", packed binary" * payload)


def _record(page_id, url: str, digest: str, size: int, packed: bytes, original) -> str:
    """One record without its terminator."""
    revisit = original is not None
    uid = hashlib.sha1(f"{page_id}\n{url}\n{digest}".encode()).hexdigest()
    url = re.sub(r"[\r\n]+", "", url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uid[:8]}-{uid[8:12]}-{uid[12:16]}-{uid[16:20]}-{uid[20:32]}>",
        f"WARC-Target-URI: {url}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {page_id}",
    ]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"X-Payload-Length: {size}", f"X-Refers-To-Page-Id: {original}"]
    head.append(f"Content-Length: {0 if revisit else size}")
    return "\r\n".join(head) + END + ("" if revisit else zlib.decompress(packed).decode())


def write_archives(pages: DataFrame, min_bytes: int = 0, records_per_file: int = 1000) -> str:
    """Writes the archives to the shared folder; returns their path."""
    spark = pages.sparkSession
    first = _captures(pages, False).where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("copies"))
    again = stored(first.where("copies > 1").drop("copies"), "again")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_key(d) for d in b.column(0).to_pylist()], pa.int64())], ["key"])

    known = bitmap(again.select("digest").mapInArrow(keys, "key long"))
    # Decisions are small rows: every page whose payload is met more than once and that is not the largest id of it.
    decided = _captures(pages, False, known).join(again, ["digest", "size"]).where("page_id <> original").select("page_id", "digest", "original").distinct()
    rows = _captures(pages, True, known).join(decided, ["page_id", "digest"], "left")
    single = _captures(pages, True, known, False).withColumn("original", F.lit(None).cast(dict(pages.dtypes)["page_id"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                cols = [b.slice(lo, 256).column(k).to_pylist() for k in range(6)]
                yield pa.RecordBatch.from_arrays([pa.array([_record(*r) for r in zip(*cols, strict=True)], pa.string())], ["value"])

    path = scratch_path(spark, "warc")
    packed = rows.select("page_id", "url", "digest", "size", F.when(F.col("original").isNull(), F.col("packed")).alias("packed"), "original")
    for part in (single, packed):
        part.mapInArrow(run, "value string").write.mode("append").option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)
    return path


def parse(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length with terminator, headers, block) of each record of an archive file."""
    at = 0
    while at < len(content):
        body = content.index(b"\r\n\r\n", at) + 4
        lines = content[at : body - 4].decode().split("\r\n")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        stop = body + int(head["Content-Length"])
        if not lines[0].startswith("WARC/") or content[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"no record at byte {at}")
        yield at, stop + 4 - at, head, content[body:stop]
        at = stop + 4


FIELDS = "key string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One capture a record; size and digest of a response are those of the bytes read, of a revisit those it states."""
    names = [x.strip().split(" ")[0] for x in FIELDS.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0), b.column(1), strict=True):
                rows = []
                for offset, length, head, block in parse(content.as_py()):
                    revisit = head["WARC-Type"] == "revisit"
                    size, digest = (int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")) if revisit else (len(block), digest_of(block))
                    number = lambda k: int(v) if (v := head.get(k)) and v != "None" else None
                    rows.append((surt(head["WARC-Target-URI"]), number("X-Page-Id"), head["WARC-Target-URI"], size, digest, head["WARC-Type"], number("X-Refers-To-Page-Id"), file.as_py(), offset, length))
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.strip().split(" ") for x in FIELDS.split(","))]))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, FIELDS)


class Index(NamedTuple):
    """Folders of the two levels: files of blocks, and files of the directory."""

    blocks: str
    directory: str


def build_index(captures: DataFrame, per_block: int = 2000, block_bytes: int = 4_000_000) -> Index:
    """Writes both levels.

    A line of a block file is a block: number of captures, first and last key, compressed captures.  A line of a
    directory file is a block's first and last key, number, file, offset and length.  Keys are in hexadecimal, which
    keeps their order.  Blocks end after ``per_block`` captures or ``block_bytes`` characters.
    """
    spark = captures.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str]] = []
        size = 0

        def block() -> pa.RecordBatch:
            data = base64.b64encode(zlib.compress("\n".join(x for _, x in held).encode(), 6)).decode()
            return pa.RecordBatch.from_arrays([pa.array([f"{len(held)} {_hex(held[0][0])} {_hex(held[-1][0])} {data}"])], ["value"])

        for b in batches:
            for key, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append((key, line))
                size += len(line)
                if len(held) >= per_block or size >= block_bytes:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, at = [], 0
                for line in content.as_py().split(b"\n"):
                    if line:
                        n, first, last, _ = line.split(b" ", 3)
                        rows.append((first.decode(), last.decode(), int(n), file.rsplit("/", 1)[1], at, len(line)))
                    at += len(line) + 1
                yield pa.RecordBatch.from_pylist([dict(zip(_ENTRY.names, r, strict=True)) for r in rows], schema=_ENTRY)

    index = Index(scratch_path(spark, "index-blocks"), scratch_path(spark, "index-directory"))
    lines = captures.select("key", F.to_json(F.struct(*captures.columns), {"ignoreNullFields": "false"}).alias("line"))
    ordered = lines.repartitionByRange(F.col("key"), F.col("line")).sortWithinPartitions("key", "line")
    ordered.mapInArrow(run, "value string").write.option("maxRecordsPerFile", 256).text(index.blocks)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(index.blocks).select("path", "content")
    directory = files.mapInArrow(entries, "first string, last string, n long, file string, offset long, length long")
    order = ["first", "last", "file", "offset"]
    directory.repartitionByRange(*order).sortWithinPartitions(*order).select(F.concat_ws(" ", *_ENTRY.names).alias("value")).write.text(index.directory)
    return index


_ENTRY = pa.schema([("first", pa.string()), ("last", pa.string()), ("n", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _hex(key: str) -> str:
    """A key's bytes in hexadecimal; a lone dot before them, so that an empty key is a word too."""
    return "." + key.encode().hex()


def index_lines(spark: SparkSession, index: Index) -> DataFrame:
    """All captures of the index's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for value in b.column(0):
                data = base64.b64decode(value.as_py().rsplit(" ", 1)[1])
                yield pa.RecordBatch.from_arrays([pa.array(zlib.decompress(data).decode().split("\n"))], ["line"])

    return spark.read.text(index.blocks).mapInArrow(run, "line string").select(F.from_json("line", FIELDS).alias("c")).select("c.*")


class _Sorted:
    """The lines of a file of the directory, read by range."""

    def __init__(self, spark: SparkSession, file: str, size: int, chunk: int = 4096):
        self.spark, self.file, self.size, self.chunk = spark, file, size, chunk

    def line(self, at: int) -> tuple[int, list[str]] | None:
        """Start and words of the first line that starts at byte ``at`` or later."""
        base, data, width = max(at - 1, 0), b"", self.chunk
        while True:
            start = 0 if at == 0 else data.find(b"\n") + 1
            stop = data.find(b"\n", start) if start or at == 0 else -1
            if stop >= 0:
                return base + start, data[start:stop].decode().split(" ")
            if base + len(data) >= self.size:  # every line ends in a newline
                return None
            data += read_range(self.spark, self.file, base + len(data), min(width, self.size - base - len(data)))
            width *= 2

    def first_not_before(self, key: str) -> int:
        """Where to read the first line whose last key is not less than ``key``."""
        lo, hi = 0, self.size
        while lo < hi:
            mid = (lo + hi) // 2
            got = self.line(mid)
            if got is None or got[1][1] >= key:
                hi = mid
            else:
                lo = got[0] + 1
        return lo


def _entries(spark: SparkSession, index: Index, key: str) -> Iterator[list[str]]:
    """The directory's entries of blocks that can hold ``key``, in order."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(index.directory)
    status = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    named = [(x.getPath().getName(), x.getPath().toString(), x.getLen()) for x in status]
    files = [_Sorted(spark, path, size) for _, path, size in sorted((x for x in named if x[0].startswith("part-") and x[2]), key=lambda x: (int(x[0].split("-")[1]), x[0]))]
    k = max(bisect.bisect_left(files, key, key=lambda f: f.line(0)[1][1]) - 1, 0)
    at = files[k].first_not_before(key) if files else 0
    for file in files[k:]:
        while (got := file.line(at)) is not None:
            if got[1][0] > key:
                return
            yield got[1]
            at = got[0] + 1
        at = 0


def lookup(spark: SparkSession, index: Index, url: str) -> Iterator[tuple[dict, bytes]]:
    """The captures of one URL and their records, in order of the index; one block is held at a time."""
    key = surt(url)
    for _, _, _, file, offset, length in _entries(spark, index, _hex(key)):
        line = read_range(spark, f"{index.blocks}/{file}", int(offset), int(length)).decode()
        captures = [json.loads(x) for x in zlib.decompress(base64.b64decode(line.rsplit(" ", 1)[1])).decode().split("\n")]
        for c in captures[bisect.bisect_left(captures, key, key=lambda c: c["key"]) : bisect.bisect_right(captures, key, key=lambda c: c["key"])]:
            yield c, read_range(spark, c["file"], c["offset"], c["length"])


def read_range(spark: SparkSession, file: str, offset: int, length: int) -> bytes:
    """``length`` bytes of a file of any Hadoop file system from ``offset``."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    try:
        stream.seek(offset)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, length)))
    finally:
        stream.close()


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives, read back and indexed; the rows are decoded from the index's blocks."""
    path = write_archives(table(spark, sf_dir, "pages"))
    index = build_index(read_archives(spark, path))
    return index_lines(spark, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset", "length")


QUERIES = {"op9_warc": op9_warc}
