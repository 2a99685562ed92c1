"""WARC archives in seekable Zstandard bundles: independent frames, a seek table at the end, and an index of records."""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialised, scratch, shared_dir

#: Fixed values of the seekable format: a skippable frame, and the mark at the file's end.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SMALLEST_REVISITED = 100
_INDEX = "page_id long, file string, frame int, at long, length long"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if re.match(r"\w+:", uri) else f"file://{uri}")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit has the head of the response alone, whose length tells the payload's."""
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url is not None else None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {clean}"] if clean is not None else []
    lines += [f"WARC-Payload-Digest: sha256:{digest}"]
    lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[dict]:
    """The records of a frame; a response's payload is checked against its digest."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        fields = dict(line.split(": ", 1) for line in data[at:end].decode("utf-8", "surrogatepass").split("\r\n")[1:])
        size = int(fields["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        head, payload = block.split(b"\r\n\r\n", 1)
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
        kind = fields["WARC-Type"]
        if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"record {fields['WARC-Record-ID']} doesn't hold what its head says")
        number = lambda name: int(v[10:-1]) if (v := fields.get(name, "<urn:page:>")) != "<urn:page:>" else None
        yield {
            "page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": kind, "payload_bytes": length,
            "payload_digest": digest, "refers_to": number("WARC-Refers-To"), "payload": payload if kind == "response" else None,
        }
        at = end + 4 + size + 4


class BundleWriter:
    """Writes records into frames of about ``frame_bytes`` and ends the file with the table of all frames."""

    def __init__(self, out, frame_bytes: int, level: int = 3):
        self.out, self.frame_bytes, self.level = out, frame_bytes, level
        self.buffer, self.held, self.frames = [], 0, []

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, offset in the frame's content) of the record."""
        if self.held and self.held + len(data) > self.frame_bytes:
            self._flush()
        place = (len(self.frames), self.held)
        self.buffer.append(data)
        self.held += len(data)
        return place

    def _flush(self) -> None:
        packed = zstandard.ZstdCompressor(level=self.level, write_content_size=True).compress(b"".join(self.buffer))
        self.out.write(packed)
        self.frames.append((len(packed), self.held))
        self.buffer, self.held = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Random access to the frames of a bundle by the seek table at its end."""

    def __init__(self, source):
        self.source, size = source, source.size()
        source.seek(size - 9)
        count, _, mark = struct.unpack("<IBI", source.read(9))
        if mark != SEEKABLE:
            raise ValueError("no seek table")
        source.seek(size - 9 - 8 * count)
        table, self.starts, self.sizes = source.read(8 * count), [], []
        at = 0
        for k in range(count):
            packed, whole = struct.unpack_from("<II", table, 8 * k)
            self.starts.append((at, packed))
            self.sizes.append(whole)
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed = self.starts[k]
        self.source.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=max(1, self.sizes[k]))


def with_roles(pages: DataFrame, hot: int = 100_000) -> DataFrame:
    """``(page_id, url, html, digest, refers_to)``: of rows with equal payloads of 100 bytes or more, who refers to whom.

    The smallest id of such a group is referred to by the others (null ids too); rows that share it, or whose group
    has no id, are responses. One row per distinct payload and task goes to the grouping. The group's id is joined back;
    a payload of more than ``hot`` rows (or a 20,000th of all, so at most 20,000 payloads are hot and can be broadcast)
    is dealt over as many parts as it has times that many rows.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    large = rows.where(F.octet_length("html") >= SMALLEST_REVISITED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated, _ = materialised(large.where("n > 1"), "repeated")
    hot = max(hot, (repeated.agg(F.sum("n")).first()[0] or 0) // 20_000)
    split = repeated.where(F.col("n") > hot).select("digest", F.ceil(F.col("n") / hot).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    first = repeated.join(F.broadcast(split), "digest", "left").select("digest", "first", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    salted = rows.join(F.broadcast(split), "digest", "left").withColumn("part", F.pmod(F.xxhash64("page_id", "url"), parts).cast("int"))
    joined = salted.drop("parts").join(first, ["digest", "part"], "left")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first")), F.lit(None)).otherwise(F.col("first")).cast("long")
    return joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write_bundles(pages: DataFrame, path: str | None = None, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 30, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a WARC record per row of ``pages(page_id, url, html)`` into bundles under ``path``; returns the index.

    ``(page_id, file, frame, at, length)``: a record is ``length`` bytes from ``at`` in the content of its frame.
    Every task attempt writes files of its own name; the index, written as Parquet, names those of the attempts
    that Spark committed, so a lost or repeated task leaves at most files that nothing refers to. A record larger
    than a frame has a frame of its own. ``path``: a folder that all executors reach, by default a new one in the
    shared folder. Null html is an empty payload; repeated rows are records each; other columns are ignored.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = _open(path)
        writer, name, written, out = None, "", 0, []

        def index() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            names = ["page_id", "file", "frame", "at", "length"]
            columns = list(zip(*out, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for page, url, html, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = record(page, url, html.encode(), digest, refers, date)
                if writer is None or written + len(data) > bundle_bytes:
                    if writer:
                        writer.close()
                    where.create_dir(folder, recursive=True)
                    name, written = f"{uuid.uuid4().hex}.warc.zst", 0
                    writer = BundleWriter(where.open_output_stream(f"{folder}/{name}", compression=None), frame_bytes)
                out.append((page, f"{path}/{name}", *writer.add(data), len(data)))
                written += len(data)
            if len(out) > 10_000:
                yield index()
                out = []
        if writer:
            writer.close()
        yield index()

    with scratch(spark) as made:
        index, at = materialised(with_roles(pages).mapInArrow(write, _INDEX), "warc-index")
        made.remove(at)
    return index


def _reader(cache: dict, file: str) -> BundleReader:
    if file not in cache:
        for reader in cache.values():
            reader.source.close()
        cache.clear()
        where, path = _open(file)
        cache[file] = BundleReader(where.open_input_file(path))
    return cache[file]


_FIELDS = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
_SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _rows(found: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], k) for n, k in _FIELDS.items()], names=list(_FIELDS))


def read_bundles(index: DataFrame) -> DataFrame:
    """All records of the bundles that ``index`` names, a task reading whole frames: the fields of ``parse``.

    Payloads are checked against their digests on the way; a revisit's payload is null.
    """
    frames = index.select("file", "frame").distinct()
    # half a gigabyte of frames to a task
    parts = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), frames.count() // 2000)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            for file, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield _rows(list(parse(_reader(cache, file).frame(frame))))

    # by another key than distinct() deals by: else its exchange serves, whose few bytes AQE puts into one task
    return frames.repartition(parts, F.xxhash64("file", "frame")).sortWithinPartitions("file", "frame").mapInArrow(read, _SCHEMA)


def look_up(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of the given ``ids(page_id)``, each read from its frame alone; ids without a record give none."""
    wanted = index.join(ids.select("page_id").distinct(), "page_id").select("file", "frame", "at", "length")
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        last, data = None, b""
        for batch in batches:
            for file, frame, at, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last != (file, frame):
                    last, data = (file, frame), _reader(cache, file).frame(frame)
                yield _rows(list(parse(data[at : at + length])))

    return wanted.repartition(parts, "file", "frame").sortWithinPartitions("file", "frame", "at").mapInArrow(read, _SCHEMA)
