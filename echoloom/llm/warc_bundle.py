"""WARC archives as seekable Zstandard bundles (operator 10).

A bundle is a file of independent Zstandard frames, each of some ``FRAME`` bytes of whole
WARC records, then a seek table in a skippable frame (the seekable format: sizes of every frame and
a footer of fixed length).  A record is found by its bundle, frame number and offset within
the decompressed frame, which the manifest keeps for every record id.

Records of equal payloads of at least ``LEAST`` bytes are written once, as a response; the others
revisit it and carry its digest and id but no payload.

A task writes its bundle under a name of its own attempt and then reports it; only
reported bundles are in the manifest, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from echoloom.llm.arrow import bounded_batches
from echoloom.llm.shared_files import opened
from echoloom.scratch import scratch_path, stored

LEAST = 100  #: bytes of a payload from which on equal ones are revisits
FRAME = 1 << 18  #: bytes of records after which a frame is closed
BUNDLE = 1 << 26  #: bytes of compressed frames after which a bundle is closed
DEALT = 16  #: tasks among which the rows of one payload are dealt
GROUP = 16  #: frames that are read together
PART = 1 << 25  #: bytes of records that a reading task gets
# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
MANIFEST = "bundle string, record_id string, frame long, offset long, length long"


def record(record_id: str, url: str | None, kind: str, payload: bytes, digest: str, size: int, refers_to: str | None) -> bytes:
    """One WARC/1.1 record."""
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <" + record_id.encode() + b">", b"WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(b"WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A").encode())
    head += [b"WARC-Payload-Digest: sha256:" + digest.encode(), b"WARC-Payload-Length: %d" % size]
    if kind == "revisit":
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <" + str(refers_to).encode() + b">"]
        payload = b""
    head += [b"Content-Type: text/html", b"Content-Length: %d" % len(payload)]
    return b"\r\n".join(head) + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame at the end of a bundle, of (compressed, decompressed) sizes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frame_sizes(bundle) -> list[tuple[int, int]]:  # noqa: ANN001
    """The seek table of an open bundle, read from its end."""
    size = bundle.size()
    bundle.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", bundle.read(9))
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table")
    bundle.seek(size - 9 - 8 * count)
    data = bundle.read(8 * count)
    return [struct.unpack_from("<II", data, 8 * i) for i in range(count)]


def read_record(uri: str, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its place, decompressing its frame alone."""
    import zstandard

    with opened(uri, "r") as f:
        sizes = frame_sizes(f)
        f.seek(sum(c for c, _ in sizes[:frame]))
        data = zstandard.ZstdDecompressor().decompress(f.read(sizes[frame][0]))
    return parsed(data[offset : offset + length])


class _Writer:
    """Frames of one bundle after another."""

    def __init__(self, folder: str) -> None:
        import zstandard

        self.folder, self.press = folder, zstandard.ZstdCompressor(level=6)
        self.file, self.held, self.size, self.places = None, [], 0, []

    def add(self, record_id: str, data: bytes) -> Iterator[pa.RecordBatch]:
        if self.file is None:
            task = TaskContext.get()
            part = f"{task.partitionId():06d}-{task.taskAttemptId()}" if task else "0"
            self.uri = f"{self.folder}/{part}-{uuid.uuid4().hex}.warc.zst"
            self.file, self.frames, self.places = opened(self.uri, "w"), [], []
        self.places.append((record_id, len(self.frames), self.size, len(data)))
        self.held.append(data)
        self.size += len(data)
        if self.size >= FRAME:
            self._close_frame()
            if sum(c for c, _ in self.frames) >= BUNDLE:
                yield from self.close()

    def _close_frame(self) -> None:
        if self.held:
            frame = self.press.compress(b"".join(self.held))
            self.file.write(frame)
            self.frames.append((len(frame), self.size))
            self.held, self.size = [], 0

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.file is None:
            return
        self._close_frame()
        self.file.write(seek_table(self.frames))
        self.file.close()
        self.file = None
        ids, frames, offsets, lengths = zip(*self.places, strict=True)
        yield pa.record_batch([pa.array([self.uri] * len(ids)), pa.array(ids), pa.array(frames, pa.int64()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["bundle", "record_id", "frame", "offset", "length"])


def name_of(page_id: int | None) -> str:
    return "urn:page:" + ("null" if page_id is None else str(page_id))


def _bundler(folder: str) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(folder)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                for page_id, url, payload, digest, size, refers_to in zip(*(c.to_pylist() for c in batch.slice(low, 256).columns), strict=True):
                    kind = "response" if refers_to is None else "revisit"
                    yield from writer.add(name_of(page_id), record(name_of(page_id), url, kind, payload or b"", digest, size, None if refers_to is None else name_of(refers_to)))
        yield from writer.close()

    return write


def write_archive(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html); give the manifest.

    The payload is the html in UTF-8, empty for null.  Among equal payloads of at least
    ``LEAST`` bytes the smallest page_id is the response; rows with that same id are responses too,
    since a record cannot revisit itself; rows with a null page_id are revisits if any row of the payload
    has an id.  Other columns are ignored.  The manifest is stored; an empty table gives
    an empty one and no bundle.
    """
    bounded_batches(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    firsts = rows.where(F.col("size") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # A payload that very many rows share is dealt among tasks, and adaptive execution splits what is still large; small ones meet nothing.
    deal = F.xxhash64("page_id", "url")
    firsts = stored(firsts.select(F.col("digest").alias("met"), "first", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1)).cast("array<long>")).alias("deal")), "warc-firsts")
    dealt = rows.withColumns({"met": F.when(F.col("size") >= LEAST, F.col("digest")).otherwise(""), "deal": F.when(F.col("size") >= LEAST, F.pmod(deal, F.lit(DEALT))).otherwise(deal)})
    joined = dealt.join(firsts.hint("merge"), ["met", "deal"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    told = joined.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", "size", F.when(revisit, F.col("first")).alias("refers_to"))
    return stored(told.mapInArrow(_bundler(folder), MANIFEST), "warc-manifest")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    names = ["record_id", "record_type", "refers_to", "url", "payload", "payload_digest", "payload_bytes"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64()]
    for batch in batches:
        for uri, frames in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            places: dict[int, list] = {}
            for p in frames:
                places.setdefault(p["frame"], []).append(p)
            with opened(uri, "r") as f:
                starts, at = [], 0
                for compressed, _ in frame_sizes(f):
                    starts.append((at, compressed))
                    at += compressed
                for number in sorted(places):
                    f.seek(starts[number][0])
                    data, out = zstandard.ZstdDecompressor().decompress(f.read(starts[number][1])), []
                    for p in places[number]:
                        fields, payload = parsed(data[p["offset"] : p["offset"] + p["length"]])
                        kept = fields["WARC-Type"] == "response"
                        digest = hashlib.sha256(payload).hexdigest() if kept else fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        size = len(payload) if kept else int(fields["WARC-Payload-Length"])
                        target = fields["WARC-Refers-To"][1:-1] if not kept else None
                        out.append((fields["WARC-Record-ID"][1:-1], fields["WARC-Type"], target, fields.get("WARC-Target-URI"), payload if kept else None, digest, size))
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)


def read_archive(manifest: DataFrame) -> DataFrame:
    """Every record of a manifest, from its bundle: ids, type, target, url, payload (null for a
    revisit), and digest and length of the full payload; those of a response are computed anew."""
    spark = manifest.sparkSession
    bounded_batches(spark)
    group = (F.col("frame") / GROUP).cast("long").alias("group")
    size = manifest.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("b"), F.count_distinct("bundle", group).alias("n")).first()
    tasks = max(1, min(size["n"], max(spark.sparkContext.defaultParallelism, size["b"] // PART)))  # by bytes of payload: the manifest itself is small
    frames = manifest.withColumn("group", group).repartition(tasks, "bundle", "group").groupBy("bundle", "group").agg(F.collect_list(F.struct("frame", "offset", "length")).alias("places"))
    return frames.select("bundle", "places").mapInArrow(_reader, "record_id string, record_type string, refers_to string, url string, payload binary, payload_digest string, payload_bytes long")


def archive_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "warc")
