"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames; a bundle ends in a footer seek table
(a skippable frame, so any Zstandard reader can read the bundle), and the index
maps each record identifier to bundle, frame and offset inside the frame. Records
with equal payloads of at least min_bytes are one response and revisits of it.

Bundles are written by tasks into the folder the cluster shares. Every task
attempt writes files of its own and the index names only those of the attempts
that Spark accepted, so a lost executor or a second attempt leaves at most
orphans. A task holds one frame at a time, and payloads are never grouped by
digest: only digests and page ids are.

Defined results: null html is an empty payload and a response; a null URL is an
empty target; repeated rows with one page_id and payload are all responses; where
only null page_ids share a payload all are responses; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.llm.common import discard, fresh_folder, materialise, small

#: Fixed values of the seekable format: skippable frame, seek table footer.
SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 256 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Page ids pass through pandas as text, since it turns whole numbers beside a null into floats.
INDEX = "page_id string, record_id string, bundle string, frame int, offset long, length long"


class Frame(NamedTuple):
    bundle: str
    frame: int
    start: int
    packed: int
    length: int


class BundleWriter:
    """One bundle: records in, frames out, the seek table at the end."""

    def __init__(self, path: str):
        self.path = path
        fs, name = pafs.FileSystem.from_uri(path)
        self.out = fs.open_output_stream(name, compression=None)
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.parts: list[bytes] = []
        self.size = self.written = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame and offset of the record."""
        if self.parts and self.size + len(record) > FRAME_BYTES:
            self._end_frame()
        at = (len(self.frames), self.size)
        self.parts.append(record)
        self.size += len(record)
        return at

    def _end_frame(self) -> None:
        if self.parts:
            packed = self.packer.compress(b"".join(self.parts))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.parts, self.size = [], 0

    def close(self) -> None:
        self._end_frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, FOOTER)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


def seek_table(path: str) -> list[Frame]:
    """The frames of a bundle, from its footer alone."""
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as f:
        size = f.size()
        n, _, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
        if magic != FOOTER:
            raise ValueError(f"{path} has no seek table")
        table = f.read_at(8 * n, size - 9 - 8 * n)
    out, at = [], 0
    for k in range(n):
        packed, length = struct.unpack_from("<II", table, 8 * k)
        out.append(Frame(path, k, at, packed, length))
        at += packed
    return out


def read_frame(path: str, start: int, packed: int) -> bytes:
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as f:
        return zstandard.ZstdDecompressor().decompress(f.read_at(packed, start))


def record_id(page_id: int | None, payload_digest: str, kind: str) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}/{kind}/{payload_digest}").urn


def make_record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, date: str) -> tuple[str, bytes]:
    """Record id and bytes of a response, or of a revisit of the response of page refers_to."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    name = record_id(page_id, digest, kind)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to, digest, 'response')}>", f"Page-Refers-To: {refers_to}"]
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return name, "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and payload of each record of a frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        block = data[end + 4 : end + 4 + int(head["content-length"])]
        yield at, head, block[block.index(b"\r\n\r\n") + 4 :]
        at = end + 4 + len(block) + 4


def plan(pages: DataFrame, key: str, url: str, html: str, min_bytes: int) -> DataFrame:
    """page_id, url, payload, digest and the page_id that the record refers to (null: it is a response)."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    digest = F.sha2(F.col("payload"), 256).alias("digest")
    long = rows.where(F.octet_length("payload") >= min_bytes).select("page_id", digest)
    groups = long.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = small(groups, "repeated_payloads")
    revisits = long.join(groups, "digest").where("page_id <> refers_to or page_id is null and refers_to is not null").distinct()
    revisits = revisits.select(F.col("page_id").alias("p2"), F.col("digest").alias("d2"), "refers_to")
    rows = rows.select("*", digest)
    return rows.join(revisits, rows.page_id.eqNullSafe(revisits.p2) & (rows.digest == revisits.d2), "left").drop("p2", "d2")


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 100, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write the archives and return their index, itself written to the shared folder."""

    def bundles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        stem, n, writer = f"{folder}/bundle-{task.partitionId():06d}-{task.taskAttemptId():08d}", 0, None
        for b in batches:
            rows = []
            for p, u, payload, digest, refers in zip(b["page_id"], b["url"], b["payload"], b["digest"], b["refers_to"]):
                if writer is None:
                    writer, n = BundleWriter(f"{stem}-{n:04d}.warc.zst"), n + 1
                name, record = make_record(p, u, payload.encode("utf-8", "replace"), digest, refers, date)
                frame, offset = writer.add(record)
                rows.append((p, name, writer.path, frame, offset, len(record)))
                if writer.written > BUNDLE_BYTES:
                    writer.close()
                    writer = None
            yield pd.DataFrame(rows, columns=["page_id", "record_id", "bundle", "frame", "offset", "length"])
        if writer:
            writer.close()

    pafs_dir(folder)
    planned = plan(pages, key, url, html, min_bytes).withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return materialise(planned.mapInPandas(bundles, INDEX).withColumn("page_id", F.col("page_id").cast("long")), "warc_index")


def pafs_dir(folder: str) -> None:
    fs, name = pafs.FileSystem.from_uri(folder)
    fs.create_dir(name, recursive=True)


def read(spark: SparkSession, index: DataFrame) -> DataFrame:
    """All records of the index's bundles, read by their seek tables: page_id, record_type, refers_to, payload, digest and length of what was read."""

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([f for path in b["bundle"] for f in seek_table(path)], columns=list(Frame._fields))

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, start, packed in zip(b["bundle"], b["start"], b["packed"]):
                rows = []
                for _, head, payload in parse_records(read_frame(path, int(start), int(packed))):
                    digest = hashlib.sha256(payload).hexdigest()
                    response = head["warc-type"] == "response"
                    if response and head["warc-payload-digest"] != f"sha256:{digest}":
                        raise ValueError(f"damaged record {head['warc-record-id']}")
                    rows.append((head.get("page-id"), head["warc-record-id"][1:-1], head["warc-type"], head.get("page-refers-to"), head.get("warc-refers-to", "<>")[1:-1], payload.decode("utf-8") if response else None, digest if response else None, len(payload)))
                yield pd.DataFrame(rows, columns=["page_id", "record_id", "record_type", "refers_to", "target", "payload", "digest", "n"])

    found = index.select("bundle").distinct().mapInPandas(frames, "bundle string, frame int, start long, packed long, length long")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    back = found.repartition(tasks, "bundle", "frame").mapInPandas(records, "page_id string, record_id string, record_type string, refers_to string, target string, payload string, digest string, n long")
    response = F.col("record_type") == "response"
    return back.withColumns({"page_id": F.col("page_id").cast("long"), "refers_to": F.col("refers_to").cast("long"), "n": F.when(response, F.col("n"))})


def lookup(spark: SparkSession, index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of the given page ids (column page_id): one seek for each frame that holds any."""

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, data = None, b""
        for b in batches:
            rows = []
            for p, path, frame, offset, length in zip(b["page_id"], b["bundle"], b["frame"], b["offset"], b["length"]):
                if of != (path, frame):
                    of, at = (path, frame), seek_table(path)[frame]
                    data = read_frame(path, at.start, at.packed)
                rows.append((p, data[offset : offset + length]))
            yield pd.DataFrame(rows, columns=["page_id", "record"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = index.join(wanted.select("page_id").where("page_id is not null").distinct(), "page_id", "left_semi")
    met = met.repartition(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
    return met.mapInPandas(pick, "page_id long, record binary")


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 100) -> DataFrame:
    """Write the pages, read the archives back, and resolve revisits: one row per page."""
    spark = pages.sparkSession
    folder = fresh_folder(spark, "warc")
    index = write(pages, folder, key, url, html, min_bytes)
    back = materialise(read(spark, index).drop("payload"), "warc_records")
    read_whole = back.where("record_type = 'response'")
    # a table of its own, so that Spark can split the revisits of one frequent payload
    full = materialise(read_whole.groupBy(F.col("record_id").alias("target")).agg(F.max("n").alias("full_n"), F.max("digest").alias("full_digest")), "warc_payloads")
    discard(spark, folder, index)
    revisits = back.where("record_type <> 'response'").join(full, "target").select("page_id", F.col("full_n").alias("n"), F.col("full_digest").alias("digest"), "record_type", "refers_to")
    both = read_whole.select("page_id", "n", "digest", "record_type", "refers_to").unionByName(revisits)
    return both.select(F.col("page_id").alias(key), F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
