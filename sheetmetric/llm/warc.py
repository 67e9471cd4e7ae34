"""WARC archives of pages with a Zstandard dictionary (``.warc.zst``), and their reader.

Each record is a Zstandard frame of its own, so that any of them can be read alone; what records share (headers,
markup) is in a dictionary that is trained on records of the same table and stands in a skippable frame at the
front of each archive. Of pages with equal payloads one is a response, the others are revisits that refer to it.

Tasks write archives side by side into a folder that all executors reach, under names of their own. The table of
finished archives, committed by Spark, tells which are whole: what a lost task left behind is in no row of it.
"""
from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetmetric.llm.text import col, slices
from sheetmetric.session import cut_lineage, shared_folder

# fixed values of the formats
SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

LEAST_BYTES = 100           # smaller payloads are always stored
HOT = 1_000                 # payloads of more than a HOT-th of all rows are looked up without a shuffle; there are fewer than HOT
SAMPLED = 2_000             # records, about, that the dictionary is trained on ...
SAMPLED_BYTES = 1 << 14     # ... and bytes of the payload of each
DICTIONARY_BYTES = 1 << 16
LEVEL = 3
ARCHIVE_BYTES = 1 << 30     # a task goes on to its next archive beyond it
DATE = "1970-01-01T00:00:00Z"
BLOCK = 1 << 16
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def plan(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, digest, record_type and refers_to of each page.

    Counts per digest are aggregates with partial sums. Commonest payloads are found by a lookup of fewer than
    ``HOT`` rows, so that no task of the join by digest gets all rows of one of them; rows that cannot have copies are dealt evenly.
    """
    rows = pages.select(col("page_id").cast("long").alias("page_id"), col("url").cast("string").alias("url"), F.coalesce(col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= least_bytes
    copies = cut_lineage(rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    total = rows.count()
    hot = copies.where(F.col("n") * HOT > total).select(F.col("digest").alias("hot_digest"), F.col("first").alias("hot_first"))
    rest = copies.where(F.col("n") * HOT <= total).select(F.col("digest").alias("key"), "first")
    rows = rows.join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left")
    alone = F.concat(F.lit("-"), F.monotonically_increasing_id())
    rows = rows.withColumn("key", F.when(large & F.col("hot_digest").isNull(), F.col("digest")).otherwise(alone))
    first = F.coalesce("hot_first", "first")
    again = first.isNotNull() & ~first.eqNullSafe(F.col("page_id"))
    return rows.join(rest, "key", "left").select(
        "page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "digest", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, first).alias("refers_to"), F.octet_length("payload").cast("long").alias("payload_bytes"))


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, payload_bytes: int, digest: str, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One WARC record; a revisit holds the head of the HTTP answer only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]~%-._")))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    body = head if revisit else head + payload
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + body + b"\r\n\r\n"


def archive_head(dictionary: bytes, level: int = LEVEL) -> bytes:
    """What an archive begins with: the dictionary, itself compressed, in a skippable frame."""
    if not dictionary:
        return b""
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(fields by lower-case name, block) of a record."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]}")
    fields = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines[1:])}
    size = int(fields["content-length"])
    if len(data) != end + 4 + size + 4:
        raise ValueError("a record's length differs from its Content-Length")
    return fields, data[end + 4:end + 4 + size]


def records(stream: BinaryIO) -> Iterator[bytes]:
    """The records of an archive, one after the other, read in blocks."""
    left, options = stream.read(8), {}
    if len(left) == 8 and struct.unpack("<II", left)[0] == SKIPPABLE:
        raw = stream.read(struct.unpack("<II", left)[1])
        left = b""
        if raw.startswith(FRAME):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        options["dict_data"] = zstandard.ZstdCompressionDict(raw)
    unpack = zstandard.ZstdDecompressor(**options)
    while True:
        frame, parts = unpack.decompressobj(), []
        while not frame.eof:
            left = left or stream.read(BLOCK)
            if not left:
                if parts:
                    raise ValueError("the archive ends within a record")
                return
            parts.append(frame.decompress(left))
            left = frame.unused_data
        yield b"".join(parts)


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder as Spark names it."""
    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def train(planned: DataFrame, size: int = DICTIONARY_BYTES, sampled: int = SAMPLED) -> bytes:
    """A dictionary from about ``sampled`` records drawn evenly from the table (at most twice as many, 16 KB of each payload).

    Trained in one task; ``size`` bytes reach the driver. Empty where there are too few records to train on.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = [record(*row.values()) for part in slices(batches) for row in part.to_pylist()]
        try:
            found = [zstandard.train_dictionary(size, samples, k=200, d=8, level=LEVEL).as_bytes()] if samples else []
        except (zstandard.ZstdError, ValueError):       # too little to learn from
            found = []
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["dictionary"])

    total = planned.count()
    drawn = planned.where(F.rand(1) < sampled / max(total, 1)).limit(2 * sampled)
    drawn = drawn.select("page_id", "url", F.substring("payload", 1, SAMPLED_BYTES).alias("payload"), F.octet_length("payload").alias("payload_bytes"), "digest", F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit"))
    rows = drawn.repartition(1).mapInArrow(run, "dictionary binary").collect()
    return bytes(rows[0]["dictionary"]) if rows else b""


def write(planned: DataFrame, folder: str, dictionary: bytes, level: int = LEVEL, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> DataFrame:
    """Writes archives of the rows of ``plan`` into ``folder`` and returns the table of them (path, n_records, bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = {}
        if dictionary:
            options["dict_data"] = zstandard.ZstdCompressionDict(dictionary)
            options["dict_data"].precompute_compress(level=level)
        pack, head = zstandard.ZstdCompressor(level=level, **options), archive_head(dictionary)
        system, place = open_folder(f"{folder}/archives")
        system.create_dir(place)
        out = name = None
        count = size = 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], ["path", "n_records", "bytes"])

        for part in slices(batches):
            for row in part.to_pylist():
                if out is None:
                    name = f"{folder}/archives/pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4()}.warc.zst"
                    out, count, size = system.open_output_stream(open_folder(name)[1], compression=None), 0, len(head)
                    out.write(head)
                frame = pack.compress(record(row["page_id"], row["url"], row["payload"], row["payload_bytes"], row["digest"], row["refers_to"], row["record_type"] == "revisit", date))
                out.write(frame)
                count, size = count + 1, size + len(frame)
                if size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    done = planned.mapInArrow(run, "path string, n_records long, bytes long")
    done.write.parquet(f"{folder}/written")
    return planned.sparkSession.read.schema(done.schema).parquet(f"{folder}/written")


def read(written: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the archives named in ``written``: columns of ``READ``, the payload where asked for (null for revisits).

    Length and digest of responses are those of the payload read (SHA-256 in the JVM), those of revisits what the record says.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

        for part in batches:
            for path in part.column(0).to_pylist():
                system, place = open_folder(path)
                rows, held = [], 0
                with system.open_input_stream(place, compression=None) as stream:
                    for data in records(stream):
                        fields, block = parse(data)
                        head, payload = block.split(b"\r\n\r\n", 1)
                        length = next(int(line.split(b":")[1]) for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:"))
                        again = fields["warc-type"] == "revisit"
                        number = [int(fields[k]) if k in fields else None for k in ("x-page-id", "x-refers-to-page-id")]
                        rows.append((number[0], fields.get("warc-target-uri"), length if again else len(payload), fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"], number[1], None if again else payload))
                        held += len(data)
                        if len(rows) >= 256 or held >= 1 << 22:
                            yield batch(rows)
                            rows, held = [], 0
                yield batch(rows)

    files = max(written.count(), 1)
    found = written.select("path").repartition(min(files, 100_000)).mapInArrow(run, READ)
    found = found.withColumn("payload_digest", F.coalesce(F.sha2("payload", 256), "payload_digest"))
    return found if payloads else found.drop("payload")


def archive(pages: DataFrame, folder: str | None = None, least_bytes: int = LEAST_BYTES, **options) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives; the table of them (path, n_records, bytes).

    One record for each row. Null html is an empty payload, a null url leaves the target out; control characters, spaces and
    letters beyond ASCII in urls are percent-encoded. Rows that share the smallest page_id of a payload are
    all responses (and share a record id); a null page_id is never the one referred to, and where a payload has
    no other ids, all its records are responses. An empty table gives no archives; other columns are not read.
    """
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4()}"
    planned = plan(pages, least_bytes)
    rows = pages.select(col("page_id").cast("long").alias("page_id"), col("url").cast("string").alias("url"), F.coalesce(col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    return write(planned, folder, train(rows.withColumn("digest", F.sha2("payload", 256))), **options)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each page, as read back from its archives."""
    return read(archive(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
