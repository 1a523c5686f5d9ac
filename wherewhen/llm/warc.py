"""WARC archives with one Zstandard dictionary per file.

A dictionary is built from a bounded sample of the records, stands in a leading
skippable frame of every file and compresses each record as a frame of its own,
so any record can be read with the file's head and its own bytes. Records whose
payload another record holds become revisits without a payload.

Every task writes files of its own, under names no other attempt uses, straight
to the shared file system; only the files that a finished attempt lists are in
the returned manifest, so a lost or repeated task leaves no trace in the result.
The folder's scheme has to be one that ``pyarrow.fs`` opens (file, hdfs, s3, gs).

Defined results: null payloads count as empty; equal payloads refer to the one
with the largest page_id, null ids being smallest, and rows that repeat that id
and payload are responses too. Payloads under ``min_bytes`` are all responses.
An empty table gives an empty manifest and no record.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, shared_folder, stored

# Fixed values of the formats: the magic numbers of a dictionary's skippable frame
# and of a structured dictionary, and the profile of identical payloads.
FRAME_MAGIC = 0x184D2A5D
DICTIONARY_MAGIC = 0xEC30A437
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record with its two closing line ends."""
    digest = payload_digest(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))), ("X-Payload-Length", str(len(payload))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~ ")))
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if revisit:
        fields.append(("WARC-Profile", SAME_PAYLOAD))
        fields.append(("WARC-Refers-To", record_id(refers_to, digest)))
        if refers_to is not None:
            fields.append(("X-Refers-To-Page", str(refers_to)))
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def payload_decisions(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, sha1, size, refers_to, revisit for each distinct page and payload; payloads stay where they are."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.sha1(_payload()).alias("sha1"), F.octet_length(_payload()).cast("long").alias("size"),
    ).distinct()
    first = rows.groupBy("sha1", "size").agg(F.max("page_id").alias("first"))
    revisit = (F.col("size") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(first, ["sha1", "size"]).select(
        "page_id", "sha1", "size", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit")
    )


def _payload():
    return F.coalesce(F.col("html").cast("string"), F.lit(""))


def record_dictionary(pages: DataFrame, date: str, *, records: int = 400, record_limit: int = 16384, size: int = 65536) -> bytes:
    """A dictionary from at most ``records`` records, those with the least hash of id and text.

    Of each record the first ``record_limit`` characters teach; both bounds and
    ``size`` are constants, whatever the input. The hashes are ranked alone, and
    only the records they choose, once each, come to the driver. Too small a
    sample becomes the dictionary as it is.
    """
    rows = pages.select("page_id", "url", F.substring(_payload(), 1, record_limit).alias("html"))
    rows = rows.withColumn("draw", F.xxhash64("page_id", "html"))
    least = rows.select("draw").distinct().orderBy("draw").limit(records).agg(F.max("draw")).first()[0]
    chosen = rows.where(F.col("draw") <= F.lit(least)).groupBy("draw").agg(F.min(F.struct("page_id", "url", "html")).alias("row"))
    sample = chosen.orderBy("draw").select("row.*").collect()
    texts = [record_bytes(r["page_id"], r["url"], r["html"].encode(), None, False, date) for r in sample]
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-size:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    known = len(data) >= 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_MAGIC
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if known else zstandard.DICT_TYPE_RAWCONTENT)


def write_archives(
    pages: DataFrame, folder: str, *, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 3,
    file_bytes: int = 1 << 30,
) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html) in ``folder``; a manifest of path, records, bytes.

    A file is closed once it holds ``file_bytes``.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), _payload().alias("html"))
    words = record_dictionary(rows, date)
    rows = rows.withColumn("sha1", F.sha1("html")).withColumn("size", F.octet_length("html").cast("long"))
    other = payload_decisions(pages, min_bytes).select(
        F.col("page_id").alias("d_id"), F.col("sha1").alias("d_sha1"), F.col("size").alias("d_size"), "refers_to", "revisit"
    )
    # Ids are all but unique, so the join that moves the payloads has no hot key.
    same = rows["page_id"].eqNullSafe(other["d_id"]) & (rows["sha1"] == other["d_sha1"]) & (rows["size"] == other["d_size"])
    todo = rows.join(other, same).select("page_id", "url", "html", "refers_to", "revisit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        packer = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(words))
        task, part, out, done = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, None, []

        def close() -> None:
            size = out.tell()
            out.close()
            done.append({"path": f"{folder}/{name}", "records": records, "bytes": size})

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, refers_to, revisit = (batch.column(c)[i].as_py() for c in range(5))
                if out is None:
                    name, records = f"pages-{task}-{part:04d}.warc.zst", 0
                    out = system.open_output_stream(f"{base}/{name}")
                    out.write(struct.pack("<II", FRAME_MAGIC, len(words)) + words)
                out.write(packer.compress(record_bytes(page_id, url, html.encode(), refers_to, revisit, date)))
                records += 1
                if out.tell() >= file_bytes:
                    close()
                    out, part = None, part + 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return stored(todo.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of each record of an uncompressed WARC stream."""
    while line := stream.readline():
        if line.strip() == b"":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline().decode().rstrip("\r\n")) != "":
            name, _, value = line.partition(": ")
            fields[name] = value
        yield fields, stream.read(int(fields["Content-Length"]))


def read_archive(raw) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of one archive: the leading frame gives the dictionary for the others."""
    magic, length = struct.unpack("<II", raw.read(8))
    if magic != FRAME_MAGIC:
        raise ValueError("the archive does not begin with a dictionary frame")
    unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(raw.read(length)))
    return parse_records(io.BufferedReader(unpacker.stream_reader(raw, read_across_frames=True), 1 << 18))


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row per record: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, intact.

    ``payload`` is null for revisits; ``intact`` says that a response's payload
    has the length and digest its fields state.
    """
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.string()), ("intact", pa.bool_()),
    ])

    def row(fields: dict[str, str], block: bytes) -> dict:
        whole = fields["WARC-Type"] == "response"
        payload = block.partition(b"\r\n\r\n")[2] if whole else None
        number = {k: int(fields[k]) if k in fields else None for k in ("X-Page-Id", "X-Refers-To-Page", "X-Payload-Length")}
        digest = fields["WARC-Payload-Digest"].partition(":")[2]
        return {
            "page_id": number["X-Page-Id"], "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
            "refers_to": number["X-Refers-To-Page"], "payload_bytes": number["X-Payload-Length"], "payload_digest": digest,
            "payload": payload.decode() if whole else None,
            "intact": not whole or (len(payload) == number["X-Payload-Length"] and payload_digest(payload) == digest),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, at = fs.FileSystem.from_uri(path)
                with system.open_input_stream(at) as raw:
                    rows, size = [], 0
                    for fields, block in read_archive(raw):
                        rows.append(row(fields, block))
                        size += len(block)
                        if size > 1 << 22 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    spread = manifest.select("path").repartition(partitions(manifest.sparkSession))
    return spread.mapInArrow(run, (
        "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
        "payload string, intact boolean"
    ))


def archived(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to a new shared folder and read the archives back."""
    return read_archives(write_archives(pages, shared_folder(pages.sparkSession, "warc"), **options))
