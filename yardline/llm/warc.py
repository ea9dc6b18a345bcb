"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames with a seek table in a
skippable frame at its end. Each frame holds a group of WARC records; a record
is found by its bundle, frame and offset in the frame. Writers name their files
anew for every attempt, and the index, written once, names only the files of
attempts that ended well; so retries never mix.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from yardline.llm.storage import partitions, shared_folder, stored

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 256 << 20
LEAST_REVISIT = 100
LEVEL = 3

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

INDEX = "page_id {id}, bundle string, frame long, frame_start long, frame_bytes long, offset long, length long"


def _record(kind: str, page_id, url: str | None, digest: str, size: int, refers_to, payload: bytes) -> bytes:
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(head).encode() + payload + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record: {lines[0]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return fields, rest[:size]


class BundleWriter:
    """Appends records; frames close at FRAME_BYTES. ``close`` writes the seek table."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.path, self.out, self.pack = path, fs.open_output_stream(path, compression=None), zstandard.ZstdCompressor(level=LEVEL)
        self.table: list[tuple[int, int]] = []
        self.at, self.frame = 0, bytearray()
        self.waiting: list[tuple[object, int, int]] = []

    def add(self, key, record: bytes) -> list[tuple]:
        self.waiting.append((key, len(self.frame), len(record)))
        self.frame += record
        return self.flush() if len(self.frame) >= FRAME_BYTES else []

    def flush(self) -> list[tuple]:
        """Index rows of the records of the frame that is closed now."""
        if not self.waiting:
            return []
        packed = self.pack.compress(bytes(self.frame))
        self.out.write(packed)
        rows = [(key, self.path, len(self.table), self.at, len(packed), offset, length) for key, offset, length in self.waiting]
        self.table.append((len(packed), len(self.frame)))
        self.at += len(packed)
        self.frame, self.waiting = bytearray(), []
        return rows

    def close(self) -> list[tuple]:
        rows = self.flush()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        self.out.close()
        return rows


def seek_table(fs: pafs.FileSystem, path: str) -> list[tuple[int, int]]:
    """(start, bytes) of each frame of a bundle, from its footer."""
    with fs.open_input_file(path) as f:
        size = f.size()
        n, flags, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or flags:
            raise ValueError(f"{path} has no seek table")
        sizes = np.frombuffer(f.read_at(8 * n, size - 9 - 8 * n), "<u4").reshape(n, 2)[:, 0].astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if n else sizes
    return list(zip(starts.tolist(), sizes.tolist()))


def plan_records(pages: DataFrame) -> DataFrame:
    """Each row of ``pages`` with ``payload_digest, record_type, refers_to``: of equal payloads of LEAST_REVISIT bytes or more the one with the least id is whole.

    Rows of that id, and rows without an id, are whole too.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    told = pages.select("page_id", "url", "html", F.octet_length(payload).alias("_bytes"), F.sha2(payload, 256).alias("payload_digest"))
    first = told.where(F.col("_bytes") >= LEAST_REVISIT).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    again = told.join(first.where("n > 1").drop("n"), "payload_digest", "left")
    revisit = F.col("first") < F.col("page_id")
    return again.select(
        "page_id",
        "url",
        "html",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages as bundles under ``folder``; the index of the records, as a stored table."""
    rows = plan_records(pages)
    id_type = pages.schema["page_id"].dataType.simpleString()
    kinds = [to_arrow_type(pages.schema["page_id"].dataType), pa.string(), *[pa.int64()] * 5]
    names = ["page_id", "bundle", "frame", "frame_start", "frame_bytes", "offset", "length"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(folder)
        fs.create_dir(top, recursive=True)
        bundle = None

        def batch_of(index: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index), kinds)], names)

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "payload_digest", "record_type", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, html, digest, kind, refers_to = (c[i].as_py() for c in columns)
                payload = (html or "").encode()
                bundle = bundle or BundleWriter(fs, f"{top}/{uuid.uuid4().hex}.warc.zst")
                record = _record(kind, page_id, url, digest, len(payload), refers_to, b"" if kind == "revisit" else payload)
                if done := bundle.add(page_id, record):
                    yield batch_of(done)
                if bundle.at >= BUNDLE_BYTES:
                    if done := bundle.close():
                        yield batch_of(done)
                    bundle = None
        if bundle and (done := bundle.close()):
            yield batch_of(done)

    return stored(rows.mapInArrow(write, INDEX.format(id=id_type)))


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Read the indexed records: ``page_id, record_type, payload_bytes, payload_digest, refers_to, url, payload``.

    Frames are read one after another, each once; the digest of a whole record
    is taken anew and must agree with its header.
    """
    spark = index.sparkSession
    id_type = index.schema["page_id"].dataType.simpleString()
    arrow_id = to_arrow_type(index.schema["page_id"].dataType)
    to_id = str if id_type == "string" else int
    schema = f"page_id {id_type}, record_type string, payload_bytes long, payload_digest string, refers_to {id_type}, url string, payload binary"
    kinds = [arrow_id, pa.string(), pa.int64(), pa.string(), arrow_id, pa.string(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        unpack = zstandard.ZstdDecompressor()
        opened, table, frame, at = None, [], b"", (None, -1)
        for batch in batches:
            out, held = [], 0
            for row in batch.to_pylist():
                if opened is None or at[0] != row["bundle"]:
                    if opened is not None:
                        opened.close()
                    opened, table = fs.open_input_file(row["bundle"]), seek_table(fs, row["bundle"])
                if at != (row["bundle"], row["frame"]):
                    start, size = table[row["frame"]]
                    if (start, size) != (row["frame_start"], row["frame_bytes"]):
                        raise ValueError("index and seek table differ")
                    frame = unpack.decompress(opened.read_at(size, start))
                    at = (row["bundle"], row["frame"])
                fields, payload = parse_record(frame[row["offset"] : row["offset"] + row["length"]])
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                if fields["WARC-Record-ID"] != f"<urn:page:{row['page_id']}>" or fields["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"record of page {row['page_id']} is damaged")
                refers = fields.get("WARC-Refers-To")
                refers = to_id(refers.removeprefix("<urn:page:").removesuffix(">")) if refers else None
                out.append((row["page_id"], fields["WARC-Type"], int(fields["X-Payload-Length"]), digest, refers, fields.get("WARC-Target-URI"), payload))
                held += len(payload)
                if held > FRAME_BYTES or len(out) >= 512:
                    yield _rows(out, kinds)
                    out, held = [], 0
            if out:
                yield _rows(out, kinds)

    dealt = index.repartition(partitions(spark), "bundle", F.floor(F.col("frame") / 64)).sortWithinPartitions("bundle", "frame", "offset")
    return dealt.mapInArrow(read, schema)


def _rows(out: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    names = ["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "url", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def archive(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (``page_id, url, html``) to archives in the shared folder and read them back.

    Null pages have empty payloads; they and short ones are always whole, as
    are rows without an id. Each row gives one record, also where ids repeat,
    with equal payloads or with others; no rows, no files. Other columns are ignored.
    """
    folder = shared_folder(pages.sparkSession)
    return read_archives(write_archives(pages, folder), folder)
