"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

The writer stores equal payloads once: the record with the smallest id is a response, the others
revisit it. The reader takes the dictionary from the leading skippable frame, decodes one frame per
record and validates headers, lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import qualified, scratch_path, stored

DICTIONARY_FRAME = 0x184D2A5D  # the skippable frame that holds a dictionary
ZSTD_MAGIC = 0xFD2FB528
#: Bytes of payload after which a writer begins its next archive, and texts that a dictionary is made from.
ARCHIVE_BYTES, DICTIONARY_SAMPLES, DICTIONARY_BYTES = 16 << 20, 200, 64 << 10
READ_BYTES = 32 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response with the payload, or a revisit with the HTTP head alone; the head always names the full payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"),
        ("WARC-Date", DATE),
        *([] if page_id is None else [("WARC-Page-Id", quote(str(page_id)))]),
        ("WARC-Target-URI", re.sub(r"[\r\n]+", " ", url or "")),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>"), ("WARC-Refers-To-Page-Id", quote(str(refers_to)))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The fields, block and payload of one record; raises ValueError where a header, length or digest is wrong."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name:
            raise ValueError(f"bad header line: {line[:80]!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"missing header: {name}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes where {length} are declared")
    block = rest[:length]
    if (said := fields.get("warc-block-digest")) and said != f"sha1:{payload_digest(block)}":
        raise ValueError("block digest differs")
    http, sep, payload = block.partition(b"\r\n\r\n")
    if not sep or not (m := re.search(rb"(?im)^Content-Length: *(\d+)\r?$", http)):
        raise ValueError("no HTTP head")
    declared = int(m[1])
    if fields["warc-type"] == "response":
        if len(payload) != declared:
            raise ValueError(f"payload of {len(payload)} bytes where {declared} are declared")
        if fields.get("warc-payload-digest") != f"sha1:{payload_digest(payload)}":
            raise ValueError("payload digest differs")
    elif fields["warc-type"] != "revisit" or payload or "warc-refers-to" not in fields:
        raise ValueError("bad revisit record")
    return {"fields": fields, "payload": payload, "payload_bytes": declared}


def frame_dictionary(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary


def leading_dictionary(archive: bytes) -> tuple[bytes, int]:
    """The dictionary of the leading skippable frame and where records begin; a compressed dictionary is unpacked."""
    if len(archive) < 8:
        raise ValueError("archive too short")
    magic, size = struct.unpack_from("<II", archive)
    if magic != DICTIONARY_FRAME:
        return b"", 0
    if len(archive) < 8 + size:
        raise ValueError("dictionary frame cut off")
    found = archive[8 : 8 + size]
    if found[:4] == struct.pack("<I", ZSTD_MAGIC):
        found = zstandard.ZstdDecompressor().decompress(found)
    return found, 8 + size


def read_archive(archive: bytes) -> Iterator[dict]:
    """The records of one archive, a frame each."""
    dictionary, at = leading_dictionary(archive)
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    while at < len(archive):
        (magic,) = struct.unpack_from("<I", archive, at) if at + 4 <= len(archive) else (0,)
        if magic != ZSTD_MAGIC:
            raise ValueError(f"no frame at byte {at}")
        one, parts = decompressor.decompressobj(), []
        while not one.eof:
            piece = archive[at : at + READ_BYTES]
            if not piece:
                raise ValueError("the last frame is cut off")
            parts.append(one.decompress(piece))
            at += len(piece)
        at -= len(one.unused_data)
        yield parse_record(b"".join(parts))


def revisits(pages: DataFrame, min_payload_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html (null: empty), refers_to (the smallest id with the same payload, null for a response).

    Payloads below min_payload_bytes are all responses. Payloads are compared by SHA-256. Rows with the same id
    and payload are all responses; null ids are never referred to, and never revisit if no id is known.
    """
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), html.alias("html"), F.unhex(F.sha2(html, 256)).alias("key"))
    counted = rows.where(F.octet_length("html") >= min_payload_bytes).groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = stored(counted.where("n > 1").select("key", "first"), "payloads")
    return rows.join(first, "key", "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, min_payload_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write every page as a record into archives under path, a folder that driver and executors share.

    A task writes its archives into a folder of its own attempt, which is then renamed to the partition's
    folder: a task that is run again replaces all archives of its partition, whatever their number was.
    """
    path = qualified(pages.sparkSession, path)
    rows = revisits(pages, min_payload_bytes, id_col, url_col, html_col)
    samples = [r[0] for r in rows.limit(DICTIONARY_SAMPLES).select(F.substring("html", 1, 8192)).collect()]
    dictionary = train_dictionary([record("response", i, "", s.encode(), None) for i, s in enumerate(samples)])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pyarrow.fs.FileSystem.from_uri(path)
        task = TaskContext.get()
        final = f"{base}/part-{task.partitionId():06d}"
        own = f"{base}/_part-{task.partitionId():06d}.{task.taskAttemptId()}"
        files.create_dir(own, recursive=True)
        compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)
        number = written = held = 0
        parts: list[bytes] = []

        def close() -> None:
            nonlocal number, held
            if parts:
                with files.open_output_stream(f"{own}/{number:05d}.warc.zst", compression=None) as f:
                    f.write(frame_dictionary(dictionary) if dictionary else b"")
                    for x in parts:
                        f.write(x)
                number, held = number + 1, 0
                parts.clear()

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                payload = html.encode("utf-8", "surrogatepass")
                parts.append(compressor.compress(record("response" if refers_to is None else "revisit", page_id, url, payload, refers_to)))
                held += len(payload)
                written += 1
                if held >= ARCHIVE_BYTES:
                    close()
        close()
        if files.get_file_info(final).type != pyarrow.fs.FileType.NotFound:
            files.delete_dir(final)
        files.move(own, final)
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["written"])

    rows.mapInArrow(write, "written long").agg(F.sum("written")).collect()
    spark = pages.sparkSession
    none = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part-none")  # so that an empty table can be read back
    none.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(none)


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from sample records; none if the samples are too few or too small for one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def read_archives(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """Per record: page_id, url, payload (binary; null for a revisit), payload_bytes, payload_digest, record_type, refers_to.

    Ids are of id_type, as they were written; a record without one has a null id.
    """
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true").load(f"{path}/part-*").select("content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = lambda x: None if x is None else unquote(x)
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for r in read_archive(content.as_py()):
                    f = r["fields"]
                    kind = f["warc-type"]
                    rows.append((name(f.get("warc-page-id")), f.get("warc-target-uri"), r["payload"] if kind == "response" else None, r["payload_bytes"], f["warc-payload-digest"].removeprefix("sha1:"), kind, name(f.get("warc-refers-to-page-id"))))
                    size += len(r["payload"])
                    if len(rows) >= 1000 or size >= 8 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    rows = archives.mapInArrow(read, "page_id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return rows.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def warc_round_trip(pages: DataFrame, min_payload_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write all pages as archives and read them back: read_archives()'s rows. An empty table gives no rows; ids of any type come back as they were."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, min_payload_bytes)
    return read_archives(spark, path, pages.schema["page_id"].dataType.simpleString())
