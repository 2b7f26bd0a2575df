"""Where documents come from: files, URLs, uploads, a scanner's drop folder. All give (doc_id, content, error)."""

from __future__ import annotations

import io
import urllib.request
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.routing import source_kind
from . import png

try:
    from PIL import Image
except ImportError:  # PNG needs no image library, other formats do
    Image = None


def from_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row per file; content stays binary and is dropped before any shuffle that does not need it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("doc_id"), "content", F.lit(None).cast("string").alias("error"))


def scanner_folder(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the files that a scanner drops into a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).load(path).select(F.col("path").alias("doc_id"), "content")


def scanner_status(events: DataFrame) -> DataFrame:
    """The last status of each scan: idle, initializing, scanning, processing, completed or error."""
    return events.groupBy("scan_id").agg(F.max_by("status", "ts").alias("status"))


def fetched(urls: DataFrame, column: str = "url", timeout: float = 30.0) -> DataFrame:
    """The bodies of URLs, fetched where the rows are; a failure is a row with an error, not a failed job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, errors = [], []
            for url in batch.column(0).to_pylist():
                try:
                    with urllib.request.urlopen(url, timeout=timeout) as answer:
                        bodies.append(answer.read())
                    errors.append(None)
                except (OSError, ValueError, AttributeError) as e:
                    bodies.append(None)
                    errors.append(f"InputSourceException: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary()), pa.array(errors, pa.string())], names=["doc_id", "content", "error"])

    return urls.select(column).mapInArrow(run, "doc_id string, content binary, error string")


def dispatched(requests: DataFrame, listing: DataFrame, column: str = "input_data") -> DataFrame:
    """requests with the kind of each input (url, file, scanner) or an error; listing: the paths that exist, in column path."""
    known = listing.select(F.col("path").alias("__path")).distinct().withColumn("__exists", F.lit(True))
    joined = requests.join(known, requests[column] == F.col("__path"), "left")
    kind = source_kind(F.col(column), F.coalesce("__exists", F.lit(False)))
    return joined.withColumn("kind", kind).withColumn("error", F.when(kind.isNull(), "ValueError")).drop("__path", "__exists")


def chosen_bytes(upload: Column, fetched_bytes: Column) -> Column:
    """struct<content, kind, error>: an upload wins over what was fetched; with neither, an error."""
    return F.struct(F.coalesce(upload, fetched_bytes).alias("content"), F.when(upload.isNotNull(), "bytes").alias("kind"), F.when(upload.isNull() & fetched_bytes.isNull(), "ValueError").alias("error"))


def decoded(contents: DataFrame) -> DataFrame:
    """(doc_id, content) -> (doc_id, height, width, channels, data, error): RGB pixels of an encoded image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for content in batch.column(1).to_pylist():
                try:
                    if Image is None or content[:8] == png.SIGNATURE:
                        image = png.rgb(content)
                        rows.append((*image.shape, np.ascontiguousarray(image).tobytes(), None))
                    else:
                        image = Image.open(io.BytesIO(content)).convert("RGB")
                        rows.append((image.height, image.width, 3, image.tobytes(), None))
                except (OSError, ValueError, TypeError) as e:
                    rows.append((None, None, None, None, f"InputSourceException: {e}"))
            types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "height", "width", "channels", "data", "error"])

    picked = contents.select("doc_id", "content")
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, height int, width int, channels int, data binary, error string")


def as_rgb_png(contents: DataFrame) -> DataFrame:
    """(doc_id, content) -> (doc_id, content, error): every picture as a PNG in red, green and blue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, w, c, data in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                out.append(None if data is None else png.encoded(np.frombuffer(data, np.uint8).reshape(h, w, c)[..., ::-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(5)], names=["doc_id", "content", "error"])

    pixels = decoded(contents)
    return pixels.mapInArrow(run, f"doc_id {pixels.schema['doc_id'].dataType.simpleString()}, content binary, error string")


def first_given(content: Column, path_content: Column, pixels: Column) -> Column:
    """struct<given, error>: which of an image's three forms is read: bytes win over a path, a path over an array; none is an error."""
    given = F.when(content.isNotNull(), "bytes").when(path_content.isNotNull(), "path").when(pixels.isNotNull(), "array")
    return F.struct(given.alias("given"), F.when(given.isNull(), "ValueError").alias("error"))


#: A scan's states, in the order in which they can follow each other; an error can follow each but the last. Fixed values.
SCAN_STATES = ("idle", "initializing", "scanning", "processing", "completed")


def scanner_transitions(events: DataFrame) -> DataFrame:
    """scan_id, ts, status, valid of each event: the first is idle, the others go one step on, back to idle from the end, or to error."""
    place = F.array_position(F.array(*map(F.lit, SCAN_STATES)), F.col("status"))
    before = F.lag("status").over(Window.partitionBy("scan_id").orderBy("ts"))
    known = F.array_position(F.array(*map(F.lit, SCAN_STATES)), before)
    follows = F.when(before.isNull(), F.col("status") == "idle").when(before.isin("error", "completed"), F.col("status").isin("idle", "initializing"))
    return events.select("scan_id", "ts", "status", follows.otherwise((F.col("status") == "error") | (place == known + 1)).alias("valid"))
