"""Where results go."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import png

try:
    from PIL import Image
except ImportError:  # PNG needs no image library, other formats do
    Image = None


def write_json(results: DataFrame, path: str) -> None:
    """Results as JSON lines, replacing what was there; null fields are left out."""
    results.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def base64_content(contents: DataFrame, column: str = "content") -> DataFrame:
    return contents.withColumn(column, F.base64(column))


def verification_response(results: DataFrame) -> DataFrame:
    """doc_id, image (bytes of the base64 picture), first_class: of each verification result."""
    return results.select("doc_id", F.try_to_binary("image", F.lit("base64")).alias("image"), F.get("results", F.lit(0))["class_name"].alias("first_class"))


def image_bytes(image: np.ndarray, format: str = "PNG") -> bytes:
    """An encoded picture of an array (blue, green, red); other types than bytes are taken as 0..1."""
    if format.upper() == "PNG":
        return png.encoded(image)
    if Image is None:
        raise ValueError(f"no encoder for {format} is installed")
    image = image if image.dtype == np.uint8 else (image * 255).astype(np.uint8)
    out = io.BytesIO()
    Image.fromarray(image[..., ::-1] if image.ndim == 3 and image.shape[2] == 3 else image).save(out, format=format)
    return out.getvalue()


def encoded_images(images: DataFrame, format: str = "PNG") -> DataFrame:
    """(doc_id, height, width, channels, data) -> (doc_id, content, error): pictures for a binary sink; a row that fails has an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, errors = [], []
            for h, w, c, data in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                try:
                    contents.append(image_bytes(np.frombuffer(data, np.uint8).reshape((h, w) if c == 1 else (h, w, c)), format))
                    errors.append(None)
                except (ValueError, TypeError, KeyError, OSError) as e:
                    contents.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(contents, pa.binary()), pa.array(errors, pa.string())], names=["doc_id", "content", "error"])

    picked = images.select("doc_id", "height", "width", "channels", "data")
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, content binary, error string")


def write_pictures(contents: DataFrame, path: str) -> None:
    """Pictures as rows (doc_id, content) of a table, replacing what was there: crops and annotated images, only where they are asked for."""
    contents.where("content is not null").select("doc_id", "content").write.mode("overwrite").parquet(path)
