"""Helpers that several corpus operators use: scratch tables, Arrow views of text, row keys."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words in every contract here.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_BYTES = np.zeros(256, dtype=bool)
BLANK_BYTES[[9, 10, 11, 12, 13, 32]] = True


def scratch_root(spark: SparkSession) -> str:
    """A folder of this application in the shared one that the cluster names in spark.checkpoint.dir; deleted when the driver ends.

    Where that is unset, a local master gets a temporary folder; on a cluster every executor would write to a disk of
    its own, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _own_root(spark.sparkContext.applicationId)
    return _application_folder(root.rstrip("/"), spark.sparkContext.applicationId)


@functools.cache
def _application_folder(root: str, application: str) -> str:
    """With its scheme, so that every reader and writer resolves the same place."""
    spark = SparkSession.active()
    own = qualified(spark, f"{root}/folioflow-{application}")
    path = spark._jvm.org.apache.hadoop.fs.Path(own)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return own


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark's readers resolve it to, so that others write to the same place."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    name = own.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(own).toString()
    return f"file:///{name.removeprefix('file:').lstrip('/')}" if name.startswith("file:") else name


@functools.cache
def _own_root(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="folioflow-")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives the loss of executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table that stored() wrote, once nothing reads it any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_id: str = "doc_id") -> DataFrame:
    """Only the two columns an operator works on; a null text is an empty text."""
    return docs.select(F.col(f"`{id_col}`").alias(out_id), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column without decoding them; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def groups_by_size(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring items whose sizes add up to about limit, so that array memory stays bounded."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)
