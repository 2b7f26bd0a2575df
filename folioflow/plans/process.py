"""The whole way from documents to parsed records, with detectors and recognisers as plug-ins.

A detector and a recogniser are iterators over Arrow batches (`mapInArrow`): built once per worker, fed in
batches. What they find is written once, before the branches that read it, so that no model runs twice.
Everything between them is expressions and one shuffle by document.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mrz, national_id
from ..operators import detections as det
from ..operators import layout
from . import envelope, routing

Plugin = Callable[[DataFrame], DataFrame]


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df, computed now and once: a table in a shared folder (that which spark.checkpoint.dir names), deleted when the driver
    ends; kept on the executors where there is none."""
    spark = df.sparkSession
    root = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        return df.persist()
    path = f"{root.rstrip('/')}/records-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def _seconds(rows: DataFrame) -> Column:
    return F.sum("seconds") if "seconds" in rows.columns else F.sum(F.lit(0.0))


def process(docs: DataFrame, detector: Plugin, regions: Plugin, recogniser: Plugin, engine: str = "paddle", language: str = "ar", threshold: float = 0.65) -> DataFrame:
    """doc_id, document_type, parser, fields (JSON), error, metadata.

    detector: docs -> (doc_id, ord, class_name, confidence, x1, y1, x2, y2); regions: docs with document_type ->
    (doc_id, ord, class_name, x1, y1, x2, y2); recogniser: routed regions -> tokens of `layout.text`, keyed by region_id.
    A detector's or recogniser's column seconds (`plugins` has it) adds up to the document's processing time.
    """
    found = written(detector(docs))
    typed = det.document_type(det.classified(docs, found, threshold))
    typed = typed.withColumnRenamed("class_name", "document_type").withColumn("error", F.when(~routing.processable(F.col("document_type")), "PreprocessingException"))
    good = docs.join(typed.where("error is null"), "doc_id")
    boxes = det.regions(regions(good))
    choice = routing.region_engine(F.col("class_name"), F.lit(engine), F.lit(language))
    routed = written(boxes.withColumn("choice", choice).withColumn("region_id", F.concat_ws("/", F.col("doc_id").cast("string"), "class_name")))
    tokens = written(recogniser(routed))
    texts = layout.text(tokens, "region_id", language).withColumnRenamed("text", "region_text")
    read = routed.join(texts, "region_id", "left").select("doc_id", F.col("class_name").alias("region"), F.col("place").alias("ord"), F.coalesce("region_text", F.lit("")).alias("text"))
    kinds = typed.select("doc_id", routing.parser(F.col("document_type")).alias("parser"))
    with_kind = read.join(kinds, "doc_id")
    cards = national_id.fold(with_kind.where("parser = 'id_card'"))
    zones = mrz.fold(with_kind.where("parser = 'mrz'")).select("doc_id", F.col("region").alias("field"), F.coalesce(F.to_json("mrz"), "text").alias("value"))
    general = with_kind.where("parser = 'general'").select("doc_id", F.col("region").alias("field"), F.col("text").alias("value"))
    fields = cards.unionByName(zones).unionByName(general).groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value"))))).alias("fields"))
    detecting = found.groupBy("doc_id").agg(_seconds(found).alias("spent"))
    reading = routed.select("doc_id", "region_id").join(tokens.groupBy("region_id").agg(_seconds(tokens).alias("s")), "region_id").groupBy("doc_id").agg(F.sum("s").alias("spent"))
    spent = detecting.unionByName(reading).groupBy("doc_id").agg(F.sum("spent").alias("spent"))
    meta = envelope.metadata(F.col("document_type"), F.lit(engine), F.lit(language), F.coalesce("spent", F.lit(0.0)), F.current_timestamp())
    out = typed.join(fields, "doc_id", "left").join(kinds, "doc_id", "left").join(spent, "doc_id", "left")
    return out.select("doc_id", "document_type", "parser", "fields", "error", meta.alias("metadata"))
