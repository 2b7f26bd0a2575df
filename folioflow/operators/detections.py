"""Detector and recogniser output: thresholds, defaults, duplicates, fallbacks, digit strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_CLASS = "No_Class"
#: Per recogniser: whether a token at the threshold stays, and the threshold. Fixed values.
TOKEN_RULES = {"paddle": (True, 0.5), "easy_ocr": (False, 0.5), "easy_ocr_boxes": (False, 0.8), "surya": (False, 0.5)}


def confident(confidence: Column, recogniser: str, threshold: float | None = None) -> Column:
    """The recogniser's token filter as a predicate."""
    inclusive, default = TOKEN_RULES[recogniser]
    limit = default if threshold is None else threshold
    return confidence >= limit if inclusive else confidence > limit


def blanked(text: Column, confidence: Column, threshold: float = 0.5) -> Column:
    """All rows stay, the text of those that are not confident becomes empty."""
    return F.when(confidence > threshold, text).otherwise("")


def classified(docs: DataFrame, detections: DataFrame, threshold: float = 0.65, doc: str = "doc_id") -> DataFrame:
    """Detections at or above the threshold (doc, ord, class_name, x1..y2, confidence); a document with none gets one default row."""
    kept = detections.where(F.col("confidence") >= threshold)
    joined = docs.select(doc).join(kept, doc, "left")
    return joined.withColumn("class_name", F.coalesce("class_name", F.lit(NO_CLASS))).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def document_type(detections: DataFrame, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """The first detection of each document in detector order, not the most confident."""
    return detections.groupBy(doc).agg(F.min_by("class_name", F.coalesce(F.col(order), F.lit(0))).alias("class_name"))


def regions(detections: DataFrame, doc: str = "doc_id", order: str = "ord", name: str = "class_name") -> DataFrame:
    """One box per document and class: the last, in the place of the first. Partial aggregation, one shuffle."""
    last = F.max_by(F.struct("x1", "y1", "x2", "y2"), order)
    return detections.groupBy(doc, name).agg(last.alias("box"), F.min(order).alias("place")).select(doc, name, "place", "box.*")


def last_of(detections: DataFrame, class_name: str, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """The last box of one class."""
    return regions(detections.where(F.col("class_name") == class_name), doc, order)


def digit_strings(digits: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Digit detections (doc, ord, x1, digit) read from left to right."""
    ordered = F.array_sort(F.collect_list(F.struct("x1", "ord", "digit")))
    return digits.groupBy(doc).agg(F.array_join(F.transform(ordered, lambda d: d["digit"].cast("string")), "").alias("digits"))


def mean_confidence(tokens: DataFrame, doc: str = "doc_id") -> DataFrame:
    """n, mean confidence and text (tokens in order, one space apart) of each document."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return tokens.groupBy(doc).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"), F.array_join(F.transform(ordered, lambda t: t["text"]), " ").alias("text"))


def with_fallback(docs: DataFrame, primary: DataFrame, secondary: DataFrame, threshold: float = 0.5, doc: str = "doc_id") -> DataFrame:
    """doc, text, confidence: the primary recogniser's if its mean reaches the threshold, else the secondary's if it has tokens, else empty and 0."""
    one = mean_confidence(primary, doc).select(doc, F.col("confidence").alias("c1"), F.col("text").alias("t1"))
    two = mean_confidence(secondary, doc).select(doc, F.col("confidence").alias("c2"), F.col("text").alias("t2"))
    both = docs.select(doc).join(one, doc, "left").join(two, doc, "left")
    first = F.coalesce(F.col("c1") >= threshold, F.lit(False))
    return both.select(
        doc,
        F.when(first, F.col("t1")).otherwise(F.coalesce("t2", F.lit(""))).alias("text"),
        F.when(first, F.col("c1")).otherwise(F.coalesce("c2", F.lit(0.0))).alias("confidence"),
    )


def isolated(result: Column, error: Column) -> Column:
    """A region's text, or its error in the text's place; other regions go on."""
    return F.when(error.isNotNull(), F.concat(F.lit("ERROR: "), error)).otherwise(result)


def folded(regions: DataFrame, doc: str = "doc_id", name: str = "region", text: str = "text", order: str = "ord") -> DataFrame:
    """doc, fields: a map from region to text, later rows overwriting earlier ones."""
    last = regions.groupBy(doc, name).agg(F.max_by(text, order).alias(text), F.min(order).alias("place"))
    entries = F.array_sort(F.collect_list(F.struct("place", F.col(name).alias("key"), F.col(text).alias("value"))))
    return last.groupBy(doc).agg(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], e["value"]))).alias("fields"))


def page(df: DataFrame, number: int = 1, size: int = 10, *order: str) -> DataFrame:
    """One page of the ordered rows, with the number of rows and pages."""
    counted = df.agg(F.count(F.lit(1)).alias("total_items"))
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.withColumn("total_items", counted.scalar()).withColumn("total_pages", F.ceil(F.col("total_items") / size))
