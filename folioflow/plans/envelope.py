"""Response envelopes: metadata, success and error records, pagination. JSON drops null fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def metadata(document_type: Column, engine: Column, language: Column, seconds: Column, at: Column) -> Column:
    """The time is rounded half to even, the stamp is UTC."""
    return F.struct(
        document_type.alias("document_type"),
        engine.alias("ocr_engine"),
        language.alias("language"),
        F.bround(seconds, 3).alias("processing_time_seconds"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("processed_at"),
    )


def success(data: Column, message: Column, pagination: Column | None = None) -> Column:
    fields = [F.lit(True).alias("success"), message.alias("message"), data.alias("data")]
    return F.to_json(F.struct(*fields, *([] if pagination is None else [pagination.alias("pagination")])), {"ignoreNullFields": "true"})


def failure(message: Column, code: Column | None = None, path: Column | None = None) -> Column:
    detail = F.struct(F.coalesce(code, F.lit("UNKNOWN_ERROR")).alias("code") if code is not None else F.lit("UNKNOWN_ERROR").alias("code"), message.alias("message"), (path if path is not None else F.lit(None).cast("string")).alias("path"))
    return F.to_json(F.struct(F.lit(False).alias("success"), message.alias("message"), F.array(detail).alias("errors")), {"ignoreNullFields": "true"})


def error_path(location: Column) -> Column:
    return F.array_join(location, ".")


def general_parse(text: Column) -> Column:
    """The parser of documents without fields of their own."""
    return F.struct(text.alias("raw_text"), text.alias("processed_text"), F.lit("general_parser").alias("parser_type"))


def stripped(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))


def field_valid(name: Column, confidence: Column) -> Column:
    """An extracted field has a name and a confidence from 0 to 1."""
    return name.isNotNull() & (confidence >= 0) & (confidence <= 1)


def input_given(kind: Column, data: Column) -> Column:
    """Input data must be given unless the bytes themselves are."""
    return (kind == "bytes") | data.isNotNull()


def data_uri_image(text: Column) -> Column:
    """The bytes of a base64 image URI; null if it is none."""
    return F.when(text.startswith("data:image/"), F.try_to_binary(F.substring_index(text, ",", -1), F.lit("base64")))


def extracted(text: Column) -> Column:
    """struct<extracted_text, status, error>: an empty or missing text is the caller's error."""
    there = F.coalesce(text, F.lit("")) != ""
    return F.struct(F.when(there, text).alias("extracted_text"), F.when(there, 200).otherwise(400).alias("status"), F.when(~there, "Failed to extract text").alias("error"))


def timing_headers(started: Column, ended: Column) -> Column:
    """The headers of an answer: milliseconds between two times, and an id of its own for each request."""
    spent = (F.unix_micros(ended) - F.unix_micros(started)) / 1000
    return F.create_map(F.lit("X-Process-Time-Ms"), spent.cast("string"), F.lit("X-Request-ID"), F.uuid())
