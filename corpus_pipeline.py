"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, benchmark decontamination, BPE.

Each stage works on everything its predecessor kept and takes (spark, docs, sf_dir). All but the last return the
columns that docs has, in their order: those of documents (doc_id, text, lang, source, n_chars), without what is
missing there and with whatever else there is, under any name. n_chars follows the text. Null texts are empty, a null
doc_id is an id like any other, an empty table gives an empty one; repeated rows are judged alike, and of those that
are the same in id and text near-dedup keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from folioflow.llm.queries import tokenizer_path
from folioflow.llm.shared import stored

#: SQL cannot express the toxicity, near-dedup and decontamination stages.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted label is toxic go."""
    return toxicity.without_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in ten or more documents go; a document that has no other line is empty and stays."""
    whole = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    kept = line_dedup.line_dedup(whole)
    now = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return kept.select(*[now.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays (of texts under one id the one with the least
    hash); a repeated row of it stays once. Rows of one id, or without one, on different texts are documents of their own."""
    version = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), version.alias("version"), "text")
    keyed = rows.select(F.struct(F.col("id").isNull().alias("nameless"), F.col("id").alias("doc_id"), "version").alias("key"), "text")
    components = simhash.simhash_components(keyed, id_col="key")  # a component's id is its least key
    first = components.where("doc_id <=> component_id").select(F.col("doc_id.doc_id").alias("first"), F.col("doc_id.version").alias("first_version"))
    first = stored(first.distinct(), "representatives")
    kept = rows.drop("text").join(first, F.col("id").eqNullSafe(F.col("first")) & (F.col("version") == F.col("first_version")), "left_semi")
    return kept.dropDuplicates(["id", "version"]).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document that is left."""
    return bpe.bpe_digests(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash", drop_near_copies),
    ("decontamination", drop_leaks),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
