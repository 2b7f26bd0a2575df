"""Line dedup with DataFrame functions only.

The lines of each document are hashed once and written as a slim table. Hashes are range-partitioned with
document and position behind them, so that a line that stands in a third of all documents is spread over many
partitions, and sorted by document and position inside them. A window over that order streams the first
occurrence of each line in each document; those are counted per line. What comes back per document is a keep
bitmap, compressed to its runs of ones; text is never grouped or moved by line.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BLANKS, stored

#: The most frequent keys are joined by broadcast. Every other key then has at most 1/4096 of all rows.
HOT_KEYS = 4096


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, with A-Z (and only A-Z) lower-cased."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("doc"), text.alias("text"), F.xxhash64(text).alias("version"))


def dropped_runs(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document with a dropped line: doc, version (hash of its text) and gaps, the sorted runs (start, stop) of its dropped lines.

    A document is a pair of id and text: a repeated row counts once, and rows that share an id
    but not a text are different documents. A null id is an id like any other. Empty input gives no rows.
    """
    lines = (
        _numbered(docs, id_col, text_col)
        .select("doc", "version", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("doc", "version", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "version", "pos")
    )
    # distinct: the copies of a repeated row fall together before anything is ranged, so that no range holds them all
    lines = stored(lines.distinct(), "lines")
    ranged = lines.repartitionByRange("h1", "h2", "doc", "version", "pos")
    in_document = Window.partitionBy("h1", "h2", "doc", "version").orderBy("pos")
    first = ranged.withColumn("nth", F.row_number().over(in_document)).where("nth = 1")
    frequent = first.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs)
    frequent = stored(frequent, "frequent-lines")
    hot = frequent.orderBy(F.desc("n_docs"), "h1", "h2").limit(HOT_KEYS).select("h1", "h2")
    marked = lines.join(F.broadcast(hot.withColumn("hot", F.lit(True))), ["h1", "h2"], "left")
    by_broadcast = marked.where("hot").select("doc", "version", "pos")
    by_shuffle = marked.where("hot is null").join(frequent.select("h1", "h2"), ["h1", "h2"], "left_semi").select("doc", "version", "pos")
    # neighbouring positions differ from their rank by the same number: a run
    rank = F.row_number().over(Window.partitionBy("doc", "version").orderBy("pos"))
    runs = by_broadcast.unionByName(by_shuffle).withColumn("run", F.col("pos") - rank)
    runs = runs.groupBy("doc", "version", "run").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"))
    return runs.groupBy("doc", "version").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("gaps"))


def _kept_runs(gaps: Column, n_lines: Column) -> Column:
    """The runs (start, stop) of ones of a keep bitmap, from those of its zeros."""
    starts = F.concat(F.array(F.lit(0)), F.transform(gaps, lambda g: g["stop"]))
    stops = F.concat(F.transform(gaps, lambda g: g["start"]), F.array(n_lines))
    runs = F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), b.alias("stop")))
    return F.filter(runs, lambda r: r["stop"] > r["start"])


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: source (all columns of docs), text (null: empty), lines, n_lines, n_dropped and keep: the runs (start, stop) of ones of its keep bitmap."""
    gaps = dropped_runs(docs, min_docs, min_chars, id_col, text_col)
    rows = docs.select(F.struct("*").alias("source"), F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    joined = rows.join(gaps, F.col("id").eqNullSafe(F.col("doc")) & (F.col("hash") == F.col("version")), "left")
    # lines is used twice in the next step, so the split is not moved into the function over runs
    split = joined.withColumn("lines", F.split("text", "\n", -1))
    counted = split.select("source", "text", "lines", F.size("lines").alias("n"), F.coalesce("gaps", F.array().cast("array<struct<start:int,stop:int>>")).alias("gaps"))
    n_dropped = F.aggregate("gaps", F.lit(0), lambda n, g: n + g["stop"] - g["start"])
    return counted.select("source", "text", "lines", F.col("n").cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"), _kept_runs(F.col("gaps"), F.col("n")).alias("keep"))


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs but the text, and: n_lines, n_dropped, kept_text, keep (the runs of the keep bitmap).

    A text splits at \\n; null or empty is one empty line. Lines whose key (line_key) has at least
    min_chars code points and stands in at least min_docs documents go, wherever they stand; the rest
    is joined by \\n. If every line goes, kept_text is empty. Columns of docs that clash with the new
    ones, in whatever case, are replaced; other names of docs cannot clash. Repeated rows stay, each with
    its own result. Empty input gives no rows.
    """
    new = ("n_lines", "n_dropped", "kept_text", "keep")
    others = [c for c in docs.columns if c.lower() not in (text_col.lower(), *new)]
    bitmaps = keep_bitmaps(docs, min_docs, min_chars, id_col, text_col)
    slices = F.flatten(F.transform("keep", lambda r: F.slice("lines", r["start"] + 1, r["stop"] - r["start"])))
    kept = F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.array_join(slices, "\n"))
    done = bitmaps.select("source", "n_lines", "n_dropped", kept.alias("kept_text"), "keep")
    return done.select(*[F.col("source").getField(c).alias(c) for c in others], "n_lines", "n_dropped", "kept_text", "keep")
