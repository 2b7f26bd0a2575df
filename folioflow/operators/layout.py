"""Reading order: tokens to lines to text. One shuffle by document, all state in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ARABIC, ARABIC_RANGE, repair_arabic

#: Line threshold: a share of the upper median height, at least so many pixels; a single token has its own.
HEIGHT_SHARE, LEAST_GAP, SINGLE_GAP, RTL_SHARE = 0.7, 10.0, 50.0, 0.3


def centre(points: Column) -> Column:
    """struct<cx, cy, height> of a polygon, an array of struct<x,y>: the mean of its points and its extent in y."""
    mean = lambda axis: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[axis].cast("double")) / F.size(points)
    ys = F.transform(points, lambda p: p["y"].cast("double"))
    return F.struct(mean("x").alias("cx"), mean("y").alias("cy"), (F.array_max(ys) - F.array_min(ys)).alias("height"))


def upper_median(values: Column) -> Column:
    """The element behind the middle of the sorted array (no interpolation)."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def lines(tokens: DataFrame, doc: str = "doc_id", min_confidence: float = 0.5) -> DataFrame:
    """tokens (doc, ord, text, confidence, cx, cy, height) -> doc, line (from 0), place (from 0), ord, text.

    Tokens below min_confidence go. By centre height (ties by ord) a token starts a line if it is further from
    the mean of the current line than the threshold; a line's tokens are in order of x.
    """
    kept = tokens.where(F.col("confidence") >= min_confidence)
    packed = kept.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("cy", "ord", "cx", "height", "text"))).alias("tokens"))
    median = upper_median(F.transform("tokens", lambda t: t["height"]))
    gap = F.when(F.size("tokens") > 1, F.greatest(median * HEIGHT_SHARE, F.lit(LEAST_GAP))).otherwise(SINGLE_GAP)
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.lit(-1).alias("line"), F.array().cast("array<int>").alias("of"))

    def step(state: Column, token: Column) -> Column:
        fresh = (state["n"] == 0) | (F.abs(token["cy"] - state["total"] / F.greatest(state["n"], F.lit(1))) > F.col("gap"))
        line = F.when(fresh, state["line"] + 1).otherwise(state["line"])
        return F.struct(
            F.when(fresh, token["cy"]).otherwise(state["total"] + token["cy"]).alias("total"),
            F.when(fresh, 1).otherwise(state["n"] + 1).alias("n"),
            line.alias("line"),
            F.concat(state["of"], F.array(line)).alias("of"),
        )

    numbered = packed.withColumn("gap", gap).withColumn("of", F.aggregate("tokens", start, step, lambda s: s["of"]))
    joined = F.array_sort(F.zip_with("of", "tokens", lambda n, t: F.struct(n.alias("line"), t["cx"].alias("cx"), t["cy"].alias("cy"), t["ord"].alias("ord"), t["text"].alias("text"))))
    rows = numbered.select(doc, F.posexplode(joined).alias("at", "t"))
    base = rows.select(doc, "at", "t.line", "t.ord", "t.text")
    heads = F.min("at").over(Window.partitionBy(doc, "line"))
    return base.select(doc, "line", (F.col("at") - heads).cast("long").alias("place"), "ord", "text")


def text(tokens: DataFrame, doc: str = "doc_id", primary: str = "en", min_confidence: float = 0.5) -> DataFrame:
    """doc, text: lines joined by a line end. A line runs right to left if over 30 % of its characters are Arabic or the primary language is."""
    placed = lines(tokens, doc, min_confidence)
    words = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda t: t["text"])
    arabic = F.sum(F.regexp_count(F.col("text"), F.lit(ARABIC_RANGE)))
    per_line = placed.groupBy(doc, "line").agg(words.alias("words"), arabic.alias("arabic"), F.sum(F.char_length("text")).alias("chars"))
    leftward = F.lit(primary == ARABIC) | F.coalesce(F.try_divide(F.col("arabic"), F.col("chars")) > RTL_SHARE, F.lit(False))
    rendered = F.when(leftward, F.array_join(F.transform(F.reverse("words"), repair_arabic), " ")).otherwise(F.array_join("words", " "))
    shown = per_line.select(doc, "line", rendered.alias("shown"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line", "shown"))), lambda s: s["shown"])
    return shown.groupBy(doc).agg(F.array_join(parts, "\n").alias("text"))


def by_top(tokens: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, ord, place, text: tokens by the top of their box, ties in their own order."""
    place = F.row_number().over(Window.partitionBy(doc).orderBy("y1", "ord"))
    return tokens.select(doc, "ord", place.cast("long").alias("place"), "text")
