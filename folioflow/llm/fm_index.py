"""Substring dedup on words, by a compressed FM-index per shard.

A shard's segments are indexed as a Burrows-Wheeler transform in a wavelet matrix. Documents'
segments are streamed against it: backward search from a window's end gives the statistics of
the match; where the match stops occurring twice, all windows over that stretch are ruled out
at once and the search goes on behind it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_and_text, text_bytes
from .suffixes import WaveletMatrix, suffix_order
from .windows import Cut, repeated_windows

WINDOW_WORDS = 35


class FmIndex:
    """Backward search over an integer text whose symbols are below 2**bits."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        self.n = len(text)
        bits = max(1, int(text.max()).bit_length())
        order, _ = suffix_order(text, depth, packed=2, bits=bits)
        self.wavelet = WaveletMatrix(text[order - 1], bits)
        symbols = np.arange(1 << bits)
        before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << bits))])[:-1]
        self.shift = before - self.wavelet.descend(symbols, np.zeros(len(symbols), np.int64))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of suffixes that begin with the symbol and go on as those in [low, high)."""
        both = self.wavelet.descend(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        shift = self.shift[symbol]
        return both[: len(low)] + shift, both[len(low) :] + shift


def first_repeated(text: np.ndarray, begin: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """For stretches of text (begin, number of windows): the first window that occurs twice or more in the text, or -1."""
    index = FmIndex(text, length + 1)
    out = np.full(len(begin), -1, np.int64)
    lane = np.arange(len(begin))
    start, last = begin.copy(), begin + windows - 1
    at = start + length - 1
    low, high = np.zeros(len(begin), np.int64), np.full(len(begin), index.n, np.int64)
    while len(lane):
        low, high = index.extend(text[at], low, high)
        stopped = high - low < 2
        done = ~stopped & (at == start)
        out[lane[done]] = start[done] - begin[lane[done]]
        start = np.where(stopped, at + 1, start)  # every window over [at, end) holds a stretch that occurs once
        at = np.where(stopped, start + length - 1, at - 1)
        low, high = np.where(stopped, 0, low), np.where(stopped, index.n, high)
        stay = ~done & (start <= last)
        lane, start, last, at, low, high = (x[stay] for x in (lane, start, last, at, low, high))
    return out


def matched(contents: list[bytes], repeated: np.ndarray, cut: Cut) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's solver. Segments have fewer windows than a window has words, so the first and the last repeated window span the rest."""
    ids: dict[bytes, int] = defaultdict(count(1).__next__)
    parts = [np.fromiter(map(ids.__getitem__, c.split()), np.int64) for c in contents]
    lengths = np.array([len(p) for p in parts])
    text = np.concatenate([x for p in parts for x in (p, np.zeros(1, np.int64))])
    begin = np.cumsum(lengths + 1) - lengths - 1
    ask = np.flatnonzero(~repeated)
    windows = lengths[ask] - cut.length + 1
    first = first_repeated(text, begin[ask], windows, cut.length)
    hit = first >= 0
    ask, windows, first = ask[hit], windows[hit], first[hit]
    if not len(ask):
        return ask, first, windows
    mirrored = len(text) - 1 - (begin[ask] + lengths[ask] - 1)
    last = windows - 1 - first_repeated(text[::-1].copy(), mirrored, windows, cut.length)
    return ask, first, last - first + 1


def covered(n: int, spans: list[dict] | None, length: int) -> np.ndarray:
    """Which of n units lie in a window of a span."""
    marks = np.zeros(n + 1, np.int64)
    if spans:
        first = np.array([s["first"] for s in spans])
        stop = first + np.array([s["windows"] for s in spans]) + length - 1
        np.add.at(marks, first, 1)
        np.add.at(marks, stop, -1)
    return np.cumsum(marks[:-1]) > 0


def substring_dedup(docs: DataFrame, window_words: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_text (the words that stay, one space apart).

    A word goes if a window of window_words words over it also starts anywhere else. A null text has no
    word; a text shorter than a window loses nothing; rows that repeat a document repeat its windows.
    A null id is an id like any other. Empty input gives no rows.
    """
    base = id_and_text(docs, id_col, text_col)
    grams = tuple(max(1, window_words * k // 35) for k in (8, 23, 31, 35))
    spans = repeated_windows(base, Cut(window_words, grams, True), matched)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, own in zip(text_bytes(batch.column(1)), batch.column(2), strict=True):
                words = text.split()
                n_words.append(len(words))
                own = own.as_py()
                if own:
                    gone = covered(len(words), own, window_words)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    named = base.withColumn("row_version", F.xxhash64("text"))
    same = named["doc_id"].eqNullSafe(spans["doc"]) & (named["row_version"] == spans["version"])
    joined = named.join(spans, same, "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_text string")
