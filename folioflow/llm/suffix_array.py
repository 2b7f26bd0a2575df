"""Suffix-array dedup on bytes: threshold-bounded interval expansion on a Burrows-Wheeler transform.

Common-prefix lengths of neighbouring suffixes are derived in increasing order: the intervals of all
strings of one length are extended backwards by every byte, breadth first, and a boundary that is first
reached at some length has that common prefix. The expansion stops at the minimum length; boundaries
not reached by then have a common prefix of at least that, and the suffixes at them start a repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import covered
from .shared import id_and_text, text_bytes
from .suffixes import WaveletMatrix, suffix_order
from .windows import Cut, repeated_windows

MIN_BYTES = 200
SEPARATOR, END = 0xFF, 0xFE  # never part of UTF-8


def long_common_prefixes(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order (to a depth of least), and whether each suffix has a common prefix of at least that with the one before it."""
    n = len(text)
    order, place = suffix_order(text, least, packed=8, bits=8)
    before = text[order - 1]
    wavelet = WaveletMatrix(before.astype(np.int64), 8)
    smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=256))])[:-1]
    shift = smaller - wavelet.descend(np.arange(256), np.zeros(256, np.int64))
    previous = place[order - 1]  # where the suffix one byte longer stands
    reached = np.zeros(n + 1, bool)
    reached[0] = reached[n] = True
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)  # ranges [low, high) of several suffixes
    alone = np.zeros(0, np.int64)  # ranges of one suffix
    for _ in range(least):
        symbol, a, b = wavelet.symbols_in(low, high)
        a, b = a + shift[symbol], b + shift[symbol]
        alone = previous[alone]
        fresh, fresh_alone = ~reached[b], ~reached[alone + 1]
        a, b, alone = a[fresh], b[fresh], alone[fresh_alone]
        reached[b] = True
        reached[alone + 1] = True
        one = b - a == 1
        low, high, alone = a[~one], b[~one], np.concatenate([alone, a[one]])
        if not len(low) and not len(alone):
            break
    return order, ~reached[:n]


def repeats(contents: list[bytes], repeated: np.ndarray, cut: Cut) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's solver. Segments have fewer windows than a window has bytes, so the first and the last repeated window span the rest."""
    lengths = np.array([len(c) for c in contents])
    text = np.frombuffer(bytes([SEPARATOR]).join(contents) + bytes([END]), np.uint8)
    order, joined = long_common_prefixes(text, cut.length)
    starts = joined | np.append(joined[1:], False)
    flagged = np.zeros(len(text), bool)
    flagged[order[starts]] = True
    begin = np.cumsum(lengths + 1) - lengths - 1
    owner = np.repeat(np.arange(len(contents)), lengths + 1)
    at = np.flatnonzero(flagged)
    own = owner[at]
    inside = (at - begin[own] + cut.length <= lengths[own]) & ~repeated[own]
    at, own = at[inside], own[inside]
    if not len(at):
        return own, at, at
    head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    tail = np.append(head[1:], len(own)) - 1
    which = own[head]
    first = at[head] - begin[which]
    return which, first, at[tail] - at[head] + 1


def suffix_array_dedup(docs: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay).

    A byte goes if a string of min_bytes bytes over it also starts anywhere else; matches never cross
    documents, overlapping ones count. A null text is empty; a text shorter than min_bytes loses nothing;
    rows that repeat a document repeat its strings. A cut may fall inside a character, so kept is binary.
    """
    base = id_and_text(docs, id_col, text_col)
    grams = tuple(max(1, min_bytes * k // 200) for k in (33, 150, 185, 200))
    spans = repeated_windows(base, Cut(min_bytes, grams, False), repeats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, own in zip(text_bytes(batch.column(1)), batch.column(2), strict=True):
                own = own.as_py()
                if not own:
                    rows.append((len(text), 0, 0, text))
                    continue
                gone = covered(len(text), own, min_bytes)
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                rows.append((len(text), len(text) - len(kept), runs, kept))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            arrays = [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    named = base.withColumn("row_version", F.xxhash64("text"))
    same = named["doc_id"].eqNullSafe(spans["doc"]) & (named["row_version"] == spans["version"])
    joined = named.join(spans, same, "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")
