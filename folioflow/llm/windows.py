"""Windows of L consecutive units (words or bytes) that start more than once in a corpus.

Both exact-substring operators need, for every window, whether its content starts anywhere
else. An index over the whole corpus does not fit one task, so windows are dealt to shards by
content: the key of a window is the least hash of the grams inside it, which equal windows have
in common. Neighbouring windows with the same least gram (the same place, not only the same hash)
form a segment, sent as one text; no window is in two segments, and equal windows never share one.

1. Every segment gives (key, content hash, where it is). Keys that occur once are dropped.
2. Equal segments are counted before anything is moved: a segment found twice has repeated windows only.
3. What is left, different segments with a common key, is fetched as text and given to the shards'
   index (`solve`), which finds the windows that occur in more than one of them.
4. A key with very many different segments is split by longer grams (the last level's gram is the
   window itself, whose key has one content), so no shard holds an unbounded group.
5. Results go back to the places of each segment and to the documents.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BLANK_BYTES, dropped, groups_by_size, shuffle_partitions, stored, text_bytes

#: Bytes that are cut into windows at a time, and bytes of segments in one shard's index.
CHUNK_BYTES, SHARD_BYTES = 1 << 20, 2 << 20
#: Different segments of one key beyond which the key is split.
HOT_SEGMENTS = 256
_MULTIPLIER = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Cut:
    """How texts are cut: window length, gram length at each level (the last is the window), and whether units are words."""

    length: int
    grams: tuple[int, ...]
    words: bool


@functools.cache
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hashes' multiplier and of its inverse, for texts of less than 2**bits bytes."""
    n = (1 << bits) + 1
    inverse = pow(_MULTIPLIER, -1, 1 << 64)
    up, down = np.full(n, _MULTIPLIER, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@functools.cache
def byte_values() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width neighbouring values."""
    step = 1
    while step * 2 <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    if step < width:
        rest = width - step
        values = np.minimum(values[:-rest], values[rest:])
    return values


def units(text: bytes, cut: Cut) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The text that windows are cut from, and where each unit begins and ends in it. Words are one space apart."""
    if cut.words:
        text = b" ".join(text.split())
        if not text:
            return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
        gaps = np.flatnonzero(BLANK_BYTES[np.frombuffer(text, np.uint8)])
        return text, np.concatenate([[0], gaps + 1]), np.append(gaps, len(text))
    at = np.arange(len(text) + 1)
    return text, at[:-1], at[1:]


def segments(texts: list[bytes], cut: Cut, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Of each segment: the text's number, its first window, the number of windows, its key, its content."""
    length, gram = cut.length, cut.grams[level]
    limit = length - gram + 1  # windows that one gram can be in
    parts = [units(t, cut) for t in texts]
    counts = np.array([len(p[1]) for p in parts], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])]).astype(np.int64)
    whole = b"".join(p[0] for p in parts)
    n = int(counts.sum())
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), []
    if n < length:
        return nothing
    start = np.concatenate([p[1] + o for p, o in zip(parts, offsets, strict=False)])
    stop = np.concatenate([p[2] + o for p, o in zip(parts, offsets, strict=False)])
    text_of = np.repeat(np.arange(len(texts)), counts)
    up, down = powers(max(16, int(len(whole)).bit_length()))
    sums = np.zeros(len(whole) + 1, np.uint64)
    np.cumsum(byte_values()[np.frombuffer(whole, np.uint8)] * up[: len(whole)], out=sums[1:])
    hashes = mixed((sums[stop[gram - 1 :]] - sums[start[: n - gram + 1]]) * down[start[: n - gram + 1]])
    least = _least(hashes, limit)  # of each window the least hash of its grams, all bits of it
    valid = text_of[: n - length + 1] == text_of[length - 1 :]
    if not valid.any():
        return nothing
    begins = valid.copy()
    # the leftmost place of the least hash changes where a window has another least hash, and where the window before began with it
    begins[1:] &= (least[1:] != least[:-1]) | (hashes[: len(least) - 1] == least[:-1]) | ~valid[:-1]
    at = np.flatnonzero(begins)
    windows = np.bincount((np.cumsum(begins) - 1)[valid], minlength=len(at))
    content = [whole[a:b] for a, b in zip(start[at].tolist(), stop[at + windows + length - 2].tolist(), strict=True)]
    base = np.cumsum(counts) - counts
    return text_of[at], at - base[text_of[at]], windows, mixed(least[at] ^ np.uint64(level)), content


def _hashes(contents: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(c) for c in contents], dtype=np.uint64).view(np.int64)


#: solve(contents, repeated, cut) -> (number, first window, windows) of each content with a window found more than once.
Solver = Callable[[list[bytes], np.ndarray, Cut], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _solved(occurring: DataFrame, cut: Cut, solve: Solver, partitions: int) -> DataFrame:
    """occurring: key, chash, n, content of different segments with common keys -> key, chash, skip, windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, hashes, counts, contents = [], [], [], []
        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            hashes.append(batch.column(1).to_numpy())
            counts.append(batch.column(2).to_numpy())
            contents.extend(batch.column(3).to_pylist())
        if not contents:
            return
        key, chash, n = np.concatenate(keys), np.concatenate(hashes), np.concatenate(counts)
        order = np.lexsort((chash, key))
        fresh = np.append(True, (key[order][1:] != key[order][:-1]) | (chash[order][1:] != chash[order][:-1]))
        order = order[fresh]  # what a repeated row sent from another task
        key, chash, n = key[order], chash[order], n[order]
        contents = [contents[i] for i in order.tolist()]
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist()
        tails = [*heads[1:], len(key)]
        sizes = [sum(map(len, contents[a:b])) for a, b in zip(heads, tails, strict=True)]
        for a, b in groups_by_size(sizes, SHARD_BYTES):  # a key's segments stay in one index
            lo, hi = heads[a], tails[b - 1]
            which, skip, windows = solve(contents[lo:hi], n[lo:hi] > 1, cut)
            if len(which):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[lo:hi][which]), pa.array(chash[lo:hi][which]), pa.array(skip.astype(np.int32)), pa.array(windows.astype(np.int32))],
                    names=["key", "chash", "skip", "windows"],
                )

    return occurring.select("key", "chash", "n", "content").repartition(partitions, "key").mapInArrow(run, "key long, chash long, skip int, windows int")


def _split(occurring: DataFrame, cut: Cut, level: int) -> DataFrame:
    """Segments of hot keys cut again by the grams of the next level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = batch.column(3).to_pylist()
            for a, b in groups_by_size([len(c) for c in contents], CHUNK_BYTES):
                row, skip, windows, key, content = segments(contents[a:b], cut, level)
                if not len(row):
                    continue
                take = pa.array(row + a)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).take(take) for i in (0, 1, 2)),
                        pa.array(skip.astype(np.int32)),
                        pa.array(windows.astype(np.int32)),
                        pa.array(key.view(np.int64)),
                        pa.array(_hashes(content)),
                        pa.array(content, pa.binary()),
                    ],
                    names=["up_key", "up_chash", "n", "up_skip", "windows", "key", "chash", "content"],
                )

    schema = "up_key long, up_chash long, n long, up_skip int, windows int, key long, chash long, content binary"
    return occurring.select("key", "chash", "n", "content").mapInArrow(run, schema)


def _needed(counted: DataFrame) -> DataFrame:
    """Keys with different segments, one of them found once: only they need an index. counted: key, n, ..."""
    keys = counted.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.sum((F.col("n") == 1).cast("long")).alias("single"))
    return keys.where("k >= 2 and single >= 1").select("key", "k")


def _resolve(occurring: DataFrame, cut: Cut, solve: Solver, level: int) -> list[DataFrame]:
    """Tables of (key, chash, skip, windows): windows found more than once in segments found once.

    occurring: a written table of key, chash, n, content, k (the number of different segments of the key).
    """
    spark = occurring.sparkSession
    total = occurring.agg(F.sum(F.length("content")), F.sum((F.col("k") > HOT_SEGMENTS).cast("long"))).first()
    partitions = max(shuffle_partitions(spark), int((total[0] or 0) // SHARD_BYTES) + 1)
    out = [stored(_solved(occurring.where(F.col("k") <= HOT_SEGMENTS), cut, solve, partitions), "found")]
    if total[1]:
        below = stored(_split(occurring.where(F.col("k") > HOT_SEGMENTS), cut, level + 1), "split")
        merged = below.groupBy("key", "chash").agg(F.sum("n").alias("n"), F.first("content").alias("content"))
        merged = stored(merged, "split-segments")
        twice = merged.where("n >= 2").select("key", "chash", F.lit(0).alias("skip"), F.lit(None).cast("int").alias("found"))
        if level + 2 < len(cut.grams):
            keys = stored(_needed(merged), "split-keys")
            once = [x.withColumnRenamed("windows", "found") for x in _resolve(stored(merged.join(keys, "key"), "split-index"), cut, solve, level + 1)]
            for x in once:
                twice = twice.unionByName(x)
        # a segment found twice is known to be repeated all over: only the others ask
        places = below.where("n = 1").select("up_key", "up_chash", "up_skip", "windows", "key", "chash").join(twice, ["key", "chash"])
        places = places.select(
            F.col("up_key").alias("key"), F.col("up_chash").alias("chash"), (F.col("up_skip") + F.col("skip")).alias("skip"), F.coalesce("found", "windows").alias("windows")
        )
        out.append(stored(places, "split-found"))
        dropped(below)
    return out


def repeated_windows(docs: DataFrame, cut: Cut, solve: Solver) -> DataFrame:
    """doc, version, spans: array of (first window, windows) runs; every unit of a repeated window is in a run's windows.

    docs: doc_id, text (not null). A row is a document: repeated rows repeat each other's windows.
    """
    spark = docs.sparkSession
    named = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("version"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(2))
            for a, b in groups_by_size([len(t) for t in texts], CHUNK_BYTES):
                row, first, windows, key, content = segments(texts[a:b], cut)
                if len(row):
                    take = pa.array(row + a)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(take), batch.column(1).take(take), pa.array(first.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(_hashes(content))],
                        names=["doc", "version", "first", "windows", "key", "chash"],
                    )

    places = stored(named.mapInArrow(scan, f"doc {id_type}, version long, first int, windows int, key long, chash long"), "segments")
    often = stored(places.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("key"), "keys")
    common = stored(places.join(often, "key"), "common-segments")
    dropped(places)
    dropped(often)
    counted = common.groupBy("key", "chash").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "version", "first", "windows")).alias("at"))
    counted = stored(counted.select("key", "chash", "n", "at.*"), "distinct-segments")
    keys = stored(_needed(counted), "index-keys")
    wanted = stored(counted.join(keys, "key"), "index-segments")
    by_doc = wanted.groupBy("doc", "version").agg(F.collect_list(F.struct("key", "chash", "n", "k", "first", "windows")).alias("asked"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            # a repeated row asks for the same segments again: the join has put its copies next to each other, and one is enough
            named = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
            fresh = [x != before for x, before in zip(named, [last, *named[:-1]], strict=True)]
            last = named[-1] if named else last
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            texts = text_bytes(batch.column(0))
            asked = batch.column(1)
            for a, b in groups_by_size([len(t) for t in texts], CHUNK_BYTES):
                flat = asked.slice(a, b - a)
                rows = np.repeat(np.arange(a, b), flat.value_lengths().to_numpy())
                flat = flat.flatten()
                field = lambda name, flat=flat: flat.field(name)
                content, known, where = [], -1, None
                for row, first, windows in zip(rows.tolist(), field("first").to_pylist(), field("windows").to_pylist(), strict=True):
                    if row != known:
                        known, where = row, units(texts[row], cut)
                    content.append(where[0][where[1][first] : where[2][first + windows + cut.length - 2]])
                yield pa.RecordBatch.from_arrays([field("key"), field("chash"), field("n"), field("k"), pa.array(content, pa.binary())], names=["key", "chash", "n", "k", "content"])

    same = named["doc"].eqNullSafe(by_doc["doc"]) & (named["version"] == by_doc["version"])
    asked = named.join(by_doc, same).select(named["text"], "asked", named["doc"], named["version"])
    fetched = asked.mapInArrow(fetch, "key long, chash long, n long, k long, content binary")
    index = stored(fetched, "index-contents")
    found = _resolve(index, cut, solve, 0)
    dropped(index)
    repeated = counted.where("n >= 2").select("key", "chash", F.lit(0).alias("skip"), F.lit(None).cast("int").alias("found"))
    for x in found:
        repeated = repeated.unionByName(x.withColumnRenamed("windows", "found"))
    spans = common.join(repeated, ["key", "chash"]).select("doc", "version", (F.col("first") + F.col("skip")).alias("first"), F.coalesce("found", "windows").alias("windows"))
    out = stored(spans.groupBy("doc", "version").agg(F.collect_list(F.struct("first", "windows")).alias("spans")), "spans")
    for table in (common, counted, keys, wanted, *found):
        dropped(table)
    return out
