"""SimHash near-dedup by meet-in-the-middle ball hashing.

Fingerprints at r or fewer differing bits have a common variant within r/2 (rounded up) of both. Every
distinct fingerprint therefore emits all variants within half the radius (1 + 64 + 2016 for
r = 4), variants meet in a shuffle, and colliding pairs are verified by their distance.

The shuffle is by a linear code: the bucket of a value is the syndrome H*v over GF(2). The
variants of a fingerprint that fall into a bucket follow from the fingerprint alone (the flips
whose own syndrome makes up the difference), so a fingerprint is sent once to each bucket that
gets any of its variants and the bucket's task makes those variants there. Nothing is left out:
over all buckets every variant is made exactly once. Within a bucket, one more level of syndrome
bits splits the work into passes, which bounds memory.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .shared import dropped, id_and_text, stored, text_bytes

SEED = 42
#: Fingerprints that a bucket's task may get before the number of buckets grows, and the least number of buckets.
BUCKET_ROWS, MIN_BUCKETS = 1 << 22, 64
#: Variants that one pass of a bucket's task holds.
PASS_VARIANTS = 1 << 22


def fingerprint(text: bytes, shingle_words: int = 4) -> int:
    """A bit is 1 if more than half of the shingles' hashes (repeats count) have it; no word gives 0."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    n = len(words) - shingle_words + 1
    digest = xxhash.xxh64_intdigest
    starts = (ends - lengths)[:n].tolist()
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle_words - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        block = np.array(hashes[at : at + 4096], dtype="<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<u8")[0])


_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row; a null text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle_words) for t in text_bytes(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    base = id_and_text(docs, id_col, text_col)
    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, fp long")


@functools.cache
def _flips(radius: int) -> np.ndarray:
    """All masks of at most radius bits."""
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(64), k)]
    return np.array(masks, dtype=np.uint64)


@functools.cache
def _code(bits: int) -> np.ndarray:
    """A fixed parity-check matrix: for each of the 64 bit positions its column of that many bits."""
    rng = np.random.default_rng(20240607)
    columns = rng.integers(1, 1 << 62, size=64, dtype=np.uint64)
    return columns & np.uint64((1 << bits) - 1)


def _syndromes(values: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(len(values), np.uint64)
    for position, column in enumerate(_code(bits)):
        out ^= np.where((values >> np.uint64(position)) & np.uint64(1), column, np.uint64(0))
    return out


@functools.cache
def _flips_by_syndrome(radius: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The masks sorted by their syndrome, and where each syndrome's masks begin."""
    masks = _flips(radius)
    found = _syndromes(masks, bits)
    order = np.argsort(found, kind="stable")
    return masks[order], np.searchsorted(found[order], np.arange((1 << bits) + 1, dtype=np.uint64))


def _spread(values: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a permutation of the 64-bit values."""
    x = values.copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _bucket_bits(n: int, radius: int) -> int:
    """Bits of a bucket's number, so that no bucket gets more than BUCKET_ROWS of n fingerprints, whatever their ball reaches.

    With few buckets every one gets every fingerprint; the share falls to the ball's size over the number of buckets.
    """
    bits = int(np.log2(MIN_BUCKETS))
    while n * _reached(radius, bits) > BUCKET_ROWS << bits:
        bits += 1
    return bits


@functools.cache
def _reached(radius: int, bits: int) -> int:
    """How many buckets get a fingerprint: the different syndromes of the flips."""
    return len(np.unique(_syndromes(_flips((radius + 1) // 2), bits)))


def _links_in_bucket(fps: np.ndarray, bucket: int, bits: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified links among distinct fingerprints that share a variant in this bucket; they connect all that do."""
    half = (radius + 1) // 2
    total = len(fps) * max(1, len(_flips(half)) >> bits)
    extra = max(0, int(np.ceil(np.log2(max(1, total / PASS_VARIANTS)))))
    masks, begin = _flips_by_syndrome(half, bits + extra)
    own = _syndromes(fps, bits + extra)
    order = np.argsort(own, kind="stable")
    fps, own = fps[order], own[order]
    kinds, first = np.unique(own, return_index=True)
    last = np.append(first[1:], len(fps))
    index_bits = max(1, int(len(fps)).bit_length())
    index_mask = np.uint64((1 << index_bits) - 1)
    for rest in range(1 << extra):
        target = np.uint64(bucket | rest << bits)
        keys = []
        for kind, a, b in zip(kinds, first, last, strict=True):
            need = int(kind ^ target)
            flips = masks[begin[need] : begin[need + 1]]
            if len(flips):
                variants = _spread((fps[a:b, None] ^ flips[None, :]).ravel())
                who = np.repeat(np.arange(a, b, dtype=np.uint64), len(flips))
                keys.append((variants & ~index_mask) | who)
        if not keys:
            continue
        keys = np.sort(np.concatenate(keys))
        variant, who = keys & ~index_mask, (keys & index_mask).astype(np.int64)
        same = variant[1:] == variant[:-1]
        if not same.any():
            continue
        left, right = fps[who[:-1][same]], fps[who[1:][same]]
        near = np.bitwise_count(left ^ right) <= radius
        yield left[near], right[near]
        if not near.all():  # a truncated variant met another one, or the radius is odd: such groups are taken apart by the full variant
            starts = np.flatnonzero(np.append(True, ~same))
            stops = np.append(starts[1:], len(keys))
            for g in np.unique(np.searchsorted(starts, np.flatnonzero(same)[~near], side="right") - 1):
                at = who[starts[g] : stops[g]]
                need = (own[at] ^ target).astype(np.int64)
                ball = [fps[i] ^ masks[begin[k] : begin[k + 1]] for i, k in zip(at.tolist(), need.tolist(), strict=True)]
                members, full = np.repeat(fps[at], [len(x) for x in ball]), np.concatenate(ball)
                met = (_spread(full) & ~index_mask) == variant[starts[g]]
                yield _links_by_variant(members[met], full[met], radius)


def _links_by_variant(members: np.ndarray, variants: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among members by the variants that they have in common.

    A member within half the radius, rounded down, of a variant is within the radius of every other that has it. Two members
    that are both further from it are linked by another variant, between them, if they are near.
    """
    distance = np.bitwise_count(members ^ variants)
    order = np.lexsort((members, distance, variants))
    members, variants, distance = members[order], variants[order], distance[order]
    head = np.flatnonzero(np.append(True, variants[1:] != variants[:-1]))
    nearest = np.repeat(head, np.diff(np.append(head, len(members))))
    good = (distance[nearest] <= radius // 2) & (nearest != np.arange(len(members)))
    return members[nearest[good]], members[good]


def _forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same connections with one link per fingerprint: each to the smallest of its local component."""
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = at[: len(left)], at[len(left) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while (jump := new[new]).tobytes() != new.tobytes():
            new = jump
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[label[moved]], nodes[moved]


def fingerprint_links(fps: DataFrame, n: int, radius: int = 4) -> DataFrame:
    """Rows (a, b): links at radius or fewer differing bits that connect the same components as all such pairs do.

    fps: distinct values in column fp; n: how many there are, which sets the number of buckets only.
    """
    bits = _bucket_bits(n, radius)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, begin = _flips_by_syndrome((radius + 1) // 2, bits)
        used = np.flatnonzero(begin[1:] > begin[:-1]).astype(np.uint64)
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(values):
                continue
            own = _syndromes(values, bits)
            if len(used) == 1 << bits:  # every bucket gets every fingerprint
                blob = pa.scalar(values.astype("<u8").tobytes(), pa.binary())
                for at in range(0, len(used), 64):
                    some = used[at : at + 64]
                    yield pa.RecordBatch.from_arrays([pa.array(some.view(np.int64)), pa.array([blob.as_py()] * len(some), pa.binary())], names=["bucket", "blob"])
                continue
            for at in range(0, len(values), 256):
                some, syn = values[at : at + 256], own[at : at + 256]
                bucket = (syn[:, None] ^ used[None, :]).ravel()
                order = np.argsort(bucket, kind="stable")
                sent = np.repeat(some, len(used))[order].astype("<u8")
                names, first = np.unique(bucket[order], return_index=True)
                cuts = np.append(first, len(order))
                blobs = [sent[cuts[i] : cuts[i + 1]].tobytes() for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[bytes]] = {}
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got.setdefault(bucket, []).append(blob)
        for bucket in list(got):
            values = np.unique(np.frombuffer(b"".join(got.pop(bucket)), dtype="<u8"))
            links = list(_links_in_bucket(values, bucket, bits, radius))
            if links:
                a, b = _forest(np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links]))
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    sent = fps.mapInArrow(send, "bucket long, blob binary").withColumn("partition", F.col("bucket").cast("int"))
    return sent.repartitionById(1 << bits, "partition").mapInArrow(meet, "a long, b long").distinct()


def simhash_components(docs: DataFrame, radius: int = 4, shingle_words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links of at most radius bits).

    Documents without a word have fingerprint zero and link like any other. Rows with one id or one
    text stay separate rows; a null doc_id keeps its row but never names a component unless all ids of
    the component are null. Empty input gives no rows.
    """
    rows = stored(with_fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    links = stored(fingerprint_links(distinct.select("fp"), distinct.count(), radius), "fingerprint-links")
    roots = connected_components(links, "a", "b")  # node, root
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(named.join(smallest, "root").select("fp", "component_id"), "fingerprint-components")
    out = rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    dropped(links)
    return out
