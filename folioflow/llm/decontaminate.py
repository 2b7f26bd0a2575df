"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies over all documents weight words (TF-IDF). A document that holds most of an item does not count
   for that item's words, so an item that leaked into many documents does not turn its own words into frequent ones.
2. A distributed randomised SVD of TF-IDF passages gives a latent basis. It is fitted on the benchmark's
   passages and all passages of all documents: a pass over them counts which weighted words of items stand together,
   and the SVD's products are taken with those counts.
3. All passages of all documents are compared with the benchmark's by cosine; those whose words' vectors cannot add
   up to the cosine are not projected.
4. Candidates are checked in the text: the longest common subsequence with the item's passage (an item of up
   to 32 words is one), in a window of its length, and the presence of the words that carry it (the item's
   answer, where a column has one). Half of a long item is a leak as well, a phrase is not.
5. Words of very many documents have no weight. An item's passage that a leak may match without a word that has
   weight has no use for the latent space: every window of every document is compared with it by exact bounds and,
   where they allow it, by the subsequence.

Frequencies are counted once for all items. Only a benchmark of more than GROUP_BYTES of text is searched in several
groups of items, each with a basis of its own, so that what is broadcast stays bounded.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, groups_by_size, id_and_text, stored
from .windows import byte_values, mixed, powers

BLOCK_WORDS = 16  # a passage is two neighbouring blocks
BUCKETS = 1 << 16  # words that no item has share document frequencies
RANK, OVERSAMPLE = 384, 16
#: The weight of the corpus's passages in the basis next to the benchmark's, which they must not drown.
CORPUS_SHARE = 0.25
#: Bytes of items that share a basis, cosines held at a time.
GROUP_BYTES, BLOCK_COSINES = 1 << 20, 1 << 22
#: Passages whose pairs of words are made at a time, and different pairs that a task counts before it passes them on.
PAIRED_PASSAGES, PAIRS = 1024, 1 << 20
#: A document with so many of an item's different runs of three words holds it, as far as document frequencies go.
HELD_SHARE = 0.3
MIN_COSINE, MIN_LCS, MIN_ANSWER, ANSWER_WORDS = 0.35, 0.6, 0.6, 8
#: A passage's length in the latent space counts as at least this share of its full TF-IDF length, so that passages
#: made of words that no item has do not point anywhere by a chance word.
LATENT_SHARE = 0.6
#: Words in more than this share of documents carry nothing in the latent space.
COMMON = 0.03
#: A passage of fewer words that is searched without the latent space must stand in a document word by word: parts of
#: so few frequent words meet by chance.
WHOLE_BELOW = 8
#: Windows whose words are counted at a time.
CHUNK_WINDOWS = 4096
#: Bytes of text that are searched at a time.
CHUNK_BYTES = 1 << 18


#: A word is a run of letters, digits, underscores and bytes beyond ASCII of the lower-cased text in UTF-8.
_WORD = re.compile(rb"[0-9a-z_\x80-\xff]+")
_IN_WORD = np.array([chr(b).isalnum() and b < 128 or b == 95 or b >= 128 for b in range(256)])


def lowered(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def words_of(text: str | bytes) -> list[bytes]:
    return _WORD.findall(text if isinstance(text, bytes) else lowered(text))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of lower-cased texts laid end to end, and the number of words of each text."""
    whole = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(whole, np.uint8)
    inside = _IN_WORD[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.append(0, edge)
    start, stop = edge[::2], edge[1::2]
    up, down = powers(len(raw).bit_length())
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(byte_values()[raw] * up[: len(raw)], out=sums[1:])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return mixed((sums[stop] - sums[start]) * down[start]), np.diff(np.searchsorted(start, ends), prepend=0)


class _Ids:
    """Numbers of words: their place in the vocabulary, or a bucket behind it for words that no item has."""

    def __init__(self, vocabulary: list[bytes]) -> None:
        self.size = len(vocabulary)
        self.known = {w: i for i, w in enumerate(vocabulary)}
        self.hashes, _ = word_hashes(vocabulary) if vocabulary else (np.zeros(0, np.uint64), None)
        self.bits = max(16, (8 * self.size).bit_length())
        at, number = (self.hashes >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(self.size)
        self.chains = []  # tables of numbers by leading bits; words that meet in one go to the next
        while len(number):
            table = np.full(1 << self.bits, -1, np.int32)
            table[at] = number
            self.chains.append(table)
            left = table[at] != number
            at, number = at[left], number[left]

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = self.size + (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        for table in self.chains:
            number = table[at]
            same = self.hashes[number] == hashes  # a number of -1 takes the last word, which cannot be equal and elsewhere
            same &= number >= 0
            out[same] = number[same]
        return out


@dataclass
class Basis:
    """What a search needs: word weights and vectors, and the items' passages in the latent space."""

    vocabulary: list[bytes]
    items: list[tuple[int, list[bytes], list[bytes]]]  # id, words, answer words
    weights: np.ndarray
    rarity: np.ndarray  # the weights of the vocabulary before frequent words lose theirs: all positive
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    passages: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    parts: list[tuple[int, list[bytes]]] = field(default_factory=list)  # of each passage: its item's place in items, its words
    frequent: list[tuple[int, list[bytes]]] = field(default_factory=list)  # passages that are searched without the latent space


def blocks(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts of these lengths laid end to end: each word's block, and of each passage the first and last block and the text."""
    per_text = -(-lengths // BLOCK_WORDS)
    base = np.cumsum(per_text) - per_text
    text_of = np.repeat(np.arange(len(lengths)), lengths)
    begin = np.cumsum(lengths) - lengths
    block = base[text_of] + (np.arange(int(lengths.sum())) - begin[text_of]) // BLOCK_WORDS
    owner = np.repeat(np.arange(len(lengths)), per_text)
    first = np.arange(int(per_text.sum()))
    more = np.append(owner[1:] == owner[:-1], False) if len(owner) else np.zeros(0, bool)
    keep = more | (per_text[owner] == 1)
    return block, first[keep], (first + more)[keep], owner[keep]


def projected(
    ids: np.ndarray, lengths: np.ndarray, weights: np.ndarray, vectors: np.ndarray, reach: np.ndarray | None = None, least: float = 0.0
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each passage: its latent vector, its full TF-IDF norm, its text, its first block in the text.

    With reach (the vectors' lengths), only passages whose vector may be at least that share of the norm: the sum of its
    words' vectors is no longer than their lengths together.
    """
    block, first, last, owner = blocks(lengths)
    n = int(block[-1]) + 1 if len(block) else 0
    weight = weights[ids]
    energy = np.bincount(block, weights=weight**2, minlength=n)
    two = last > first
    norm = np.sqrt(energy[first] + np.where(two, energy[last], 0))
    known = np.flatnonzero(weight > 0)
    known = known[ids[known] < len(vectors)]
    own = block[known]
    per_text = -(-lengths // BLOCK_WORDS)
    place = first - (np.cumsum(per_text) - per_text)[owner]
    row, n_rows = np.arange(n), n
    if reach is not None:
        bound = np.bincount(own, weights=reach[ids[known]], minlength=n)
        bound = bound[first] + np.where(two, bound[last], 0)
        able = np.flatnonzero((bound > 0) & (1.001 * bound >= least * norm))
        first, last, two, norm, owner, place = (x[able] for x in (first, last, two, norm, owner, place))
        wanted = np.zeros(n, bool)
        wanted[first] = wanted[last] = True
        row, n_rows = np.cumsum(wanted) - 1, int(wanted.sum())
        known = known[wanted[own]]
        own = block[known]
    sums = np.zeros((n_rows, vectors.shape[1]), np.float32)
    if len(known):
        head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        sums[row[own[head]]] = np.add.reduceat(vectors[ids[known]], head, axis=0)
    return sums[row[first]] + np.where(two[:, None], sums[row[last]], np.float32(0)), norm, owner, place


class _Holding:
    """Which items a text holds, by their runs of three words, and so which words of it are not counted."""

    def __init__(self, items: list[np.ndarray], size: int) -> None:
        self.size = np.int64(size)
        self.words = [np.unique(x) for x in items]
        runs = [np.unique(self._codes(x)) for x in items]
        self.least = np.array([max(1, int(np.ceil(HELD_SHARE * len(r)))) for r in runs])
        codes = np.concatenate([*runs, np.zeros(0, np.int64)])
        order = np.argsort(codes, kind="stable")
        self.owner = np.repeat(np.arange(len(runs)), [len(r) for r in runs])[order]
        self.codes, self.first, self.times = np.unique(codes[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << 20, bool)  # places of codes, so that most others need no search
        self.seen[self._place(self.codes)] = True

    def _codes(self, numbers: np.ndarray) -> np.ndarray:
        return (numbers[:-2] * self.size + numbers[1:-1]) * self.size + numbers[2:]

    @staticmethod
    def _place(codes: np.ndarray) -> np.ndarray:
        return (mixed(codes.view(np.uint64)) >> np.uint64(44)).astype(np.int64)

    def __call__(self, numbers: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Rows (text, word) that are not to be counted."""
        known = numbers < self.size
        at = np.flatnonzero(known[:-2] & known[1:-1] & known[2:] & (text[:-2] == text[2:])) if len(numbers) > 2 else np.zeros(0, np.int64)
        code = (numbers[at] * self.size + numbers[at + 1]) * self.size + numbers[at + 2]
        hit = self.seen[self._place(code)]
        at, code = at[hit], code[hit]
        place = np.minimum(np.searchsorted(self.codes, code), max(0, len(self.codes) - 1))
        hit = self.codes[place] == code if len(code) else np.zeros(0, bool)
        pairs = np.unique(np.stack([text[at[hit]], place[hit]]), axis=1)  # a run counts once
        owners = np.repeat(self.first[pairs[1]], self.times[pairs[1]]) + _ranks(self.times[pairs[1]])
        found, n = np.unique(np.stack([np.repeat(pairs[0], self.times[pairs[1]]), self.owner[owners]]), axis=1, return_counts=True)
        held = found[:, n >= self.least[found[1]]]
        return np.concatenate([np.stack([np.full(len(self.words[i]), t), self.words[i]]) for t, i in held.T.tolist()] or [np.zeros((2, 0), np.int64)], axis=1)


def _ranks(times: np.ndarray) -> np.ndarray:
    """0, 1, ... of each run of so many."""
    return np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)


def _frequencies(docs: DataFrame, vocabulary: list[bytes], items: list[list[bytes]]) -> tuple[np.ndarray, int, int]:
    """In how many documents each word of the vocabulary, and each bucket of other words, stands (an item's words are not
    counted where it leaked); the number of documents; the number of their passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids(vocabulary)
        holding = _Holding([np.array([ids.known[w] for w in words], dtype=np.int64) for words in items], len(vocabulary))
        width = len(vocabulary) + BUCKETS
        counts = np.zeros(width + 2, np.int64)
        for batch in batches:
            texts = [lowered(t) for t in batch.column(0).to_pylist()]
            for a, b in groups_by_size([len(t) for t in texts], CHUNK_BYTES):
                hashes, lengths = word_hashes(texts[a:b])
                numbers, text = ids(hashes), np.repeat(np.arange(b - a), lengths)
                pairs = np.unique(text * width + numbers)
                counts[:width] += np.bincount(pairs % width, minlength=width)
                leaked = holding(numbers, text)
                leaked = np.unique(leaked[0] * width + leaked[1])
                leaked = leaked[np.isin(leaked, pairs, assume_unique=True)]
                counts[:width] -= np.bincount(leaked % width, minlength=width)
                n_blocks = -(-lengths // BLOCK_WORDS)
                counts[-1] += np.maximum(np.minimum(n_blocks, 1), n_blocks - 1).sum()
            counts[-2] += batch.num_rows
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(vocabulary) + BUCKETS + 2, np.int64)
    counts[rows["word"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts[:-2], int(counts[-2]), int(counts[-1])


def _pairs(docs: DataFrame, vocabulary: list[bytes], weighted: np.ndarray) -> DataFrame:
    """How often two weighted words of the vocabulary (a and b, also the same) stand together in a passage, over all passages of all documents."""
    size = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids(vocabulary)
        counts = np.append(weighted, np.zeros(BUCKETS, bool))
        pairs, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        fresh: list[np.ndarray] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            code, at = np.unique(np.concatenate([pairs, *fresh]), return_inverse=True)
            own = np.append(times, np.ones(sum(map(len, fresh)), np.int64))
            fresh.clear()
            return code, np.bincount(at, weights=own, minlength=len(code)).astype(np.int64)

        def found() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array((pairs // size).astype(np.int32)), pa.array((pairs % size).astype(np.int32)), pa.array(times)], names=["a", "b", "n"])

        for batch in batches:
            texts = [lowered(t) for t in batch.column(0).to_pylist()]
            for a, b in groups_by_size([len(t) for t in texts], CHUNK_BYTES):
                hashes, lengths = word_hashes(texts[a:b])
                numbers = ids(hashes)
                block, first, last, _ = blocks(lengths)
                known = np.flatnonzero(counts[numbers])
                word, own = numbers[known], block[known]
                begin, end = np.searchsorted(own, first), np.searchsorted(own, last, side="right")
                filled = np.flatnonzero(end > begin)
                for p in range(0, len(filled), PAIRED_PASSAGES):
                    at = filled[p : p + PAIRED_PASSAGES]
                    n = end[at] - begin[at]
                    one, start, many = np.repeat(begin[at], n) + _ranks(n), np.repeat(begin[at], n), np.repeat(n, n)
                    fresh.append(word[np.repeat(one, many)] * size + word[np.repeat(start, many) + _ranks(many)])
                    if sum(map(len, fresh)) > PAIRS:
                        pairs, times = merged()
                        if len(pairs) > PAIRS:
                            yield found()
                            pairs, times = pairs[:0], times[:0]
        pairs, times = merged()
        yield found()

    return docs.select("text").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _passages(words: list[bytes]) -> list[list[bytes]]:
    """The passages of one text, as `blocks` cuts them."""
    n = -(-len(words) // BLOCK_WORDS)
    return [words[i * BLOCK_WORDS : (i + 2) * BLOCK_WORDS] for i in range(max(min(n, 1), n - 1))]


def _products(pairs: DataFrame, right: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A^T (A right) over all passages of the documents, by their pairs of words, summed by word across tasks: the size is vocabulary x rank."""
    n, width = right.shape
    weighed = (right * weights[:, None]).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            a, b, times = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            order = np.argsort(a, kind="stable")
            a, b, times = a[order], b[order], times[order]
            head = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
            for word, i, j in zip(a[head].tolist(), head.tolist(), [*head[1:].tolist(), len(a)], strict=True):
                row = times[i:j].astype(np.float64) @ weighed[b[i:j]]
                total[word] = total[word] + row if word in total else row
        used = list(total)
        for k in range(0, len(used), 2000):
            part = used[k : k + 2000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([total[w] * weights[w] for w in part], pa.list_(pa.float64()))], names=["word", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for word, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = row.values.to_numpy()
                sums[word] = sums[word] + values if word in sums else values
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["word", "row"])

    schema = "word int, row array<double>"
    out = np.zeros((n, width))
    for r in pairs.mapInArrow(run, schema).repartition(4, "word").mapInArrow(add, schema).toLocalIterator():
        out[r.word] = r.row
    return out


@dataclass(frozen=True)
class Frequencies:
    """What is counted once for all items."""

    weights: dict[bytes, float]  # by word of an item: its weight before frequent words lose theirs, always positive
    stopped: frozenset[bytes]  # words of an item in more than COMMON of the documents
    others: np.ndarray  # the weights of the buckets of other words
    n_passages: int


def frequencies(docs: DataFrame, items: list[tuple[int, str, str]]) -> Frequencies:
    """Weights over all documents for the words of all items (id, text, answer)."""
    parsed = [(words_of(text), words_of(answer)) for _, text, answer in items]
    vocabulary = sorted({w for words, answer in parsed for w in words + answer})
    counts, n_docs, n_passages = _frequencies(docs, vocabulary, [words for words, _ in parsed])
    weights = np.log((n_docs + 1) / (counts + 0.5))
    often = counts > max(2, COMMON * n_docs)
    others = np.where(often, 0, weights)[len(vocabulary) :]
    return Frequencies(dict(zip(vocabulary, weights.tolist(), strict=False)), frozenset(w for w, x in zip(vocabulary, often.tolist(), strict=False) if x), others, n_passages)


def fit(docs: DataFrame, items: list[tuple[int, str, str]], counted: Frequencies, min_lcs: float = MIN_LCS) -> Basis:
    """The latent basis of the items (id, text, answer)."""
    parsed = [(i, words_of(text), words_of(answer)) for i, text, answer in items]
    vocabulary = sorted({w for _, words, answer in parsed for w in words + answer})
    rarity = np.array([counted.weights[w] for w in vocabulary])
    own = np.array([0.0 if w in counted.stopped else counted.weights[w] for w in vocabulary])
    basis = Basis(vocabulary, parsed, np.concatenate([own, counted.others]).astype(np.float32), rarity)
    if not vocabulary:
        return basis
    ids = {w: i for i, w in enumerate(vocabulary)}
    lines = [np.array([ids[w] for w in p]) for _, words, _ in parsed for p in _passages(words)]

    def of_items(right: np.ndarray) -> np.ndarray:
        total = np.zeros_like(right)
        for at in lines:
            np.add.at(total, at, own[at, None] * (right[at] * own[at, None]).sum(axis=0)[None, :])
        return total

    pairs = stored(_pairs(docs, vocabulary, own > 0).repartition("a"), "pairs")
    share = CORPUS_SHARE * len(lines) / max(1, counted.n_passages)
    rng = np.random.default_rng(11)
    right = rng.standard_normal((len(vocabulary), min(RANK + OVERSAMPLE, len(vocabulary))))
    q, _ = np.linalg.qr(of_items(right) + share * _products(pairs, right, own))
    image = of_items(q) + share * _products(pairs, q, own)  # A^T A q: one power iteration
    dropped(pairs)
    q, _ = np.linalg.qr(image)
    values, inner = np.linalg.eigh(q.T @ of_items(q))
    u = q @ inner[:, np.argsort(values)[::-1][:RANK]]
    basis.vectors = (u * own[:, None]).astype(np.float32)
    parts = [(i, passage) for i, (_, words, _) in enumerate(parsed) for passage in _passages(words)]
    filled = [words for _, words, _ in parsed if words]
    flat = np.array([ids[w] for words in filled for w in words], dtype=np.int64)
    latent, _, _, _ = projected(flat, np.array([len(words) for words in filled]), basis.weights, basis.vectors)  # passages in the order of parts
    size = np.linalg.norm(latent, axis=1)
    good = np.flatnonzero(size > 1e-6)
    basis.passages, basis.parts = latent[good] / size[good, None], [parts[i] for i in good.tolist()]
    weighted = np.array([np.mean(own[[ids[w] for w in words]] > 0) for _, words in parts])
    basis.frequent = [parts[i] for i in np.flatnonzero((size <= 1e-6) | (weighted <= 1 - min_lcs)).tolist()]
    return basis


def common_subsequence(words: list[bytes], masks: dict[bytes, int], n: int) -> int:
    """Length of the longest common subsequence with a text of n words, given where its words stand as bit masks."""
    every = (1 << n) - 1
    state = every
    for w in words:
        m = masks.get(w)
        if m is not None:
            both = state & m
            state = ((state + both) | (state - both)) & every
    return n - state.bit_count()


class Checker:
    """The check of a candidate in the text, against the passage of an item that it resembles."""

    def __init__(self, basis: Basis) -> None:
        ids = {w: i for i, w in enumerate(basis.vocabulary)}
        self.parts = []
        for item, words in basis.parts:
            masks: dict[bytes, int] = {}
            for i, w in enumerate(words):
                masks[w] = masks.get(w, 0) | 1 << i
            answer = set(basis.items[item][2])
            carrying = answer or set(sorted(set(words), key=lambda w: (-basis.weights[ids[w]], w))[:ANSWER_WORDS])
            self.parts.append((len(words), masks, carrying, bool(answer)))

    def check(self, words: list[bytes], at: int, part: int) -> tuple[float, float]:
        """The best share of the passage that a window of its length (and a fifth more) near a place has in order, and the share of its carrying words there."""
        n, masks, carrying, answered = self.parts[part]
        width = n + n // 5 + 2
        lo, hi = max(0, at - n), min(len(words), at + 2 * BLOCK_WORDS + n)
        around = carrying.intersection(words[max(0, at - 8 * BLOCK_WORDS) : at + 10 * BLOCK_WORDS]) if answered else set()
        best = (0.0, 0.0)
        for a in range(lo, max(lo + 1, hi - width + 1 + n // 8), max(1, n // 8)):
            window = words[a : a + width]
            share = common_subsequence(window, masks, n) / n
            if share > best[0]:
                best = (share, len(around or carrying.intersection(window)) / len(carrying))
        return best


class FrequentSearch:
    """The search for passages that have no use for the latent space: all windows, bounded exactly before the subsequence.

    A window that has its best subsequence starts with a word of the passage, so no other start is looked at. Its words
    must also hold min_lcs of the passage's rarity, so that the most frequent ones cannot fill up a phrase: it has one of
    the rarest words that hold more than the rest of it, the passage's keys, and only the places around those are looked at.
    """

    def __init__(self, basis: Basis, min_cosine: float, min_lcs: float, min_answer: float) -> None:
        ids = {w: i for i, w in enumerate(basis.vocabulary)}
        self.min_cosine, self.min_lcs, self.min_answer = min_cosine, min_lcs, min_answer
        self.local = np.full(len(basis.vocabulary) + 1, -1, np.int32)  # the last place stands for words that no item has
        self.any = np.zeros(len(self.local), bool)
        self.any[[ids[w] for _, words in basis.frequent for w in words]] = True
        keys: list[np.ndarray] = []
        self.parts = []
        for item, words in basis.frequent:
            n, distinct = len(words), sorted(set(words))
            at = np.array([ids[w] for w in distinct])
            times = np.array([words.count(w) for w in distinct])
            masks: dict[bytes, int] = {}
            for i, w in enumerate(words):
                masks[w] = masks.get(w, 0) | 1 << i
            rarity = times * basis.rarity[at]
            energy = rarity * basis.rarity[at]
            whole = n < WHOLE_BELOW
            least = n if whole else next(k for k in range(n + 1) if k / n >= min_lcs)
            order = np.argsort(-rarity, kind="stable")
            keys.append(at[order[: np.searchsorted(np.cumsum(rarity[order]) / rarity.sum(), 1 - min_lcs + 1e-3, side="right") + 1]])
            self.parts.append((item, n, n if whole else n + n // 5 + 2, least, at, times, masks, rarity / rarity.sum(), energy / energy.sum(), set(basis.items[item][2])))
        # of each word of the vocabulary the passages that it is a key of
        word = np.concatenate([*keys, np.zeros(0, np.int64)])
        order = np.argsort(word, kind="stable")
        self.key_parts = np.repeat(np.arange(len(keys)), [len(k) for k in keys])[order]
        self.keyed = np.searchsorted(word[order], np.arange(len(basis.vocabulary) + 1))

    def _near(self, places: np.ndarray, known: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each passage that has a key here, and the places that may be in a window with one."""
        at = np.flatnonzero(self.keyed[known + 1] > self.keyed[known])
        first = self.keyed[known[at]]
        many = self.keyed[known[at] + 1] - first
        part, at = self.key_parts[np.repeat(first, many) + _ranks(many)], np.repeat(at, many)
        order = np.argsort(part, kind="stable")
        part, at = part[order], places[at[order]]
        head = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
        for i, j in zip(head.tolist(), [*head[1:].tolist(), len(part)], strict=False):
            width = self.parts[part[i]][2]
            begin, end = np.searchsorted(places, at[i:j] - width, side="right"), np.searchsorted(places, at[i:j] + width)
            fresh = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))  # stretches that overlap are one
            begin, end = begin[fresh], end[np.append(fresh[1:] - 1, len(end) - 1)]
            yield int(part[i]), np.repeat(begin, end - begin) + _ranks(end - begin)

    def __call__(self, numbers: np.ndarray, lengths: np.ndarray, words: Callable[[int], list[bytes]]) -> Iterator[tuple[int, int, float, float, float]]:
        """Text, item's place, cosine, lcs and answer of each passage that is found; the texts' words lie end to end."""
        stop = np.cumsum(lengths)
        places = np.flatnonzero(self.any[np.minimum(numbers, len(self.local) - 1)])  # of words that some passage here has
        known = numbers[places]
        for part, near in self._near(places, known):
            item, n, width, least, at, times, masks, rarity, energy, answer = self.parts[part]
            self.local[at] = np.arange(len(at))
            local = self.local[known[near]]
            self.local[at] = -1
            own = np.flatnonzero(local >= 0)
            hits, label = places[near[own]], local[own]
            carries = np.append(0, np.cumsum((rarity / times)[label]))
            end = np.searchsorted(hits, hits + width)
            # a window has no more of the passage than the words in it have, however often they stand there
            start = np.flatnonzero((end - np.arange(len(hits)) >= least) & (carries[end] - carries[:-1] >= self.min_lcs - 1e-6))
            found: dict[int, list[tuple[int, int, float, float]]] = {}
            for a in range(0, len(start), CHUNK_WINDOWS):
                first = start[a : a + CHUNK_WINDOWS]
                text = np.searchsorted(stop, hits[first], side="right")
                many = np.minimum(end[first], np.searchsorted(hits, stop[text])) - first
                inside = np.repeat(first, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                rows = np.repeat(np.arange(len(first)), many) * len(at) + label[inside]
                counts = np.bincount(rows, minlength=len(first) * len(at)).reshape(len(first), -1)
                present = np.minimum(counts, times)
                bound = present.sum(axis=1)
                cosine = np.sqrt(np.minimum((counts > 0) @ energy, 1.0))
                carried = present @ (rarity / times) + 1e-9
                able = (bound >= least) & (carried >= self.min_lcs) & (cosine >= self.min_cosine)
                for i in np.flatnonzero(able).tolist():
                    found.setdefault(int(text[i]), []).append((-int(bound[i]), int(hits[first[i]] - stop[text[i]] + lengths[text[i]]), float(cosine[i]), min(1.0, float(carried[i]))))
            for text, windows in found.items():
                best = (least - 1, 0.0, 0.0)
                for bound, a, cosine, share in sorted(windows):
                    if -bound <= best[0]:
                        break  # no later window can have more in order
                    window = words(text)[a : a + width]
                    common = common_subsequence(window, masks, n)
                    if common > best[0]:
                        if answer:
                            around = answer.intersection(words(text)[max(0, a - 8 * BLOCK_WORDS) : a + 10 * BLOCK_WORDS])
                            share = len(around) / len(answer)
                        if share >= self.min_answer:
                            best = (common, cosine, share)
                if best[0] >= least:
                    yield text, item, best[1], best[0] / n, best[2]


def _search(docs: DataFrame, basis: Basis, min_cosine: float, min_lcs: float, min_answer: float) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis = shared.value
        ids, checker = _Ids(basis.vocabulary), Checker(basis)
        frequent = FrequentSearch(basis, min_cosine, min_lcs, min_answer)
        reach = np.linalg.norm(basis.vectors, axis=1)
        for batch in batches:
            names = batch.column(0)
            rows: list[tuple] = []
            texts = [lowered(t) for t in batch.column(1).to_pylist()]
            for a, b in groups_by_size([len(t) for t in texts], CHUNK_BYTES):
                hashes, lengths = word_hashes(texts[a:b])
                if not len(hashes):
                    continue
                numbers = ids(hashes)
                latent, norm, owner, first = projected(numbers, lengths, basis.weights, basis.vectors, reach, min_cosine * LATENT_SHARE)
                best: dict[tuple[int, int], tuple] = {}
                size = np.linalg.norm(latent, axis=1)
                length = np.maximum(np.maximum(size, LATENT_SHARE * norm), 1e-6)
                able = np.flatnonzero(size >= min_cosine * length)  # no other passage can reach the cosine
                split: dict[int, list[bytes]] = {}

                def words(text: int, texts: list[bytes] = texts, a: int = a, split: dict[int, list[bytes]] = split) -> list[bytes]:
                    if text not in split:
                        split[text] = words_of(texts[a + text])
                    return split[text]

                step = max(64, BLOCK_COSINES // max(1, len(basis.passages)))
                for p in range(0, len(able), step):
                    at = able[p : p + step]
                    cosine = latent[at] @ basis.passages.T / length[at, None]
                    for i, j in zip(*np.nonzero(cosine >= min_cosine), strict=True):
                        text, item = int(owner[at[i]]), basis.parts[j][0]
                        lcs, answer = checker.check(words(text), int(first[at[i]]) * BLOCK_WORDS, int(j))
                        if lcs >= min_lcs and answer >= min_answer and lcs > best.get((text, item), (0, -1.0))[1]:
                            best[text, item] = (float(cosine[i, j]), lcs, answer)
                for text, item, cosine, lcs, answer in frequent(numbers, lengths, words):
                    if lcs > best.get((text, item), (0, -1.0))[1]:
                        best[text, item] = (cosine, lcs, answer)
                rows.extend((a + text, basis.items[item][0], *found) for (text, item), found in sorted(best.items()))
            if rows:
                at, item, cosine, lcs, answer = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), batch.column(2).take(pa.array(at)), pa.array(item, pa.int64()), pa.array(cosine), pa.array(lcs), pa.array(answer)], names=["doc_id", "version", "item_id", "cosine", "lcs", "answer"])

    named = docs.select("doc_id", "text", F.xxhash64("text").alias("version"))
    return named.mapInArrow(run, f"doc_id {id_type}, version long, item_id long, cosine double, lcs double, answer double")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    min_cosine: float = MIN_COSINE,
    min_lcs: float = MIN_LCS,
    min_answer: float = MIN_ANSWER,
    id_col: str = "doc_id",
    text_col: str = "text",
    answer_col: str | None = None,
) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, version (hash of the text), item_id, cosine, lcs, answer.

    cosine: of the best passages in the latent space, or, for a passage of frequent words, of the passage and its part
    that stands in the document; lcs: the share of the item passage's words found in order;
    answer: the share of the words that carry it (of a passage of frequent words without an answer, of its rarity). Documents without a leak have no row. Null texts and
    items without a word match nothing; rows that repeat a document each get their rows; items with a null
    id keep it. An empty benchmark or empty documents give no rows.
    """
    base = id_and_text(docs, id_col, text_col)
    answer = F.coalesce(F.col(answer_col), F.lit("")) if answer_col else F.lit("")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"), answer.alias("answer"))
    items = sorted((tuple(r) for r in items.collect()), key=lambda r: (r[1], r[2], r[0] is None, r[0] or 0))
    counted = frequencies(base, items)
    out = None
    for a, b in groups_by_size([len(r[1]) + len(r[2]) for r in items], GROUP_BYTES) if items else [(0, 0)]:
        found = _search(base, fit(base, items[a:b], counted, min_lcs), min_cosine, min_lcs, min_answer)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark item, all columns kept."""
    leaks = stored(contaminated(docs, benchmark).select(F.col("doc_id").alias("leak"), F.col("version").alias("leak_version")).distinct(), "leaks")
    version = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["leak"]) & (version == leaks["leak_version"]), "left_anti")
