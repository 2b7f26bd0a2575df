"""BPE encoding and decoding by a deterministic tokenization automaton.

The automaton reads tokens; its paths are exactly the tokenizations that the merge list
produces. It starts as one state with a loop for every base token, and each merge (u, v) -> w
adds one gadget: the state that u leads to is copied without its v-transition (u may no longer
be followed by v), and wherever u can be read, w can be read as well, leading where v led. Since
targets depend on the token read alone, a copy shares everything with its original but the
transitions that it lost: v, and the tokens whose left edge goes through v later on. Numbered along
their left edges, those are one range.

The states that a token leads to are compiled into a transition table of bits, one for each token,
whose equal blocks are stored once (a few MB, whatever the data). It is made on the driver and sent
to the workers. Encoding is table-driven: from each place of a word, in order, a table trie offers the
arcs and the transition table says which the automaton has; every prefix has exactly one accepted path, so a
place's state is set once and nothing is taken back. Many words go through the tables side by side.
Decoding emits the byte labels of the arcs.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .shared import groups_by_size, id_and_text

#: The byte-level pre-split of the vocabulary files (a fixed value of that tokenizer family).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Letters and numbers of newer Unicode versions than the pre-split knows (fixed values, measured on the tokenizers library);
#: it takes them for symbols.
NEWER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24),
    (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
_NEWER = "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER)
_L, _N = rf"[\p{{L}}--[{_NEWER}]]", rf"[\p{{N}}--[{_NEWER}]]"
SPLIT_WITH_NEWER = rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{_L}+| ?{_N}+| ?[[^\s\p{{L}}\p{{N}}]||[{_NEWER}]]+|\s+(?!\S)|\s+"
#: Distinct words whose ids a worker remembers.
WORD_CACHE = 300_000
#: Tokens in a block of the transition table; words of so many bytes or more, and groups of fewer words, go one by one.
BLOCK, LONG_WORD, FEW_WORDS = 512, 48, 24
#: Bytes of text whose words are looked up at a time.
CHUNK_BYTES = 1 << 20


def byte_symbols() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, the others from U+0100 on in byte order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    others = [b for b in range(256) if b not in set(plain)]
    return out | {chr(0x100 + i): b for i, b in enumerate(others)}


class Gadgets:
    """The automaton's states and what each lost, built merge by merge."""

    def __init__(self, readable: list[int], merges: list[tuple[int, int, int]]) -> None:
        self.left: dict[int, int] = {}
        self.born: dict[int, int] = {}
        self.state_of: dict[int, int] = dict.fromkeys(readable, 0)
        self.parent, self.lost, self.since = [-1], [-1], [-1]  # state 0: everything is allowed
        for rank, (u, v, w) in enumerate(merges):
            if u not in self.state_of or v not in self.state_of or w in self.state_of or not self.allowed(self.state_of[u], v):
                continue  # no path has u before v: the gadget changes nothing
            after_v = self.state_of[v]
            self.parent.append(self.state_of[u])
            self.lost.append(v)
            self.since.append(rank)
            self.state_of[u] = len(self.parent) - 1
            self.state_of[w] = after_v
            self.left[w], self.born[w] = u, rank

    def allowed(self, state: int, token: int) -> bool:
        """Whether the state has a transition for the token: no part of the token's left edge was lost before the next part was born."""
        until = {token: len(self.since)}  # the token, and its left edge up to when each part went into the next
        while token in self.left:
            born, token = self.born[token], self.left[token]
            until[token] = born
        while state:
            last = until.get(self.lost[state])
            if last is not None and self.since[state] <= last:
                return False
            state = self.parent[state]
        return True

    def compiled(self) -> tuple[dict[int, int], dict[int, int], np.ndarray, np.ndarray]:
        """Each token's number, each token's row (row 0 is where a word begins), the blocks of each row, and the different blocks
        (bits of lost transitions)."""
        below: dict[int, list[int]] = {}
        for w in sorted(self.left, key=self.born.__getitem__):
            below.setdefault(self.left[w], []).append(w)
        number: dict[int, int] = {}
        end: dict[int, int] = {}
        for root in (t for t in self.state_of if t not in self.left):
            todo = [(root, False)]
            while todo:
                token, done = todo.pop()
                if done:
                    end[token] = len(number)
                    continue
                number[token] = len(number)
                todo.append((token, True))
                todo.extend((w, False) for w in reversed(below.get(token, ())))
        births = {t: [self.born[w] for w in own] for t, own in below.items()}
        live = sorted({0, *self.state_of.values()})
        row_of = {state: i for i, state in enumerate(live)}
        blocks: dict[bytes, int] = {}
        width = -(-len(number) // BLOCK)
        table = np.empty((len(live), width), np.int32)
        bits = np.empty(width * BLOCK, bool)
        for i, state in enumerate(live):
            bits[:] = False
            while state:
                v = self.lost[state]
                later = bisect.bisect_left(births.get(v, ()), self.since[state])
                bits[number[v]] = True
                if later < len(births.get(v, ())):
                    bits[number[below[v][later]] : end[v]] = True
                state = self.parent[state]
            packed = np.packbits(bits, bitorder="little").reshape(width, BLOCK // 8)
            table[i] = [blocks.setdefault(x.tobytes(), len(blocks)) for x in packed]
        return number, {t: row_of[s] for t, s in self.state_of.items()}, table, np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, BLOCK // 8)


class _Trie:
    """The arcs' labels as tables: a node and a byte give the next node, by hash with chains for those that meet."""

    def __init__(self, labels: dict[int, bytes]) -> None:
        nodes: dict[int, int] = {}
        token = [-1]
        for i, label in labels.items():
            node = 0
            for byte in label:
                key = node << 8 | byte
                node = nodes.get(key, 0)
                if not node:
                    node = nodes[key] = len(token)
                    token.append(-1)
            token[node] = i
        self.token = np.array(token, np.int32)
        self.keys = np.fromiter(nodes, np.int64, len(nodes))  # a key's place is its node less one
        self.chains: list[tuple[int, np.ndarray, np.ndarray]] = []
        number = np.arange(len(nodes))
        while len(number):
            bits = max(8, (8 * len(number)).bit_length())
            table, more = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, bool)
            at = self._place(self.keys[number], bits)
            table[at] = number
            left = table[at] != number
            more[at[left]] = True
            self.chains.append((bits, table, more))
            number = number[left]

    @staticmethod
    def _place(key: np.ndarray, bits: int) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)

    def __call__(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next nodes, 0 where there is none. Only places where keys meet are looked up in a further table."""
        key = node.astype(np.int64) << 8 | byte
        out = np.zeros(len(key), np.int64)
        todo = None
        for bits, table, more in self.chains:
            own = key if todo is None else key[todo]
            at = self._place(own, bits)
            number = table[at]
            hit = self.keys[number] == own
            if todo is None:
                out = np.where(hit, number + 1, 0)
                todo = np.flatnonzero(more[at] & ~hit)
            else:
                out[todo[hit]] = number[hit] + 1
                todo = todo[more[at] & ~hit]
            if not len(todo):
                break
        return out


class BpeAutomaton:
    """Compiled from a tokenizer file's vocabulary, merges and special tokens: tables only."""

    def __init__(self, spec: dict) -> None:
        model, symbols = spec["model"], byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        labels = {i: bytes(symbols[c] for c in t) for t, i in vocab.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        gadgets = Gadgets([i for t, i in vocab.items() if len(t) == 1], [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        number, row, self.table, self.blocks = gadgets.compiled()
        self.trie = _Trie({i: labels[i] for i in gadgets.state_of})
        size = 1 + max([*labels, *self.special.values()])
        self.number, self.row, self.length = (np.zeros(size, np.int32) for _ in range(3))
        for i in gadgets.state_of:
            self.number[i], self.row[i], self.length[i] = number[i], row[i], len(labels[i])
        self.labels = [b""] * size
        for i, label in (labels | {i: t.encode() for t, i in self.special.items()}).items():
            self.labels[i] = label

    def table_bytes(self) -> int:
        return sum(x.nbytes for x in (self.table, self.blocks, self.number, self.row, self.length, self.trie.token, self.trie.keys, *(x for _, *own in self.trie.chains for x in own)))

    def allowed(self, row: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The transition table: whether the states of the rows have the tokens' arcs."""
        at = self.number[token]
        block = self.table[row, at // BLOCK]
        return (self.blocks[block, at % BLOCK >> 3] >> (at & 7).astype(np.uint8)) & 1 == 0

    def encode_many(self, words: list[bytes]) -> list[bytes]:
        """The ids of words, as little-endian unsigned 32-bit integers; words of one length go through the tables together."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == n).tolist()
            if n >= LONG_WORD or len(own) < FEW_WORDS:
                for i in own:
                    out[i] = np.array(self.encode_word(words[i]), "<u4").tobytes()
                continue
            text = np.frombuffer(b"".join([words[i] for i in own]), np.uint8).reshape(len(own), n).T.copy()
            rows, arcs = np.zeros((n + 1, len(own)), np.int32), np.zeros((n + 1, len(own)), np.int32)
            for a in range(n):
                at, node = np.arange(len(own)), np.zeros(len(own), np.int64)
                for b in range(a, n):
                    node = self.trie(node, text[b, at])
                    there = np.flatnonzero(node)
                    if not len(there):
                        break
                    at, node = at[there], node[there]
                    token = self.trie.token[node]
                    some = np.flatnonzero(token >= 0)
                    some = some[self.allowed(rows[a, at[some]], token[some])]
                    arcs[b + 1, at[some]] = token[some]
                    rows[b + 1, at[some]] = self.row[token[some]]
            place, path = np.full(len(own), n), []
            while place.any():
                token = arcs[place, np.arange(len(own))]
                path.append(np.where(place > 0, token, -1))
                place = np.maximum(place - self.length[token] * (place > 0), 0)
            path = np.stack(path[::-1]).T
            ids = path[path >= 0].astype("<u4").tobytes()
            ends = np.cumsum((path >= 0).sum(axis=1)) * 4
            for i, a, b in zip(own, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                out[i] = ids[a:b]
        return out

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of one word of any length, place by place: time is linear in it, as an arc has a bounded label."""
        n = len(word)
        rows, arcs = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
        child, token_at, number, row = self.children(), self.token_list, self.number_list, self.row_list
        table, blocks = self.table, self.blocks
        for a in range(n):
            node, own = 0, table[rows[a]]
            for b in range(a, n):
                node = child.get(node << 8 | word[b], 0)
                if not node:
                    break
                token = token_at[node]
                if token >= 0:
                    at = number[token]
                    if not blocks[own[at // BLOCK], at % BLOCK >> 3] >> (at & 7) & 1:
                        rows[b + 1], arcs[b + 1] = row[token], token
        path = []
        while n:
            path.append(int(arcs[n]))
            n -= len(self.labels[path[-1]])
        return path[::-1]

    def children(self) -> dict[int, int]:
        """The trie's table and the tokens' numbers as Python objects, made when a worker first needs them."""
        if not hasattr(self, "_children"):
            self._children = dict(zip(self.trie.keys.tolist(), range(1, len(self.trie.keys) + 1), strict=True))
            self.token_list, self.number_list, self.row_list = self.trie.token.tolist(), self.number.tolist(), self.row.tolist()
        return self._children

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_children", "token_list", "number_list", "row_list")}

    def split(self, text: str) -> list[str]:
        """The pre-split words."""
        try:
            text.isascii() or text.encode("latin-1")
        except UnicodeEncodeError:
            split = _plain() if not _newer()[0].search(text) else _newer()[1]
            return split.findall(text)
        return _narrow().findall(text)

    def pieces(self, text: str) -> list[str | int]:
        """Pre-split words, and the ids of special tokens whose strings stand in the text."""
        if not any(s in text for s in self.special):
            return self.split(text)
        names = sorted(self.special, key=len, reverse=True)
        out: list[str | int] = []
        for piece in regex.split("(" + "|".join(map(regex.escape, names)) + ")", text):
            out.extend([self.special[piece]] if piece in self.special else self.split(piece))
        return out

    def encoder(self) -> _Words:
        return _Words(self)

    def encode(self, text: str, words: _Words | None = None) -> np.ndarray:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return (self.encoder() if words is None else words).encode([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.labels.__getitem__, ids.tolist())).decode("utf-8", "replace")


@functools.cache
def _plain() -> regex.Pattern:
    return regex.compile(SPLIT)


@functools.cache
def _newer() -> tuple[re.Pattern, regex.Pattern]:
    return re.compile(f"[{_NEWER}]"), regex.compile(SPLIT_WITH_NEWER)


@functools.cache
def _narrow() -> re.Pattern:
    """The same pre-split for texts of characters below U+0100, with its classes spelt out."""
    below = [chr(i) for i in range(256)]
    letters, numbers, blanks = (re.escape("".join(c for c in below if regex.match(k, c))) for k in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{blanks}{letters}{numbers}]+|[{blanks}]+(?![^{blanks}])|[{blanks}]+")


class _Words(dict):
    """word -> its ids as bytes. The words of a chunk that are missing go through the automaton together; emptied when full."""

    def __init__(self, automaton: BpeAutomaton) -> None:
        self.automaton = automaton
        super().__init__((i, i.to_bytes(4, "little")) for i in automaton.special.values())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self) >= WORD_CACHE:
            self.clear()
            self.__init__(self.automaton)
        split = [self.automaton.pieces(t) for t in texts]
        missing = list(set().union(*split).difference(self))
        long = []
        for word, ids in zip(missing, self.automaton.encode_many([w.encode() for w in missing]), strict=True):
            self[word] = ids
            if len(word) > 64:
                long.append(word)
        out = [np.frombuffer(b"".join(map(self.__getitem__, words)), dtype="<u4") for words in split]
        for word in long:
            del self[word]
        return out


_LOADED: dict[str, tuple[BpeAutomaton, _Words]] = {}


@functools.cache
def _compiled(path: str, digest: str) -> BpeAutomaton:
    with open(path, "rb") as f:
        return BpeAutomaton(json.loads(f.read()))


def _sent(spark: SparkSession, tokenizer_path: str) -> Callable[[], tuple[BpeAutomaton, _Words]]:
    """What gives a worker its automaton: compiled once on the driver, sent as tables, kept for the worker's later tasks."""
    with open(tokenizer_path, "rb") as f:
        digest = hashlib.sha256(f.read()).hexdigest()
    shared = spark.sparkContext.broadcast(_compiled(tokenizer_path, digest))

    def load() -> tuple[BpeAutomaton, _Words]:
        if digest not in _LOADED:
            _LOADED[digest] = (shared.value, shared.value.encoder())
        return _LOADED[digest]

    return load


def _encoded(words: _Words, texts: list[str]) -> Iterator[np.ndarray]:
    for a, b in groups_by_size([len(t) for t in texts], CHUNK_BYTES):
        yield from words.encode(texts[a:b])


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids (array<long>), decoded (the text that the ids spell).

    The tokenizer file is read and compiled on the driver, and its tables are sent to the workers (their size does not
    depend on the data). A null text is an empty text: no ids, decoded empty. Special tokens' strings in a text are
    those tokens. Ids and repeated rows are passed through.
    """
    load = _sent(docs.sparkSession, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, words = load()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = list(_encoded(words, part.column(1).to_pylist()))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = pa.array(np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int64))
                decoded = pa.array([automaton.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), values), decoded], names=["doc_id", "ids", "decoded"])

    base = id_and_text(docs, id_col, text_col)
    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, ids array<bigint>, decoded string")


def bpe_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bpe_round_trip reduced where it is made: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    load = _sent(docs.sparkSession, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, words = load()
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for ids in _encoded(words, batch.column(1).to_pylist()):
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(ids.tobytes()).hexdigest())
                of_text.append(hashlib.sha256(automaton.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    base = id_and_text(docs, id_col, text_col)
    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
