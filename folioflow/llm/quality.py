"""Quality rules as a short-circuit cascade.

Every rule says whether a text fails it. A text is rejected by the first rule that it fails, so
the verdict does not depend on the order; the cost does. The cost that each rule adds to the base
measures (seconds a text) and its rejection rate are estimated on a sample, where its rows are, and
rules run by falling rejection per cost.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_and_text

SYMBOLS = "#*$%&|<>"
#: Rows that the sample has on average, on which costs and rejection rates are estimated.
SAMPLE_ROWS = 400
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8


class Measures:
    """What rules ask about one text; each is computed once, when first asked for."""

    def __init__(self, text: str) -> None:
        self.text, self.raw = text, text.encode("utf-8", "surrogatepass")
        self.words = self.raw.split()
        self.n_words = len(self.words)
        self._seen: dict[str, int] = {}

    def _once(self, name: str, make: Callable[[], int]) -> int:
        if name not in self._seen:
            self._seen[name] = make()
        return self._seen[name]

    def base(self) -> tuple[int, ...]:
        """What every row returns, known before any rule is asked."""
        return (self.n_words, self.word_chars, self.n_symbols, self.n_dup_lines, self.n_repeat_words)

    @property
    def word_chars(self) -> int:
        return self._once("word_chars", lambda: len(self.text) - sum(map(self.text.count, " \t\n\x0b\x0c\r")))

    @property
    def n_symbols(self) -> int:
        return self._once("n_symbols", lambda: sum(map(self.raw.count, SYMBOLS.encode())) if self.text.isascii() else sum(map(self.text.count, SYMBOLS)))

    @property
    def n_dup_lines(self) -> int:
        def count() -> int:
            lines = [x for x in self.raw.split(b"\n") if x.split(None, 1)]
            return len(lines) - len(set(lines))

        return self._once("n_dup_lines", count)

    @property
    def n_repeat_words(self) -> int:
        return self._once("n_repeat_words", lambda: repeated_words(self.words, WINDOW))

    @property
    def n_capitals(self) -> int:
        return self._once("n_capitals", lambda: sum(map(str.isupper, self.text)))

    @property
    def n_letters(self) -> int:
        return self._once("n_letters", lambda: sum(map(str.isalpha, self.text)))

    @property
    def n_shouts(self) -> int:
        return self._once("n_shouts", lambda: self.raw.count(b"!"))

    @property
    def n_stutters(self) -> int:
        """Words equal to the word before them."""
        return self._once("n_stutters", lambda: sum(a == b for a, b in zip(self.words, self.words[1:], strict=False)))


_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words in windows of width words that are found twice or more in the text, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(width):
        part = ids[j : j + n] * _MIX[j % len(_MIX)]
        key += part ^ (part >> np.uint64(29))
    found, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    if len(found) == n:
        return 0
    candidates = np.flatnonzero(counts[inverse] > 1).tolist()
    exact = Counter(tuple(words[i : i + width]) for i in candidates)  # equal hashes are not yet equal windows
    covered = np.zeros(len(words) + 1, np.int64)
    starts = np.array([i for i in candidates if exact[tuple(words[i : i + width])] > 1], dtype=np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + width, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


@dataclass(frozen=True)
class Rule:
    """fails: whether a text with these measures is to be rejected."""

    name: str
    fails: Callable[[Measures], bool]


RULES = (
    Rule("symbols", lambda m: 5 * m.n_symbols > m.n_words),
    Rule("shouts", lambda m: 5 * m.n_shouts > m.n_words),
    Rule("capitals", lambda m: 2 * m.n_capitals > m.n_letters),
    Rule("stutters", lambda m: 10 * m.n_stutters > 3 * m.n_words),
    Rule("repeated_lines", lambda m: 2 * m.n_dup_lines > m.text.count("\n") + 1),
    Rule("long_words", lambda m: m.word_chars > 40 * m.n_words),
)


def base_failed(m: Measures) -> bool:
    return m.n_words < MIN_WORDS or 100 * m.n_repeat_words > MAX_REPEAT_PERCENT * m.n_words


def trials(texts: Iterator[str], rules: tuple[Rule, ...] = RULES) -> dict[str, list[float]]:
    """Of each rule: texts that it saw, texts that it rejects, seconds that it took once the base measures were known."""
    out = {r.name: [0.0, 0.0, 0.0] for r in rules}
    for text in texts:
        m = Measures(text)
        m.base()
        if base_failed(m):
            continue  # no rule is ever shown such a text
        for rule in rules:
            began = time.perf_counter()
            rejected = rule.fails(m)
            spent = time.perf_counter() - began
            out[rule.name] = [x + y for x, y in zip(out[rule.name], (1, rejected, spent), strict=True)]
    return out


def ordered_rules(measured: dict[str, list[float]]) -> list[str]:
    """Names of rules by falling rejection per cost."""
    return sorted(measured, key=lambda name: (-(measured[name][1] + 0.5) / (measured[name][2] + 1e-9), name))


def _tried(base: DataFrame, rules: tuple[Rule, ...], sample_rows: int) -> dict[str, list[float]]:
    """Trials on a sample; only its sums reach the driver."""
    share = min(1.0, sample_rows / max(1, base.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = trials((t for batch in batches for t in batch.column(0).to_pylist()), rules)
        columns = zip(*((name, *x) for name, x in found.items()), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["name", "seen", "rejected", "seconds"])

    sample = base.where(F.rand(7) < share).select("text")
    rows = sample.mapInArrow(run, "name string, seen double, rejected double, seconds double").groupBy("name").agg(F.sum("seen"), F.sum("rejected"), F.sum("seconds")).collect()
    return {r.name: [0.0, 0.0, 0.0] for r in rules} | {r[0]: list(r[1:]) for r in rows}


def passes(m: Measures, rules: list[Rule]) -> bool:
    """The cascade: stops at the first rule that fails."""
    return not any(rule.fails(m) for rule in rules)


def quality_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept.

    A null text has no word and so base_failed. A text that fails the base is not shown to the rules.
    Ids (null too) and repeated rows are passed through; an empty table gives no rows. The sample only
    orders the rules: every row gets the verdict of all of them.
    """
    base = id_and_text(docs, id_col, text_col)
    names = ordered_rules(_tried(base, rules, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_name = {r.name: r for r in rules}
        order = [by_name[n] for n in names]
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                m = Measures(text)
                base, bad = m.base(), base_failed(m)
                rows.append((*base, bad, not bad and passes(m, order)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(c, pa.bool_()) for c in columns[5:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")
