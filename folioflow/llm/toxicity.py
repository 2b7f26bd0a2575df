"""Toxicity by weak supervision.

1. Lexicons: words and word beginnings whose documents are mostly labelled toxic, learnt from labelled rows.
2. Voters: each part of the lexicon votes for toxic or abstains; pattern voters look at the text itself (masked words, runs
   of marks, words in capitals) or at the hits as a whole (none, several, dense, a chance hit in a long text). Labelled
   rows choose the patterns that vote and the way they vote.
3. Label model: a generative model of the votes given the unknown class, with a factor for each pair of voters
   along the tree of the strongest correlations. Expectation maximisation over labelled and unlabelled documents alike
   estimates how each voter votes for each class and what it repeats of another one; labels give the prior alone.
   Every document that is not held out is in it: texts are counted by what decides their votes and features.
4. A linear classifier is trained on the label model's posteriors and scores every document; labelled rows say which of its
   scores the threshold is.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, id_and_text, stored

MAX_TERMS, PREFIXES, LONGEST = 600, (4, 5, 6), 12
#: Lexicon groups of strong terms (nearly all their documents are toxic), and with the weaker ones behind them.
STRONG, GROUPS = 10, 15
STRONG_SHARE, WEAK_SHARE = 0.93, 0.75
MANY_WORDS = 400
WORD = re.compile(r"[^\W\d_]+")
THRESHOLD = 0.7
#: Words that a task remembers what it found out about, and terms that it counts before it passes them on.
REMEMBERED, COUNTED = 1 << 17, 300_000


class _Terms(dict):
    """The terms of each word: itself, if it has at most LONGEST letters, and its beginnings, marked by a trailing star."""

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = (*((word,) if len(word) <= LONGEST else ()), *(word[:n] + "*" for n in PREFIXES if len(word) > n))
        return found

    def of(self, text: str) -> set[str]:
        return set(chain.from_iterable(map(self.__getitem__, set(WORD.findall(text.lower())))))


_MASKED, _CAPITALS = re.compile(r"[^\W\d_][*@#$]+[^\W\d_]"), re.compile(r"[A-Z]{5}")
PATTERNS = (
    lambda text: any(c in text for c in "*@#$") and _MASKED.search(text) is not None,  # a masked word
    lambda text: "!!" in text or "?!" in text,  # runs of marks
    lambda text: _CAPITALS.search(text) is not None,  # words in capitals
)

#: What decides votes and features of a text: groups with a hit, different words that hit a strong term, tenths of the
#: logarithm of their share of the words, whether they are dense, whether they are one at most in a long text, patterns seen.
Seen = tuple[frozenset[int], int, int, bool, bool, tuple[bool, ...]]


class Finder(dict):
    """What texts show to some lexicons. It remembers of each word its groups in each of them, nothing if it has none."""

    def __init__(self, *lexicons: dict[str, int]) -> None:
        self.lexicons = lexicons

    def __missing__(self, word: str) -> tuple[tuple[int, ...], ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        keys = (word, *(word[:n] + "*" for n in PREFIXES if len(word) > n))
        found = tuple(tuple(terms[k] for k in keys if k in terms) for terms in self.lexicons)
        found = self[word] = found if any(found) else ()
        return found

    def seen(self, text: str) -> list[Seen]:
        """Per lexicon."""
        words = WORD.findall(text.lower())
        hits = [h for h in map(self.__getitem__, set(words)) if h]
        patterns = tuple(bool(p(text)) for p in PATTERNS)
        out = []
        for i in range(len(self.lexicons)):
            own = [h[i] for h in hits if h[i]]
            hitting = sum(min(g) < STRONG for g in own)
            density = round(10 * math.log1p(100 * hitting / max(1, len(words))))
            out.append((frozenset(chain.from_iterable(own)), hitting, density, hitting > 0 and 200 * hitting >= len(words), hitting <= 1 and len(words) > MANY_WORDS, patterns))
        return out


@dataclass(frozen=True)
class Model:
    """What scoring needs: a lexicon with a group per term, the ways patterns vote, and the linear weights."""

    terms: dict[str, int]
    ways: tuple[int, ...]
    weights: np.ndarray
    bias: float

    def finder(self) -> Finder:
        return Finder(self.terms)

    def score(self, text: str) -> float:
        return float(self.scores_of([text])[0])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))

    def scores_of(self, texts: list[str | None], finder: Finder | None = None) -> np.ndarray:
        """A finder that is passed on from call to call keeps what it knows of words."""
        finder = self.finder() if finder is None else finder
        return self.scores(np.array([features(finder.seen(t or "")[0], self.ways) for t in texts], dtype=float).reshape(len(texts), -1)) if texts else np.zeros(0)


def votes(seen: Seen, ways: tuple[int, ...]) -> list[int]:
    """1: toxic, -1: clean, 0: abstain. Lexicon groups, then patterns."""
    groups, hitting, _, dense, chance, patterns = seen
    out = [1 if g in groups else 0 for g in range(GROUPS)]
    out.extend(way if found else 0 for way, found in zip(ways, patterns, strict=True))
    out.append(-1 if not hitting else 0)  # no hit
    out.append(1 if hitting >= 2 else 0)  # several hits
    out.append(1 if hitting >= 4 else 0)
    out.append(1 if dense else 0)  # dense hits
    out.append(-1 if chance else 0)  # a long text with a chance hit at most
    return out


def features(seen: Seen, ways: tuple[int, ...]) -> list[float]:
    return [*map(float, votes(seen, ways)), math.log1p(seen[1]), seen[2] / 10]


N_FEATURES = GROUPS + len(PATTERNS) + 7


def _key(seen: Seen) -> str:
    groups, hitting, density, dense, chance, patterns = seen
    return ",".join(map(str, (hitting, density, int(dense), int(chance), *map(int, patterns), *sorted(groups))))


def _of_key(key: list[int]) -> Seen:
    hitting, density, dense, chance, *rest = key
    return frozenset(rest[len(PATTERNS) :]), hitting, density, bool(dense), bool(chance), tuple(map(bool, rest[: len(PATTERNS)]))


def _joint(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return np.bincount(a * 3 + b, weights=weight, minlength=9).reshape(3, 3)


def correlation_tree(v: np.ndarray, weight: np.ndarray, q: np.ndarray) -> list[int]:
    """Of each voter the one that it depends on besides the class, -1 for none: the tree of the largest mutual information given the class."""
    m = v.shape[1]
    shared = np.zeros((m, m))
    for i in range(m):
        for j in range(i):
            for p in (weight * (1 - q), weight * q):
                joint = _joint(v[:, i], v[:, j], p) + 1e-9
                joint /= max(weight.sum(), 1e-9)
                expected = joint.sum(axis=1, keepdims=True) * joint.sum(axis=0, keepdims=True) / joint.sum()
                shared[i, j] += (joint * np.log(joint / expected)).sum()
            shared[j, i] = shared[i, j]
    parent, near, on = [-1] * m, shared[0].copy(), [0]
    of = np.zeros(m, int)
    near[0] = -1
    while len(on) < m:
        j = int(np.argmax(near))
        if near[j] > 1e-4:
            parent[j] = int(of[j])
        on.append(j)
        closer = shared[j] > near
        near, of = np.where(closer, shared[j], near), np.where(closer, j, of)
        near[on] = -1
    return parent


def label_model(votes: np.ndarray, weight: np.ndarray, prior: float, rounds: int = 40) -> np.ndarray:
    """Posterior of toxic for each row of votes (-1, 0, 1), which stands for weight documents. Labels give the prior alone."""
    v = np.asarray(votes) + 1
    # to begin with, voters that go together share one vote
    centred = (v - np.average(v, axis=0, weights=weight)) * np.sqrt(weight)[:, None]
    spread = np.sqrt((centred**2).sum(axis=0)) + 1e-9
    alike = np.clip(centred.T @ centred / np.outer(spread, spread), 0, 1) ** 2
    np.fill_diagonal(alike, 1)
    q = 1 / (1 + np.exp(-2.0 * ((v - 1) @ (1 / alike.sum(axis=1)))))
    parent: list[int] = []
    for turn in range(rounds):
        if turn in (1, 5, 15):  # the correlations of what the classes leave open
            parent = correlation_tree(v, weight, q)
        logit = np.full(len(v), np.log(prior / (1 - prior)))
        for j in range(v.shape[1]):
            up = parent[j] if parent else -1
            for sign, p in ((-1, weight * (1 - q)), (1, weight * q)):
                alone = np.bincount(v[:, j], weights=p, minlength=3) + 0.5
                alone /= alone.sum()
                if up < 0:
                    logit += sign * np.log(alone)[v[:, j]]
                else:
                    given = _joint(v[:, up], v[:, j], p) + 2 * alone
                    logit += sign * np.log(given / given.sum(axis=1, keepdims=True))[v[:, up], v[:, j]]
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if turn > 16 and np.abs(new - q).max() < 1e-6:
            return new
        q = new
    return q


def linear_classifier(x: np.ndarray, target: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps with a ridge penalty; a row stands for weight documents."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1]) * penalty * weight.sum()
    ridge[-1, -1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(len(w)), z.T @ (weight * (target - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def held_out(doc_id: F.Column) -> F.Column:
    """crc32 of the id as text, modulo 3, is 1: labels of such rows are never learnt from. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int | None = None) -> Model:
    """Fit on all rows that are not held out, labelled or not; without a word that tells toxic labels from others the model scores 0 everywhere.

    Nothing is sampled, unless max_labelled bounds the labels that are used (by a hash of the id). Labels are joined by
    a shuffle, so that they may be as many as the documents; only the texts that may have one move.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = stored(known.groupBy(F.col("doc_id").alias("doc_id")).agg((F.max("toxic") > 0).alias("toxic")), "labels")
    of_known = known
    if max_labelled is not None and (n_known := known.count()) > max_labelled:  # with room for its chance: no sort, and nothing passes through one task
        least = max(1, max_labelled - 4 * int(max_labelled**0.5))
        of_known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.lit((least << 40) // n_known))
    learnt = id_and_text(docs).where(~held_out(F.col("doc_id")))
    rows = learnt.join(of_known.hint("shuffle_hash"), "doc_id").select("text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, found = _Terms(), (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            names = list(found[0].keys() | found[1].keys())
            numbers = [pa.array([f[t] for t in names], pa.int64()) for f in found]
            for f in found:
                f.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *numbers], names=["term", "clean", "toxic"])

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[toxic][""] += 1
                found[toxic].update(terms.of(text))
                if len(found[0]) + len(found[1]) > COUNTED:
                    yield flush()
        yield flush()

    counts = rows.mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = counts.where("term = '' or (toxic >= 3 and toxic >= 2 * clean)").orderBy(F.desc("toxic"), "clean", "term").limit(20 * MAX_TERMS).collect()
    totals = next(((r.clean, r.toxic) for r in counts if not r.term), (0, 0))
    nothing = Model({}, (0,) * len(PATTERNS), np.zeros(N_FEATURES), -30.0)
    if not totals[1]:
        dropped(known)
        return nothing
    rate = totals[1] / max(1, sum(totals))
    least = max(3, round(0.004 * totals[1]))
    often = max(3, round(0.01 * totals[1]))  # below that a term may be the wording of one text and its copies

    def lexicon(less_clean: int = 0, less_toxic: int = 0) -> dict[str, int]:
        """Terms and their groups, as they are without a clean or a toxic row that has them."""
        known = [(r.term, max(0, r.clean - less_clean), r.toxic - less_toxic) for r in counts if r.term]
        share = lambda clean, toxic: (toxic + rate) / (toxic + clean + 1)
        worth = lambda t: -t[2] * np.log((t[2] + 0.5) / (t[1] + 0.5) / (totals[1] + 1) * (totals[0] + 1))
        chosen = sorted((t for t in known if t[2] >= least and share(*t[1:]) > WEAK_SHARE), key=lambda t: (worth(t), t[0]))[:MAX_TERMS]
        place = lambda term, n: zlib.crc32(term[:4].encode()) % n
        return {t: place(t, STRONG) if toxic >= often and toxic >= STRONG_SHARE * (toxic + clean) else STRONG + place(t, GROUPS - STRONG) for t, clean, toxic in chosen}

    terms = lexicon()
    if not terms:  # too few labels to learn a word from
        dropped(known)
        return nothing
    # a labelled row is shown the lexicon that the other rows give, so that it does not find its own words
    drafts = (terms, lexicon(less_clean=1), lexicon(less_toxic=1))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(*drafts)
        for batch in batches:
            keys = [[_key(s) for s in finder.seen(text)] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([k[i] for k in keys], pa.string()) for i in range(3))], names=["doc_id", "none", "clean", "toxic_"])

    # what decides votes and features, counted: few different rows, however many texts there are
    keyed = learnt.mapInArrow(extract, f"doc_id {learnt.schema['doc_id'].dataType.simpleString()}, none string, clean string, toxic_ string").join(of_known.hint("shuffle_hash"), "doc_id", "left")
    key = F.when(F.col("toxic"), F.concat(F.lit("1,"), "toxic_")).when(~F.col("toxic"), F.concat(F.lit("0,"), "clean")).otherwise(F.concat(F.lit("-1,"), "none"))
    kinds = keyed.groupBy(key.alias("key")).agg(F.count("*").alias("n")).toPandas().sort_values("key")
    dropped(known)
    labels_of, seen = [], []
    for name in kinds["key"]:
        toxic, *rest = map(int, name.split(","))
        labels_of.append(toxic)
        seen.append(_of_key(rest))
    weight, label = kinds["n"].to_numpy(float), np.array(labels_of)
    ways = []
    for i in range(len(PATTERNS)):
        has = np.array([s[-1][i] for s in seen])
        good, bad = (weight[has & (label == y)].sum() for y in (0, 1))
        precision = (bad + rate) / (good + bad + 1)
        ways.append(1 if bad >= least and precision > max(0.5, 2 * rate) else -1 if good >= least and precision < rate / 2 else 0)
    ballots, ballot = np.unique(np.array([votes(s, tuple(ways)) for s in seen]), axis=0, return_inverse=True)
    ballot = ballot.reshape(-1)
    posterior = label_model(ballots, np.bincount(ballot, weights=weight), min(0.9, max(0.02, rate)))[ballot]
    x = np.array([features(s, tuple(ways)) for s in seen])
    w, bias = linear_classifier(x, posterior, weight)
    return Model(terms, tuple(ways), w, bias + threshold_shift(x @ w + bias, weight, label))


def threshold_shift(logit: np.ndarray, weight: np.ndarray, label: np.ndarray) -> float:
    """What moves the cut with the fewest errors on labelled rows (label 0 or 1) to THRESHOLD; the middle of equally good ones."""
    order = np.argsort(logit[label >= 0], kind="stable")
    cut, n, y = logit[label >= 0][order], weight[label >= 0][order], label[label >= 0][order]
    # rows from here on are taken for toxic; from behind the last: none
    fresh = np.append(np.flatnonzero(np.append(True, np.diff(cut) > 1e-9)), len(cut))
    missed, alarms = np.append(0, np.cumsum(n * (y == 1))), np.append(0, np.cumsum(n * (y == 0)))
    errors = missed[fresh] + alarms[-1] - alarms[fresh]
    best = np.flatnonzero(errors == errors.min())
    at = fresh[best[(len(best) - 1) // 2]]
    low, high = cut[at - 1] if at else cut[0] - 2, cut[at] if at < len(cut) else cut[-1] + 2
    return float(np.log(THRESHOLD / (1 - THRESHOLD)) - (low + high) / 2)


def toxicity_scores(docs: DataFrame, labels: DataFrame, max_labelled: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.7).

    Only the text is scored; null is empty and scores like any text without a hit. Labels of ids that docs
    lack are not used. Ids (null too) and repeated rows are passed through; no documents, no rows.
    """
    base = id_and_text(docs, id_col, text_col)
    model = fit(base, labels, max_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = model.finder()
        for batch in batches:
            score = model.scores_of(batch.column(1).to_pylist(), finder)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame, max_labelled: int | None = None, text_col: str = "text") -> DataFrame:
    """docs without the rows that are predicted toxic, all columns kept: rows are scored where they are, nothing is shuffled.

    A null text is empty and stays; repeated rows are judged alike; no documents, no rows. text_col is found in any case.
    """
    model = fit(id_and_text(docs, text_col=text_col), labels, max_labelled)
    at = [c.lower() for c in docs.columns].index(text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = model.finder()
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(model.scores_of(batch.column(at).to_pylist(), finder) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
