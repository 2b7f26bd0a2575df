"""Exact substring dedup and line dedup against brute force, hot keys and every odd row included."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm import fm_index, line_dedup, suffix_array, windows
from folioflow.llm.suffixes import WaveletMatrix, suffix_order


def brute(texts, length):
    """Which units of each text lie in a window that starts twice or more."""
    seen = Counter(tuple(t[i : i + length]) for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[tuple(t[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def rows_of(df, *columns):
    return sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))


@pytest.mark.parametrize("hot", [256, 2])
def test_words(docs, corpus, monkeypatch, hot):
    monkeypatch.setattr(windows, "HOT_SEGMENTS", hot)
    monkeypatch.setattr(windows, "SHARD_BYTES", 4 << 20 if hot > 2 else 5000)
    texts = [(t or "").encode().split() for _, t, *_ in corpus]
    want = [(r[0], len(t), sum(g), b" ".join(w for w, x in zip(t, g, strict=True) if not x).decode()) for r, t, g in zip(corpus, texts, brute(texts, 35), strict=True)]
    assert rows_of(fm_index.substring_dedup(docs), "doc_id", "n_words", "n_removed", "kept_text") == sorted(map(repr, want))
    assert sum(w[2] for w in want) > 1000


@pytest.mark.parametrize("hot", [256, 2])
def test_bytes(docs, corpus, monkeypatch, hot):
    monkeypatch.setattr(windows, "HOT_SEGMENTS", hot)
    texts = [(t or "").encode() for _, t, *_ in corpus]
    want = []
    for r, t, g in zip(corpus, texts, brute(texts, 200), strict=True):
        spans = sum(1 for i, x in enumerate(g) if x and (i == 0 or not g[i - 1]))
        want.append((r[0], len(t), sum(g), spans, bytes(b for b, x in zip(t, g, strict=True) if not x)))
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_array.suffix_array_dedup(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_rows_that_repeat_often(spark):
    """Many copies of a row send their segments to the index once; another text with a part of it is still found."""
    rng = np.random.default_rng(8)
    words = [f"w{x}" for x in rng.integers(0, 500, 300)]
    rows = [(7, " ".join(words))] * 40 + [(8, " ".join(words[100:160])), (None, " ".join(words[:40])), (None, " ".join(words[:40]))]
    got = rows_of(fm_index.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)), "doc_id", "n_words", "n_removed")
    assert got == sorted(map(repr, [(7, 300, 300)] * 40 + [(8, 60, 60), (None, 40, 40), (None, 40, 40)]))


def test_no_rows(empty):
    assert fm_index.substring_dedup(empty).count() == suffix_array.suffix_array_dedup(empty).count() == line_dedup.line_dedup(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=6, max_size=40), min_size=1, max_size=6))
def test_solvers_find_what_brute_force_finds(texts):
    contents = sorted({t.encode() for t in texts})
    cut = windows.Cut(6, (3, 6), False)
    pieces = sorted({p for p in windows.segments(contents, cut)[4]})
    which, first, n = suffix_array.repeats(pieces, np.zeros(len(pieces), bool), cut)
    got = {(int(w), int(f), int(k)) for w, f, k in zip(which, first, n, strict=True)}
    seen = Counter(p[i : i + 6] for p in pieces for i in range(len(p) - 5))
    want = set()
    for w, p in enumerate(pieces):
        hits = [i for i in range(len(p) - 5) if seen[p[i : i + 6]] > 1]
        if hits:
            want.add((w, hits[0], hits[-1] - hits[0] + 1))
    assert got == want
    words = [b" ".join(bytes([c]) for c in p) for p in pieces]
    which, first, n = fm_index.matched(words, np.zeros(len(pieces), bool), windows.Cut(6, (3, 6), True))
    assert {(int(w), int(f), int(k)) for w, f, k in zip(which, first, n, strict=True)} == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_suffix_order_and_ranks(symbols):
    text = np.array([*symbols, 4])
    order, place = suffix_order(text, len(text))
    assert order.tolist() == sorted(range(len(text)), key=lambda i: (text[i:].tolist(), i))
    assert (place[order] == np.arange(len(text))).all()
    wavelet = WaveletMatrix(text, 3)
    for c in range(5):
        ends = np.arange(len(text) + 1)
        ranks = wavelet.descend(np.full(len(ends), c), ends) - wavelet.descend(np.array([c]), np.array([0]))
        assert ranks.tolist() == [int((text[:i] == c).sum()) for i in ends]


@pytest.mark.parametrize("bits", [2, 10, 64])
def test_keys_do_not_depend_on_the_batch(monkeypatch, bits):
    """Whatever texts share a batch, and however often hashes are equal, a text is cut into the same segments with the same keys."""
    exact = windows.mixed
    monkeypatch.setattr(windows, "mixed", lambda x: exact(x) >> np.uint64(64 - bits))
    rng = np.random.default_rng(4)
    texts = [rng.choice(list(b"abcd"), n).astype(np.uint8).tobytes() for n in (400, 90, 20_000, 49, 50, 3000)] + [b"ab" * 200]
    cut = windows.Cut(50, (8, 50), False)

    def pieces(own):
        row, first, n, key, content = windows.segments(own, cut)
        return sorted((own[r], int(f), int(k), int(h), c) for r, f, k, h, c in zip(row.tolist(), first, n, key, content, strict=True))

    assert pieces(texts) == sorted(x for t in texts for x in pieces([t]))
    for t in texts:  # equal windows have equal keys, in whatever text they stand
        for _, first, n, key, content in pieces([t]):
            for i in range(n):
                ((_, _, _, alone, _),) = pieces([content[i : i + 50]])
                assert alone == key


def test_segments_deal_out_every_window_once():
    texts = [b"abracadabra" * 30, b"", b"x" * 300, b"abracadabra" * 25]
    cut = windows.Cut(50, (8, 50), False)
    row, first, n, key, content = windows.segments(texts, cut)
    places = sorted((r, f + i) for r, f, k in zip(row.tolist(), first.tolist(), n.tolist(), strict=True) for i in range(k))
    assert places == [(r, i) for r, t in enumerate(texts) for i in range(len(t) - 49)]
    by_key = defaultdict(set)
    for k, c in zip(key.tolist(), content, strict=True):
        for i in range(len(c) - 49):
            by_key[c[i : i + 50]].add(k)
        assert len({c[i : i + 50] for i in range(len(c) - 49)}) == len(c) - 49  # equal windows never share a segment
    assert all(len(keys) == 1 for keys in by_key.values())


def brute_lines(corpus, min_docs):
    blanks, lower = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(blanks).translate(lower)
    found = defaultdict(set)
    for doc, text, *_ in corpus:
        for x in (text or "").split("\n"):
            found[key(x)].add((doc, text or ""))
    out = []
    for doc, text, *_ in corpus:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not key(x) or len(found[key(x)]) < min_docs]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize(("min_docs", "hot"), [(10, 4096), (10, 1), (2, 3)])
def test_lines(docs, corpus, monkeypatch, min_docs, hot):
    monkeypatch.setattr(line_dedup, "HOT_KEYS", hot)
    out = line_dedup.line_dedup(docs, min_docs)
    assert "version" in out.columns
    assert rows_of(out, "doc_id", "n_lines", "n_dropped", "kept_text") == sorted(map(repr, brute_lines(corpus, min_docs)))


def test_lines_of_a_very_long_document(spark):
    long = "\n".join("common" if i % 3 else f"own {i}" for i in range(30_000))
    rows = [(0, long)] + [(i, "common\nx") for i in range(1, 12)]
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[0]["n_lines"], got[0]["n_dropped"]) == (30_000, 20_000)
    assert got[0]["kept_text"] == "\n".join(f"own {i}" for i in range(0, 30_000, 3))
    assert got[1]["kept_text"] == ""


def test_line_plan_has_no_python(docs):
    plan = line_dedup.line_dedup(docs)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Cartesian"))


def test_digest_of_nothing(docs):
    assert hashlib.sha256(b"").hexdigest() in {hashlib.sha256(r["kept_text"].encode()).hexdigest() for r in line_dedup.line_dedup(docs).collect()}


def test_lines_of_columns_that_clash(spark):
    """Extra columns keep their names and values, whatever the operator calls its own; clashing results are replaced in any case."""
    names = ["doc_id", "text", "row", "doc", "version", "hash", "lines", "gaps", "n", "__row", "pos", "h1", "source", "id", "N_Lines", "KEEP", "with space", "a.b"]
    rows = [tuple([i, f"same\nown {i}"] + [f"{c}{i}" for c in names[2:]]) for i in range(12)]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, names))
    assert out.columns == [c for c in names if c not in ("text", "N_Lines", "KEEP")] + ["n_lines", "n_dropped", "kept_text", "keep"]
    for r in out.collect():
        i = r["doc_id"]
        assert r["kept_text"] == f"own {i}" and r["__row"] == f"__row{i}" and r["a.b"] == f"a.b{i}" and r["version"] == f"version{i}"
        assert (r["n_lines"], r["n_dropped"], [tuple(x) for x in r["keep"]]) == (2, 1, [(1, 2)])


def test_keep_bitmaps(spark):
    """Runs of ones: none where all lines go, all of them where none does; a repeated row changes nothing."""
    rows = [(i, "a\nb\nx%d\na\ny%d" % (i, i)) for i in range(10)] + [(3, "a\nb\nx3\na\ny3")] * 3 + [(20, "A \n\tb"), (21, None), (22, "own"), (None, "a\n\nz")]
    got = sorted((repr((r["doc_id"], r["n_dropped"], [tuple(x) for x in r["keep"]]))) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = [(i, 3, [(2, 3), (4, 5)]) for i in [*range(10), 3, 3, 3]] + [(20, 2, []), (21, 0, [(0, 1)]), (22, 0, [(0, 1)]), (None, 1, [(1, 3)])]
    assert got == sorted(map(repr, want))
