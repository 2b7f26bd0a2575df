"""Benchmark leaks: whole and paraphrased passages are found, chance phrases are not."""

import random

import numpy as np
import pytest

from folioflow.llm import decontaminate as dec


def invented(rng, n, stems=("al", "ber", "cor", "dan", "el", "fo", "gri", "hul", "is", "jo", "kel", "mor")):
    common = ["the", "of", "and", "to", "in"]
    return [rng.choice(common) if rng.random() < 0.35 else "".join(rng.choice(stems) for _ in range(rng.randint(2, 4))) for _ in range(n)]


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(4)
    items = [(i, invented(rng, rng.randint(15, 60))) for i in range(60)]
    rows, truth = [], set()
    for d in range(400):
        words = invented(rng, rng.randint(40, 400))
        if d % 4 == 0:
            i, own = items[d // 4 % 60]
            own = list(own)
            if d % 8 == 0:  # a paraphrase: a sixth of the words replaced
                for k in rng.sample(range(len(own)), len(own) // 6):
                    own[k] = "".join(rng.choice("xyzq") for _ in range(5))
            if d % 16 == 4 and len(own) >= 50:  # the greater half of a long item
                own = own[10:45]
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() if d % 3 == 0 else w for w in own]
            truth.add((d, i))
        elif d % 4 == 1:  # a phrase of six words is no leak
            own = items[d % 60][1]
            words[10:10] = own[3:9]
        rows.append((d, (", " if d % 5 == 0 else " ").join(words), "clash"))
    rows += [(1000, None, None), (1001, "", None), (None, " ".join(items[0][1]), None), (1002, "short", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, version string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(900, None), (901, "?")], "item_id long, text string")
    return docs, bench, truth | {(None, 0)}


def test_leaks(planted):
    docs, bench, truth = planted
    got = {(r["doc_id"], r["item_id"]) for r in dec.contaminated(docs, bench).collect()}
    assert got <= truth
    assert len(got) >= 0.95 * len(truth)
    left = {r["doc_id"] for r in dec.without_leaks(docs, bench).collect()}
    assert left == {r["doc_id"] for r in docs.collect()} - {d for d, _ in got}


def test_other_items_and_groups_change_nothing(planted, monkeypatch):
    """Half of the items, or items in groups with a basis each, find the same documents with the same words in order."""
    docs, bench, _ = planted
    found = lambda b: {(r["doc_id"], r["item_id"], r["lcs"]) for r in dec.contaminated(docs, b).collect()}
    whole = found(bench)
    assert found(bench.where("item_id % 2 = 0")) == {x for x in whole if x[1] % 2 == 0}
    monkeypatch.setattr(dec, "BLOCK_COSINES", 100)
    assert found(bench) == whole
    monkeypatch.setattr(dec, "GROUP_BYTES", 4000)
    assert found(bench) == whole


def test_recall_against_brute_force(planted):
    """Of all documents that hold at least half of an item's runs of three words, nine in ten or more are found."""
    docs, bench, _ = planted
    runs = lambda words: {tuple(words[i : i + 3]) for i in range(len(words) - 2)}
    items = {r["item_id"]: runs(dec.words_of(r["text"] or "")) for r in bench.collect()}
    want = {(r["doc_id"], i) for r in docs.collect() for own in [runs(dec.words_of(r["text"] or ""))] for i, x in items.items() if x and 2 * len(x & own) >= len(x)}
    got = {(r["doc_id"], r["item_id"]) for r in dec.contaminated(docs, bench).collect()}
    assert len(want) > 60 and len(want & got) >= 0.9 * len(want)


def test_the_basis_is_fitted_on_every_passage(spark, monkeypatch):
    """The products that the SVD takes are those of all passages of all documents, short and empty ones too, however many there are."""
    rng = random.Random(12)
    item = invented(rng, 60)
    texts = [" ".join(rng.choice(item) if rng.random() < 0.02 else w for w in invented(rng, rng.randint(1, 150))) for _ in range(1500)]
    docs = spark.createDataFrame([*enumerate(texts), (-1, ""), (-2, "? !")], "doc_id long, text string").repartition(3)
    taken, products = [], dec._products
    monkeypatch.setattr(dec, "_products", lambda rows, right, weights: taken.append((right, weights, products(rows, right, weights))) or taken[-1][2])
    monkeypatch.setattr(dec, "PAIRS", 50, raising=False)  # tasks pass on what they count in parts
    items = [(0, " ".join(item), "")]
    basis = dec.fit(docs, items, dec.frequencies(docs, items))
    ids = {w: i for i, w in enumerate(basis.vocabulary)}
    passages = [p for t in texts for p in dec._passages(dec.words_of(t))]
    counts = np.zeros((len(passages), len(ids)))
    for row, words in zip(counts, passages, strict=True):
        np.add.at(row, [ids[w] for w in words if w in ids], 1)
    assert len(passages) > 4500 and len(taken) == 2
    for right, weights, got in taken:
        weighed = counts * weights
        want = weighed.T @ (weighed @ right)
        assert np.abs(want).max() > 0 and np.allclose(got, want, rtol=1e-4, atol=1e-4 * np.abs(want).max())


@pytest.mark.parametrize(("n_docs", "held"), [(200, 8), (200, 4), (50, 3), (2000, 70), (2000, 50), (90, 90)])
def test_an_item_is_found_however_often_it_leaked(spark, n_docs, held):
    rng = random.Random(n_docs + held)
    item = invented(rng, 40)
    texts = [invented(rng, rng.randint(60, 120)) for _ in range(n_docs)]
    rare = {w.encode() for w in item if sum(w in t for t in texts) <= 2}
    for d in range(held):
        texts[d][9:9] = item
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    counted = dec.frequencies(docs, [(0, " ".join(item), "")])
    assert len(rare) > 2 and not rare & counted.stopped  # the leak does not take the weight of its own words
    assert dec.fit(docs, [(0, " ".join(item), "")], counted).parts
    assert {r["doc_id"] for r in dec.contaminated(docs, bench).collect()} == set(range(held))


@pytest.mark.parametrize(("n_docs", "every"), [(300, 3), (40, 13)])
def test_item_in_many_documents(spark, n_docs, every):
    """An item in a third of all documents, or in 3 of 40, is found in each of them, whole or with a sixth of its words replaced."""
    rng = random.Random(7)
    hot, other = invented(rng, 30), invented(rng, 45)
    rows, truth = [], set()
    for d in range(n_docs):
        words = invented(rng, rng.randint(30, 200))
        if d % every == 1:
            own = list(hot)
            if d % (2 * every) == 1 and n_docs > 40:
                for k in rng.sample(range(len(own)), len(own) // 6):
                    own[k] = "".join(rng.choice("xyzq") for _ in range(5))
            at = rng.randrange(len(words))
            words[at:at] = own
            truth.add((d, 0))
        elif d % every == 2:  # a phrase of it is no leak
            words[10:10] = hot[3:9]
        elif d == 0:
            words[5:5] = other
            truth.add((d, 1))
        rows.append((d, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(hot)), (1, " ".join(other))], "item_id long, text string")
    got = [(r["doc_id"], r["item_id"]) for r in dec.contaminated(docs, bench).collect()]
    assert sorted(got) == sorted(truth)


def test_item_of_frequent_words(spark):
    """An item made only of words that every document has is found where it stands, as brute force over all windows finds it."""
    rng = random.Random(8)
    common = [f"w{i}" for i in range(60)]
    item, short = [rng.choice(common) for _ in range(24)], common[10:15]
    texts = [rng.choices(common, k=rng.randint(50, 150)) for _ in range(80)]
    for d in (4, 17, 30):
        texts[d][7:7] = item
    texts[31][9:9] = item[2:20]
    texts[40][:0] = short
    texts[41] += short[:4]
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(short))], "item_id long, text string")
    masks = {w.encode(): sum(1 << i for i, x in enumerate(item) if x == w) for w in item}
    width = len(item) + len(item) // 5 + 2
    best = [max(dec.common_subsequence([w.encode() for w in t[a : a + width]], masks, len(item)) for a in range(len(t))) / len(item) for t in texts]
    want = {(d, 0): s for d, s in enumerate(best) if s >= dec.MIN_LCS}
    want |= {(d, 1): 1.0 for d, t in enumerate(texts) if any(t[a : a + 5] == short for a in range(len(t)))}
    assert {(d, 0) for d in (4, 17, 30, 31)} | {(40, 1)} <= set(want)
    got = {(r["doc_id"], r["item_id"]): r["lcs"] for r in dec.contaminated(docs, bench).collect()}
    assert got == want


def test_nothing_to_search(planted):
    docs, bench, _ = planted
    assert dec.contaminated(docs.limit(0), bench).count() == 0
    assert dec.contaminated(docs, bench.limit(0)).count() == 0


def test_common_subsequence():
    def brute(a, b):
        dp = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                dp[i + 1, j + 1] = dp[i, j] + 1 if x == y else max(dp[i, j + 1], dp[i + 1, j])
        return dp[-1, -1]

    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.choice([b"p", b"q", b"r", b"s"]) for _ in range(rng.randint(1, 70))] for _ in range(2))
        masks = {}
        for i, w in enumerate(b):
            masks[w] = masks.get(w, 0) | 1 << i
        assert dec.common_subsequence(a, masks, len(b)) == brute(a, b)


def test_word_numbers():
    words = [b"alpha", b"beta", "gämma".encode()]
    ids = dec._Ids(words)
    hashes, lengths = dec.word_hashes([b"alpha beta,alpha", b"", "x gämma".encode()])
    assert lengths.tolist() == [3, 0, 2]
    assert ids(hashes)[[0, 1, 2, 4]].tolist() == [0, 1, 0, 2]
    assert ids(hashes)[3] >= 3
