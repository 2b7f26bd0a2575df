"""BPE, quality, licences, toxicity, archives."""

import json
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folioflow.llm import bpe, licenses, quality, toxicity, warc
from folioflow.llm.queries import tokenizer_path

from .conftest import WORDS, prose


@pytest.fixture(scope="module")
def automaton():
    return bpe.BpeAutomaton(json.load(open(tokenizer_path())))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("ab  \n'tsé日12!")), max_size=60))
def test_ids_and_texts_are_the_librarys(automaton, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    got = automaton.encode(text)
    assert got.tolist() == want
    assert automaton.decode(got) == library.decode(want, skip_special_tokens=False) == text


@pytest.mark.parametrize("text", ["a" * 3000, " " * 2000, "<|endoftext|>x<|endoftext|>", "the" * 900, "\n" * 50 + "x", "", "<|endoftext|"])
def test_long_and_special_texts(automaton, library, text):
    assert automaton.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_every_token_encodes_as_the_library_does(automaton, library):
    rng = random.Random(2)
    for i in rng.sample(range(len(automaton.labels)), 3000):
        word = automaton.labels[i].decode("utf-8", "ignore")
        assert automaton.encode(word).tolist() == library.encode(word, add_special_tokens=False).ids


def test_the_compiled_table_is_the_automaton(automaton):
    """Every state of a token against the gadgets' own rule, for tokens of every kind; the tables are a few MB."""
    spec = json.load(open(tokenizer_path()))
    vocab = spec["model"]["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    gadgets = bpe.Gadgets([i for t, i in vocab.items() if len(t) == 1], [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
    rng = random.Random(3)
    tokens = sorted(gadgets.state_of)
    pairs = [(rng.choice(tokens), rng.choice(tokens)) for _ in range(20_000)]
    pairs += [(gadgets.left[w], rng.choice(tokens)) for w in rng.sample(sorted(gadgets.left), 500)] + [(vocab[a], vocab[b]) for a, b in merges[::25]]
    for (u, v), found in zip(pairs, automaton.allowed(automaton.row[[u for u, _ in pairs]], np.array([v for _, v in pairs])).tolist(), strict=True):
        assert found == gadgets.allowed(gadgets.state_of[u], v)
    assert automaton.allowed(np.zeros(len(tokens), int), np.array(tokens)).all()
    assert automaton.table_bytes() < 24 << 20


def test_words_side_by_side_and_alone(automaton, library):
    """Many words of one length, few of them, and very long ones give the same ids."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.choice([1, 3, 5, 8, 9, 14, 60]))) for _ in range(1500)]
    raw = [w.encode() for w in words]
    many = automaton.encode_many(raw)
    assert many == [np.array(automaton.encode_word(w), "<u4").tobytes() for w in raw]
    assert [np.frombuffer(x, "<u4").tolist() for x in many] == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]


def test_the_narrow_split_is_the_plain_one():
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(chr(rng.choice([rng.randrange(256), 32, 39, 115, 10])) for _ in range(rng.randrange(30)))
        assert bpe._narrow().findall(text) == bpe._plain().findall(text)


def test_round_trip_rows(docs, corpus, empty):
    got = {(r["doc_id"], r["decoded"]) for r in bpe.bpe_round_trip(docs, tokenizer_path()).collect()}
    assert got == {(d, t or "") for d, t, *_ in corpus}
    digests = bpe.bpe_digests(docs, tokenizer_path())
    assert digests.count() == len(corpus)
    assert bpe.bpe_digests(empty, tokenizer_path()).count() == 0


def test_quality_measures(docs, corpus, empty):
    import re
    from collections import Counter

    want = []
    for doc, text, *_ in corpus:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        cut = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        counts, repeat = Counter(cut), [False] * len(words)
        for i, w in enumerate(cut):
            if counts[w] > 1:
                repeat[i : i + 8] = [True] * 8
        n = len(words)
        want.append((doc, n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, sum(repeat), n < 20 or 100 * sum(repeat) > 30 * n))
    rows = quality.quality_cascade(docs).collect()
    assert sorted(map(repr, (tuple(r)[:7] for r in rows))) == sorted(map(repr, want))
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert quality.quality_cascade(empty).count() == 0


def test_the_order_of_rules_changes_no_verdict():
    rng = random.Random(1)
    texts = [prose(rng, 60), "#$ " * 60, "LOUD " * 60, "no! " * 60, prose(rng, 30) + " a" * 30, ""]
    by = {r.name: r for r in quality.RULES}
    orders = [list(quality.RULES), list(reversed(quality.RULES)), [by[n] for n in quality.ordered_rules(quality.trials(texts))]]
    verdicts = [[quality.passes(quality.Measures(t), order) for t in texts] for order in orders]
    assert verdicts[0] == verdicts[1] == verdicts[2] == [True, False, False, False, False, True]


def test_costly_rules_that_reject_little_come_last():
    def slow(m):
        return sum(i for i in range(20000)) < 0

    rules = (quality.Rule("slow", slow), quality.Rule("quick", lambda m: True))
    assert quality.ordered_rules(quality.trials([" ".join(f"w{i}" for i in range(30)), "too short"] * 20, rules)) == ["quick", "slow"]


def test_licences(spark, docs, empty):
    mit = licenses.KNOWN["MIT"]
    variants = [mit, mit.upper(), mit.replace("<year> <copyright holders>", "2019 Someone"), mit.replace('"', "“"), "\n".join(f" * {x}" for x in mit.split("\n")), mit.partition("\n")[2], mit.replace("sublicense", "sub-license").replace("License", "Licence")]
    others = [mit + " and more", "Permission is hereby granted", "", None, "Copyright (c) 2020 A"]
    rows = [(i, t) for i, t in enumerate(variants + others + list(licenses.KNOWN.values()))]
    got = {r["doc_id"]: r["license_id"] for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = len(variants)
    assert all(got[i] == "MIT" for i in range(n)), got
    assert all(got[n + i] is None for i in range(len(others)))
    assert [got[n + len(others) + i] for i in range(len(licenses.KNOWN))] == list(licenses.KNOWN)
    assert licenses.license_scan(docs).count() == docs.count()
    assert licenses.license_scan(empty).count() == 0
    plan = licenses.license_scan(docs)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_licences_in_other_dresses(spark):
    """List marks, the rights line, a year behind a name, wrapped lines that begin with the word copyright, spellings side by side."""
    bsd = licenses.KNOWN["BSD-2-Clause"]
    wrapped = bsd.replace("the above copyright notice", "the above\ncopyright notice").replace("BY THE COPYRIGHT", "BY THE\nCOPYRIGHT")
    forms = [bsd, bsd.replace("1. ", "* ").replace("2. ", "* "), bsd.replace("1. ", "(a) ").replace("2. ", "(b) "), bsd.replace("<owner>", "<owner>\nAll rights reserved."), bsd.replace("Copyright (c) <year>, <owner>", "Copyright Jane Doe 2015"), wrapped]
    rows = [(i, t) for i, t in enumerate(forms)] + [(100, "Licence licence."), (101, "license license"), (102, "per cent per cent licences"), (103, "percent percent LICENSES"), (104, bsd.replace("source", "sauce"))]
    got = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["license_id"] for i in range(len(forms))] == ["BSD-2-Clause"] * len(forms)
    assert got[100]["digest"] == got[101]["digest"] and got[102]["digest"] == got[103]["digest"]
    assert got[104]["license_id"] is None


def test_long_licences(spark):
    """The fixed digests are those of the published texts, where this machine has them."""
    import os

    folder = "/usr/share/common-licenses"
    names = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0"}
    rows = [(n, open(f"{folder}/{f}", encoding="utf-8").read()) for n, f in names.items() if os.path.exists(f"{folder}/{f}")]
    if not rows:
        pytest.skip("no licence texts here")
    got = {r["doc_id"]: r["license_id"] for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {n: n for n, _ in rows}


@pytest.fixture(scope="module")
def graded(spark):
    """Toxic texts by whole words in one language and word beginnings in another; a tenth of the labels cover nothing."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(1500):
        words = [rng.choice(WORDS) for _ in range(rng.randint(30, 120))]
        toxic = i % 9 == 0
        if toxic:
            for _ in range(rng.randint(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "rotten", "foul"]) if i % 2 else rng.choice(["grubl", "snivv"]) + rng.choice(["é", "ando", "ment", "ly"]))
        rows.append((i, " ".join(words)))
        if i % 5 < 3:
            labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_toxicity(graded):
    import zlib

    docs, labels = graded
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert len(got) == 1500
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    unseen = [r for i, r in got.items() if r["held_out"]]
    hits = [r["predicted"] == (r["doc_id"] % 9 == 0) for r in unseen]
    assert np.mean(hits) > 0.99
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    assert {r["doc_id"] for r in toxicity.without_toxic(docs, labels).collect()} == {i for i, r in got.items() if not r["predicted"]}


def test_labels_of_held_out_rows_change_nothing(spark, graded):
    docs, labels = graded
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(labels["doc_id"]), 1 - labels["toxic"]).otherwise(labels["toxic"]))
    one, other = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert one.terms == other.terms
    assert (one.weights == other.weights).all() and one.bias == other.bias
    scores = [{r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, x).collect()} for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_toxicity_of_odd_rows(docs, corpus, empty, graded):
    labels = graded[1]
    rows = toxicity.toxicity_scores(docs, labels).collect()
    assert len(rows) == len(corpus)
    assert all(r["score"] is not None for r in rows)
    none = toxicity.toxicity_scores(docs, labels.limit(0)).collect()
    assert {r["predicted"] for r in none} == {0}
    assert toxicity.toxicity_scores(empty, labels).count() == 0


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string")


def test_archives(spark):
    import base64
    import hashlib

    bodies = ["<p>one</p>", "<p>two é</p>", None, "", "<p>one</p>" * 50, "\r\n\r\nWARC/1.1\r\n", "<p>one</p>"]
    rows = [(i, f"http://x/{i}\r\nInjected: 1", bodies[i % len(bodies)], "clash") for i in range(40)] + [(100, None, None, None)]
    rows += [(200 + i, "u", f"<p>{i}</p>" * 300, None) for i in range(200)]
    least = {}
    for i, _, b, _ in rows:
        least.setdefault(b or "", i)
    got = warc.warc_round_trip(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r["page_id"]: r for r in got}
    for i, _, b, _ in rows:
        body = (b or "").encode()
        r = by_id[i]
        first = least[b or ""]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i == first else ("revisit", first))
        assert (bytes(r["payload"]) == body) if i == first else r["payload"] is None
    assert warc.warc_round_trip(pages(spark, [])).count() == 0
    assert warc.warc_round_trip(pages(spark, rows).where("page_id < 0")).count() == 0
    small = warc.warc_round_trip(pages(spark, [(1, "u", "ab", None), (2, "u", "ab", None), (3, "u", "abc", None), (4, "u", "abc", None)]), 3).collect()
    assert {(r["page_id"], r["record_type"]) for r in small} == {(1, "response"), (2, "response"), (3, "response"), (4, "revisit")}


def archive(dictionary=b"", records=None):
    import zstandard

    records = records or [warc.record("response", 1, "u", b"hello", None), warc.record("revisit", 2, "u", b"hello", 1)]
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    return (warc.frame_dictionary(dictionary) if dictionary else b"") + b"".join(map(c.compress, records))


def test_archive_with_and_without_dictionary():
    import zstandard

    plain = bytes(range(256)) * 8
    for data in (archive(), archive(plain), warc.frame_dictionary(zstandard.compress(plain)) + archive(plain)[8 + len(plain) :]):
        kinds = [(r["fields"]["warc-type"], r["payload"], r["payload_bytes"]) for r in warc.read_archive(data)]
        assert kinds == [("response", b"hello", 5), ("revisit", b"", 5)]


@pytest.mark.parametrize(
    "bad",
    [
        archive()[:-3],
        archive() + b"junk",
        archive(records=[warc.record("response", 1, "u", b"hello", None).replace(b"hello", b"jello")]),
        archive(records=[warc.record("response", 1, "u", b"hello", None)[:-2]]),
        archive(records=[warc.record("response", 1, "u", b"hello", None).replace(b"WARC-Date", b"WARC-Dote")]),
        archive(records=[warc.record("response", 1, "u", b"hello", None).replace(b"WARC/1.1", b"WORC/1.1")]),
        b"abc",
    ],
)
def test_damaged_archives_are_refused(bad):
    with pytest.raises(ValueError, match="."):
        list(warc.read_archive(bad))


def test_rules_are_timed_where_the_rows_are(spark):
    """The sample has the rows that pass the base, in sums; a row that repeats a hundred times is sampled like any other."""
    rows = [(1, " ".join(f"w{i}" for i in range(30)))] * 100 + [(i, "short") for i in range(50)] + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = quality._tried(quality.id_and_text(docs), quality.RULES, 10_000)
    assert {n: x[:2] for n, x in found.items()} == {r.name: [100, 0] for r in quality.RULES}
    some = quality._tried(quality.id_and_text(docs), quality.RULES, 15)
    assert all(x[0] < 40 for x in some.values())
    assert set(quality._tried(quality.id_and_text(docs.limit(0)), quality.RULES, 15)) == {r.name for r in quality.RULES}


def test_few_labelled_rows_are_a_bound(graded):
    """With more labels than the bound, the fit stays under it and still learns."""
    docs, labels = graded
    assert toxicity.fit(docs, labels, 150).terms


def test_toxicity_is_fitted_on_every_row(spark, monkeypatch):
    """Of more labelled and unlabelled rows than a sample would have, all that are not held out are in the label model."""
    n, weights, label_model = 80_000, [], toxicity.label_model
    monkeypatch.setattr(toxicity, "label_model", lambda votes, weight, *more: weights.append(weight.sum()) or label_model(votes, weight, *more))
    docs = spark.range(n).selectExpr("id doc_id", "if(id % 9 = 0, concat('vile word', id), concat('fine word', id)) text")
    labels = spark.range(n).where("id % 2 = 0").selectExpr("id doc_id", "cast(id % 9 = 0 as int) toxic")
    assert toxicity.fit(docs, labels).terms
    assert weights == [docs.where(~toxicity.held_out(docs["doc_id"])).count()]


def test_the_threshold_makes_the_fewest_errors():
    """Also where nothing is better taken for toxic, and with rows that stand for many documents."""
    at = np.log(toxicity.THRESHOLD / (1 - toxicity.THRESHOLD))
    logit, one = np.array([0.0, 1.0, 2.0, 3.0]), np.ones(4)
    assert toxicity.threshold_shift(logit, one, np.array([0, 0, 1, 1])) == pytest.approx(at - 1.5)
    assert (logit + toxicity.threshold_shift(logit, one, np.array([1, 0, 0, 0])) < at).all()
    assert (logit + toxicity.threshold_shift(logit, one, np.array([1, 1, 1, 1])) > at).all()
    assert toxicity.threshold_shift(logit, np.array([1, 9, 1, 1.0]), np.array([0, 1, 0, 1])) == pytest.approx(at - 0.5)
    assert (np.zeros(4) + toxicity.threshold_shift(np.zeros(4), one, np.array([0, 0, 0, 1])) < at).all()


def test_the_label_model_counts_what_two_voters_share_once():
    """Copies of a voter do not outvote the others, however many there are; the tree knows them."""
    rng = np.random.default_rng(3)
    y = rng.random(6000) < 0.3
    vote = lambda hit, chance: np.where(rng.random(6000) < np.where(y, hit, chance), 1, -1)
    a, b, c = vote(0.85, 0.1), vote(0.8, 0.15), vote(0.85, 0.2)
    one = toxicity.label_model(np.stack([a, b, c], axis=1), np.ones(6000), 0.3)
    copies = [toxicity.label_model(np.stack([a, b, *[c] * k], axis=1), np.ones(6000), 0.3) for k in (2, 3)]
    assert ((one > 0.5) == y).mean() > 0.92 and all(((x > 0.5) == y).mean() > 0.9 for x in copies)
    assert np.abs(copies[0] - copies[1]).max() < 0.05  # a third copy says hardly anything new
    tree = toxicity.correlation_tree(np.stack([a, b, c, c], axis=1) + 1, np.ones(6000), y.astype(float))
    assert tree[2] == 3 or tree[3] == 2


def test_archives_of_any_ids(spark, tmp_path):
    """Strings with blanks, line ends and nothing in them, and nulls, come back; a path without a scheme is the readers'."""
    ids = ["a", " b ", "c\r\nd", "", None, "é%20"]
    pages = spark.createDataFrame([(x, f"http://{i}", "same" if i < 3 else f"own {i}") for i, x in enumerate(ids)], "page_id string, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["url"]) for r in warc.warc_round_trip(pages, path=str(tmp_path / "w")).collect()}
    assert got == {x: ("revisit" if i in (0, 2) else "response", " b " if i in (0, 2) else None, f"http://{i}") for i, x in enumerate(ids)}
    assert [r["page_id"] for r in warc.warc_round_trip(spark.createDataFrame([(7, "u", "h")], "page_id int, url string, html string")).collect()] == [7]
