"""SimHash components against all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from folioflow.llm import simhash
from folioflow.llm.graph import connected_components


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius):
    """value -> the set of values reachable."""
    values, left = set(values), set(values)
    out = {}
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= radius}
            left -= near
            todo += near
        out |= dict.fromkeys(group, frozenset(group))
    return out


def test_rows(docs, corpus):
    fps = [brute_fingerprint(t) for _, t, *_ in corpus]
    groups = brute_components(fps, 4)
    least = {}
    for (doc, *_), fp in zip(corpus, fps, strict=True):
        if doc is not None:
            least[groups[fp]] = min(doc, least.get(groups[fp], doc))
    want = [(doc, f"{fp:016x}", least.get(groups[fp])) for (doc, *_), fp in zip(corpus, fps, strict=True)]
    got = [tuple(r) for r in simhash.simhash_components(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert len({w[2] for w in want}) < len({w[1] for w in want})


@pytest.mark.parametrize(("rows", "passes"), [(1 << 22, 1 << 22), (176, 64)])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, rows, passes):
    """Planted chains at 1 to 5 bits; with 176 rows a bucket there are hundreds of buckets, with 64 variants a pass many passes."""
    monkeypatch.setattr(simhash, "BUCKET_ROWS", rows)
    monkeypatch.setattr(simhash, "PASS_VARIANTS", passes)
    rng = random.Random(9)
    values = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(120):
        x = rng.choice(values)
        for b in rng.sample(range(64), rng.randint(1, 5)):
            x ^= 1 << b
        values.append(x)
    signed = [(int(np.array(v, np.uint64).view(np.int64)),) for v in set(values)]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"), len(signed)).collect()
    own = {v: v for v in values}

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, b in links:
        a, b = a % (1 << 64), b % (1 << 64)
        own[find(a)] = find(b)
    groups = brute_components(values, 4)
    assert len({find(v) for v in values}) == len(set(groups.values()))
    assert all((find(a) == find(b)) == (groups[a] == groups[b]) for a in values[:60] for b in values)


@pytest.mark.parametrize("radius", [3, 4])
def test_truncated_variants_that_meet_lose_no_link(monkeypatch, radius):
    """Variants cut to a few bits meet others all the time; the links still connect what all pairs connect."""
    monkeypatch.setattr(simhash, "_spread", lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) & ~np.uint64((1 << 60) - 1))
    rng = random.Random(radius)
    values = [0, 0xFFF, 0xF, 0xFF] + [rng.getrandbits(64) for _ in range(8)]
    for _ in range(30):
        x = rng.choice(values)
        for b in rng.sample(range(64), rng.randint(1, 5)):
            x ^= 1 << b
        values.append(x)
    values = np.unique(np.array(values, dtype=np.uint64))
    links = [x for bucket in range(64) for x in simhash._links_in_bucket(values, bucket, 6, radius)]
    own = {int(v): int(v) for v in values}

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for left, right in links:
        assert (np.bitwise_count(left ^ right) <= radius).all()
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            own[find(a)] = find(b)
    groups = brute_components(own, radius)
    assert all((find(a) == find(b)) == (groups[a] == groups[b]) for a in own for b in own)


def test_members_near_each_other_but_not_the_first():
    """0 - 0xF - 0xFF - 0xFFF at radius 4: every neighbour is linked."""
    values = np.array([0, 0xF, 0xFF, 0xFFF], dtype=np.uint64)
    found = {frozenset((int(a), int(b))) for bucket in range(64) for x, y in simhash._links_in_bucket(values, bucket, 6, 4) for a, b in zip(x, y, strict=True)}
    assert found == {frozenset(p) for p in ((0, 0xF), (0xF, 0xFF), (0xFF, 0xFFF))}


@pytest.mark.parametrize("n", [10**5, 10**7, 10**8, 10**9])
def test_buckets_are_bounded(n):
    """What a bucket gets is counted on random fingerprints sent to it, and scaled to n."""
    bits = simhash._bucket_bits(n, 4)
    assert n * simhash._reached(4, bits) / 2**bits <= simhash.BUCKET_ROWS
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    used = np.unique(simhash._syndromes(simhash._flips(2), bits))
    buckets = (simhash._syndromes(values, bits)[:, None] ^ used[None, :]).ravel()
    assert len(buckets) == 200 * simhash._reached(4, bits)
    if bits > 12:  # sparse: a bucket gets a fingerprint or two of the 200, not a third of them
        assert np.bincount(buckets.astype(np.int64)).max() < 200 * 0.6


def test_components_of_chains_stars_and_loops(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 299), (299, 298), (298, 300)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), **dict.fromkeys((298, 299, 300), 298)}


def test_no_rows(empty):
    assert simhash.simhash_components(empty).count() == 0
    assert empty.select(F.lit(1)).count() == 0


@pytest.mark.parametrize("radius", [1, 3])
def test_odd_radius(spark, radius):
    """Pairs at exactly an odd radius are linked, pairs one bit further apart are not."""
    rng = random.Random(radius)
    near, far = [], []
    for out, bits in ((near, radius), (far, radius + 1)):
        for _ in range(20):
            x = rng.getrandbits(63)
            out.append((x, x ^ sum(1 << b for b in rng.sample(range(63), bits))))
    fps = spark.createDataFrame([(x,) for pair in near + far for x in pair], "fp long")
    links = {frozenset((r["a"], r["b"])) for r in simhash.fingerprint_links(fps, 80, radius).collect()}
    assert links == {frozenset(p) for p in near}
