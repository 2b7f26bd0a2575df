"""Keys that hold most events: folds stay linear, and give what a loop over all events gives."""

import random
import time
from collections import deque

import pytest
from pyspark.sql import functions as F

from folioflow.operators import state


@pytest.fixture(scope="module")
def busy(spark):
    """100,000 events of one key without a pause, and a few of others, also without a key."""
    rng = random.Random(2)
    rows, now = [], 0.0
    for i in range(100_000):
        now += rng.random()
        rows.append(("hot", i, now))
    rows += [(rng.choice(["a", "b", None]), 100_000 + i, float(rng.randrange(5000))) for i in range(300)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "key string, id long, s double").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long"))).repartition(8).cache()


def by_key(rows):
    out = {}
    for key, i, s in sorted(rows, key=lambda r: (int(r[2] * 1e6), r[1])):
        out.setdefault(key, []).append((i, int(s * 1e6) / 1e6))
    return out


def test_rate_limit_of_a_hot_key(busy):
    rows, events = busy
    want = set()
    for key, own in by_key(rows).items():
        log = deque()
        for i, now in own:
            while log and now - log[0] >= 60:
                log.popleft()
            if allowed := len(log) < 100:
                log.append(now)
            want.add((key, i, allowed))
    began = time.time()
    got = {tuple(r) for r in state.rate_limited(events, "key", "ts", "id").select("key", "id", "allowed").collect()}
    assert got == want
    assert time.time() - began < 60
    assert 0.5 < sum(a for *_, a in got) / len(got) < 0.95


def test_cache_of_a_hot_key(busy):
    rows, events = busy
    want = set()
    for key, own in by_key(rows).items():
        expiry = float("-inf")
        for i, now in own:
            hit = now < expiry
            if not hit:
                expiry = now + 30
            want.add((key, i, hit))
    got = {tuple(r) for r in state.cache_hits(events, "key", "ts", "id", 30.0).select("key", "id", "hit").collect()}
    assert got == want


def test_nothing_to_fold(busy):
    assert state.rate_limited(busy[1].limit(0), "key", "ts", "id").count() == 0
