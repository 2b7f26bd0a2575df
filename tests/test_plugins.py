"""Engines live once per worker, transient failures are tried again, a bad image is one row's error."""

import random

import numpy as np
import pytest

from folioflow.plans import plugins


def engines():
    """Made here, so that they are sent to the workers whole."""

    class Reader:
        def tokens(self, image):
            if image[0, 0] == 255:
                raise RuntimeError("unreadable")
            return [("t", 0.9, 0.0, 0.0, float(image.shape[1]), float(image.shape[0]))] * int(image[0, 0])

    class Finder:
        def boxes(self, image):
            return [("Card", 0.5, 0, 0, 3, 2)]

    return Reader, Finder


def test_rows_and_errors(spark):
    reader, finder = engines()
    images = spark.createDataFrame([(1, 2, 3, 1, bytearray([2] * 6)), (2, 2, 3, 1, bytearray([255] * 6)), (3, 2, 3, 1, bytearray([0] * 6)), (4, 2, 3, 1, None)], "doc_id long, height int, width int, channels int, data binary")
    got = plugins.recognised(images, "reader", reader).collect()
    assert [(r["doc_id"], r["ord"]) for r in got if r["error"] is None] == [(1, 1), (1, 2)]
    assert {r["doc_id"] for r in got if r["error"]} == {2, 4}
    assert plugins.detected(images.where("doc_id < 3"), "finder", finder).count() == 2


def test_transient_failures_are_tried_again():
    plugins.clear()
    calls = []

    def factory():
        calls.append(1)
        if len(calls) < 3:
            raise EOFError
        return "engine"

    assert plugins.live("k", factory, pause=0.0) == plugins.live("k", factory) == "engine"
    assert len(calls) == 3
    with pytest.raises(ValueError, match="no"):
        plugins.live("other", lambda: (_ for _ in ()).throw(ValueError("no")))


def test_seeding_leaves_generators_as_they_were():
    random.seed(1)
    np.random.seed(1)
    a = random.random(), np.random.rand()
    random.seed(1)
    np.random.seed(1)
    with plugins.seeded(5):
        inside = random.random(), np.random.rand()
    with plugins.seeded(5):
        assert inside == (random.random(), np.random.rand())
    assert a == (random.random(), np.random.rand())


def test_memory_limit_and_preload():
    plugins.clear()
    made = []

    def broken():
        raise ValueError("no model")

    assert plugins.preload({"a": lambda: made.append("a") or "A", "b": broken}) == ["b"]
    assert plugins.live("a", lambda: made.append("again")) == "A" and made == ["a"]
    assert plugins.live("c", lambda: "C", max_bytes=1) == "C"
    assert plugins.live("a", lambda: made.append("a") or "A2") == "A2"  # the limit let it go
    plugins.clear()
