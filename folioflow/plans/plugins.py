"""Plug-ins: recognisers, detectors and models as Python objects that live once per worker.

An engine is built on the worker, from a factory that is sent there, and kept by key; a transient failure is
tried again with growing pauses; a failure of one row is that row's error and stops nothing else.
"""

from __future__ import annotations

import contextlib
import os
import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class Engine(Protocol):
    """A text recogniser."""

    def tokens(self, image: np.ndarray) -> list[tuple[str, float, float, float, float, float]]:
        """text, confidence, x1, y1, x2, y2 of each token."""


class Detector(Protocol):
    """A detector of document classes or regions."""

    def boxes(self, image: np.ndarray) -> list[tuple[str, float, int, int, int, int]]:
        """class name, confidence, x1, y1, x2, y2 of each box."""


_LIVE: dict[str, object] = {}
TRANSIENT = (EOFError, ConnectionError, TimeoutError)


def resident_bytes() -> int:
    """What the worker's process holds in memory; 0 where that cannot be read."""
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    except (OSError, ValueError):
        return 0


def preload(factories: dict[str, Callable[[], object]]) -> list[str]:
    """Build objects before the first row asks for them; a worker has one task at a time, so no lock is needed. The keys that failed."""
    failed = []
    for key, factory in factories.items():
        try:
            live(key, factory)
        except Exception:  # noqa: BLE001  the rows that need it will say why
            failed.append(key)
    return failed


def live(key: str, factory: Callable[[], object], tries: int = 3, pause: float = 0.5, max_bytes: int | None = None) -> object:
    """The worker's object of that key, built on first use; up to `tries` times, pausing longer each time.

    With max_bytes a worker that holds more lets the other objects go before it builds one.
    """
    if max_bytes and key not in _LIVE and resident_bytes() > max_bytes:
        clear()
    for attempt in range(1, tries + 1):
        if key in _LIVE:
            break
        try:
            _LIVE[key] = factory()
        except TRANSIENT:
            if attempt == tries:
                raise
            time.sleep(pause * attempt)
    return _LIVE[key]


def clear() -> None:
    """Forget the worker's objects."""
    _LIVE.clear()


@contextlib.contextmanager
def seeded(seed: int) -> Iterator[None]:
    """Python's and NumPy's global generators run from the seed inside, and go on as before outside."""
    before = random.getstate(), np.random.get_state()
    random.seed(seed)
    np.random.seed(seed)
    try:
        yield
    finally:
        random.setstate(before[0])
        np.random.set_state(before[1])


def _image(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape((height, width) if channels == 1 else (height, width, channels))


def _each(images: DataFrame, key: str, factory: Callable[[], object], call: Callable[[object, np.ndarray], list[tuple]], names: tuple[str, ...], types: tuple[pa.DataType, ...], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, shape in enumerate(zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True)):
                began = time.perf_counter()
                try:
                    found = [(n, *r, None) for n, r in enumerate(call(live(key, factory), _image(*shape)), 1)]
                except Exception as e:  # noqa: BLE001  the row's error, whatever the engine raises
                    found = [(None, *[None] * (len(names) - 3), f"{type(e).__name__}: {e}")]
                each = (time.perf_counter() - began) / max(1, len(found))  # the rows of an image add up to its time
                found = [(*r, each) for r in found]
                rows += found
                at += [i] * len(found)
            if rows:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", *names])

    picked = images.select("doc_id", "height", "width", "channels", "data")
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, {schema}")


def recognised(images: DataFrame, key: str, factory: Callable[[], Engine]) -> DataFrame:
    """doc_id, ord, text, confidence, x1, y1, x2, y2, error, seconds: a row per token, or one with an error."""
    types = (pa.int32(), pa.string(), *[pa.float64()] * 5, pa.string(), pa.float64())
    return _each(images, key, factory, lambda e, x: e.tokens(x), ("ord", "text", "confidence", "x1", "y1", "x2", "y2", "error", "seconds"), types, "ord int, text string, confidence double, x1 double, y1 double, x2 double, y2 double, error string, seconds double")


def detected(images: DataFrame, key: str, factory: Callable[[], Detector]) -> DataFrame:
    """doc_id, ord, class_name, confidence, x1, y1, x2, y2, error, seconds: a row per box, or one with an error."""
    types = (pa.int32(), pa.string(), pa.float64(), *[pa.int32()] * 4, pa.string(), pa.float64())
    return _each(images, key, factory, lambda d, x: d.boxes(x), ("ord", "class_name", "confidence", "x1", "y1", "x2", "y2", "error", "seconds"), types, "ord int, class_name string, confidence double, x1 int, y1 int, x2 int, y2 int, error string, seconds double")
