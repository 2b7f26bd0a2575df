"""Keyed, time-based state in batch: sliding-log rate limit, expiring cache, keys.

State cannot outlive a pause as long as the window, so a key's events are first cut at such pauses (a
running window over the sorted key, nothing buffered); the pieces are dealt out again, so a busy key with
pauses is many small groups. A piece is folded in the order of its events as they stream by: the state is
the log of the last window alone, whatever the length of the piece.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _pieces(events: DataFrame, key: str, time: str, order: str, pause: float) -> DataFrame:
    """key, order, seconds (double), piece."""
    by = Window.partitionBy(key).orderBy("seconds", order)
    timed = events.select(key, order, (F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("seconds"))
    fresh = F.coalesce((F.col("seconds") - F.lag("seconds").over(by) >= pause).cast("int"), F.lit(1))
    return timed.withColumn("piece", F.sum(fresh).over(by.rowsBetween(Window.unboundedPreceding, 0)))


def _folded(pieces: DataFrame, key: str, order: str, fresh: Callable[[], Callable[[float], bool]], out: str) -> DataFrame:
    """key, order, seconds and a flag an event; fresh makes the fold of a new piece, a function of an event's time."""
    names, types = [key, order, "seconds", out], dict(pieces.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step = None, fresh()
        for batch in batches:
            flags = []
            for who, piece, seconds in zip(*(batch.column(i).to_pylist() for i in (0, 3, 2)), strict=True):
                if (who, piece) != last:
                    last, step = (who, piece), fresh()
                flags.append(step(seconds))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(flags, pa.bool_())], names=names)

    ordered = pieces.repartition(key, "piece").sortWithinPartitions(key, "piece", "seconds", order)
    return ordered.select(key, order, "seconds", "piece").mapInArrow(run, f"`{key}` {types[key]}, `{order}` {types[order]}, seconds double, `{out}` boolean")


def sliding_log(limit: int, window: float, log: list[float] | None = None) -> Callable[[float], bool]:
    """Whether the event at a time is allowed, event by event; .log is the state."""
    times = deque(log or ())

    def step(now: float) -> bool:
        while times and now - times[0] >= window:
            times.popleft()
        if len(times) >= limit:
            return False
        times.append(now)
        return True

    step.log = times
    return step


def expiring(ttl: float, expiry: float = float("-inf")) -> Callable[[float], bool]:
    """Whether the access at a time is a hit, access by access; .expiry() is the state."""

    def step(now: float) -> bool:
        nonlocal expiry
        if now < expiry:
            return True
        expiry = now + ttl
        return False

    step.expiry = lambda: expiry
    return step


def rate_limited(events: DataFrame, key: str, time: str, order: str, limit: int = 100, window: float = 60.0) -> DataFrame:
    """key, order, seconds, allowed. Allowed if fewer than limit allowed events lie less than window seconds back; refused ones do not count."""
    return _folded(_pieces(events, key, time, order, window), key, order, lambda: sliding_log(limit, window), "allowed")


def cache_hits(events: DataFrame, key: str, time: str, order: str, ttl: float = 3600.0) -> DataFrame:
    """key, order, seconds, hit. A miss stores the value for ttl seconds (0 means the default, 3600); a hit does not extend it."""
    ttl = ttl or 3600.0
    return _folded(_pieces(events, key, time, order, ttl), key, order, lambda: expiring(ttl), "hit")


def memoised(requests: DataFrame, computed: DataFrame, *keys: str) -> DataFrame:
    """Each different key is computed once and joined back; a null result is never kept as a hit."""
    return requests.join(computed.dropDuplicates(list(keys)), list(keys), "left")


def stored_results(requests: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], now: float, ttl: float, *keys: str) -> DataFrame:
    """requests with the results of their keys, from a table at path that outlives the session and from compute where it has none.

    A result is valid while now < expiry; compute gets the different keys without one and gives them with column value.
    What it gives is written with its expiry before it is used; a null value is not kept. A null key is computed every time.
    """
    spark = requests.sparkSession
    wanted = requests.select(*keys).distinct()
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    valid = spark.read.parquet(path).where(F.col("expiry") > now) if known else None
    misses = wanted if valid is None else wanted.join(valid, list(keys), "left_anti")
    fresh = compute(misses).where("value is not null").withColumn("expiry", F.lit(float(now + (ttl or 3600.0))))
    fresh.write.mode("append").parquet(path)
    held = spark.read.schema(fresh.schema).parquet(path).where(F.col("expiry") > now)
    return requests.join(held.groupBy(*keys).agg(F.max_by("value", "expiry").alias("value")), list(keys), "left")


def without_expired(path: str, into: str, now: float, spark: SparkSession) -> None:
    """The valid results of a table as a new one."""
    spark.read.parquet(path).where(F.col("expiry") > now).write.mode("overwrite").parquet(into)


def cache_key(args: Column, options: dict[str, Column]) -> Column:
    """md5 over the arguments and the sorted options, joined by a bar."""
    return F.md5(F.concat_ws("|", args, *[F.concat(F.lit(f"{k}="), v) for k, v in sorted(options.items())]))


def engine_key(engine: Column, languages: Column, options: dict[str, Column]) -> Column:
    """engine_lang-lang_option=value-...: languages sorted, only the options that change an instance, none: no last part."""
    relevant = [k for k in sorted(options) if k in ("confidence_threshold", "use_gpu", "use_angle_cls")]
    parts = [engine, F.array_join(F.array_sort(languages), "-")]
    if relevant:
        parts.append(F.concat_ws("-", *[F.concat(F.lit(f"{k}="), options[k].cast("string")) for k in relevant]))
    return F.concat_ws("_", *parts)
