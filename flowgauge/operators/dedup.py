"""Suppression of repeated trades."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowgauge.config import DedupConfig
from flowgauge.operators.tables import filled
from flowgauge.tables import stored

KEY = ("exchange", "symbol", "trade_id")


def first_of_each(rows: DataFrame, order: list[Column], key: tuple[str, ...] = KEY) -> DataFrame:
    """The first row of each key by ``order``; nulls in a key are equal.

    An aggregation with a partial step before the shuffle, so that a key that
    repeats without end costs one row a task.
    """
    others = [c for c in rows.columns if c not in key]
    if not others:
        return rows.distinct()
    best = F.min_by(F.struct(*[F.col(f"`{c}`") for c in others]), F.struct(*order)).alias("_row")
    return rows.groupBy(*key).agg(best).select(*key, "_row.*").select(*rows.columns)


def _get(b: pa.RecordBatch, name: str) -> list:
    return b.column(b.schema.get_field_index(name)).to_pylist()


def _keys(b: pa.RecordBatch, key: tuple[str, ...]) -> list[tuple]:
    return list(zip(*(_get(b, c) for c in key)))


class _Starts:
    """Suppression of one key's sorted times from every time at which it could start, all in one pass.

    What was kept before a range ends the wait of its first kept row at most a
    TTL after the range's first row: starts are the rows up to the first that is
    a TTL later. Passes that keep the same row are one from there on, so that no
    more are alive than there are different times within a TTL.
    """

    def __init__(self, ttl_ms: int, many: bool):
        self.ttl, self.many = ttl_ms, many
        self.starts: list[int] = []
        self.joined: list[int] = []  # the start that a start's pass has become one with
        self.alive: deque[tuple[int, int]] = deque()  # (last kept time, start)
        self.open = True

    def see(self, t: int) -> None:
        now = None
        if self.open:
            now = len(self.starts)
            self.starts.append(t)
            self.joined.append(now)
            self.open = self.many and t < self.starts[0] + self.ttl
        while self.alive and self.alive[0][0] + self.ttl <= t:
            start = self.alive.popleft()[1]
            if now is None:
                now = start
            else:
                self.joined[start] = now
        if now is not None:
            self.alive.append((t, now))

    def ends(self) -> tuple[list[int], list[int]]:
        """Each start, and the last time that its pass kept."""
        last = {start: t for t, start in self.alive}

        def root(k: int) -> int:
            while self.joined[k] != k:
                self.joined[k] = self.joined[self.joined[k]]
                k = self.joined[k]
            return k

        return self.starts, [last[root(k)] for k in range(len(self.starts))]


def within_ttl(rows: DataFrame, time_ms: str, ttl_ms: int, key: tuple[str, ...] = KEY, order: tuple[str, ...] = ()) -> DataFrame:
    """Keeps a row when none of its key was kept in the ``ttl_ms`` before; a suppressed row does not extend that.

    Of rows of one key and time the first by ``order`` stays, found before the
    shuffle. Rows without a time are dropped; nulls in a key are equal.

    A key may hold any share of the rows: these are dealt by ranges of (key,
    time). Only a range's first and last key reach beyond it; of these a sorted
    pass finds where suppression ends for each place at which it may start.
    Starts are linked to their successors, the first start at least a TTL after
    that end, and the links that lead on from a key's first row are followed by
    doubling: as many rounds as the logarithm of the number of ranges. Then
    every range runs from its own start.
    """
    spark = rows.sparkSession
    names = [f"`{c}`" for c in (*key, time_ms)]
    by = [F.col(c) for c in names]
    ties = [F.col(f"`{c}`") for c in order] or [F.lit(0)]
    each = first_of_each(rows.filter(by[-1].isNotNull()), ties, (*key, time_ms))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = T.StructType([*each.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_start", T.LongType()), T.StructField("_end", T.LongType())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def told(b: pa.RecordBatch, starts: list, ends: list) -> pa.RecordBatch:
            more = [pa.array([part] * b.num_rows, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())]
            return pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "_part", "_start", "_end"])

        at, one, runs, passes = None, None, 0, None

        def reach() -> pa.RecordBatch:
            starts, ends = passes.ends()
            return told(one.take(pa.array([0] * len(starts), pa.int32())), starts, ends)

        for b in batches:
            for n, (k, t) in enumerate(zip(_keys(b, key), _get(b, time_ms))):
                if k != at:
                    if runs == 1:  # the range's first key may go on from the range before
                        yield reach()
                    at, one, runs, passes = k, b.slice(n, 1), runs + 1, _Starts(ttl_ms, not runs)
                passes.see(int(t))
            yield told(b, [None] * b.num_rows, [None] * b.num_rows)
        if runs:
            yield reach()

    dealt = stored(each.repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(mark, held), "ttl")
    nodes = dealt.filter("_start is not null").select(F.struct(*by[:-1]).alias("_key"), "_part", "_start", "_end")
    # the first start of the key that comes a TTL after each end
    at = lambda time, kind, *more: nodes.select("_key", (-time).alias("_at"), F.lit(kind).alias("_kind"), *more)
    asked = at(F.col("_end") + ttl_ms, 1, "_start", F.lit(None).cast("long").alias("_next"))
    found = at(F.col("_start"), 0, F.lit(None).cast("long").alias("_start"), F.col("_start").alias("_next"))
    links = filled(asked.unionByName(found), ("_next",), ["_at", "_kind"], "_key").filter("_kind = 1").select("_key", "_start", "_next")
    jump = stored(links, "links")
    marked = stored(nodes.groupBy("_key").agg(F.min("_start").alias("_start")), "marked")
    while True:
        reached = marked.join(jump, ["_key", "_start"]).filter("_next is not null").select("_key", F.col("_next").alias("_start"))
        fresh = stored(reached.join(marked, ["_key", "_start"], "left_anti"), "reached")
        if fresh.isEmpty():
            break
        marked = stored(marked.unionByName(fresh), "marked")
        further = jump.select("_key", F.col("_start").alias("_next"), F.col("_next").alias("_far"))
        jump = stored(jump.join(further, ["_key", "_next"]).select("_key", "_start", F.col("_far").alias("_next")).filter("_next is not null"), "links")
    first = nodes.join(marked.withColumn("_from", F.col("_start")), ["_key", "_start"], "left").groupBy("_part", "_key").agg(F.min("_from").alias("_from"))
    # two keys for each range at most
    known = F.broadcast(first.select(F.col("_part").alias("_of"), "_key", "_from", F.lit(True).alias("_reaches")))
    same = (F.col("_part") == F.col("_of")) & (F.struct(*by[:-1]) == F.col("_key"))
    ready = dealt.filter("_start is null").drop("_start", "_end").join(known, same, "left").drop("_of", "_key")
    ready = ready.repartition("_part").sortWithinPartitions("_part", *by)
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, after = None, None
        for b in batches:
            keep = []
            for n, (part, k, t, start, reaches) in enumerate(zip(_get(b, "_part"), _keys(b, key), _get(b, time_ms), _get(b, "_from"), _get(b, "_reaches"))):
                if (part, k) != last_key:
                    last_key = part, k
                    after = t if not reaches else math.inf if start is None else start
                if t >= after:
                    after = t + ttl_ms
                    keep.append(n)
            yield b.select(columns).take(pa.array(keep, pa.int32()))

    return ready.mapInArrow(run, rows.schema)


def suppress(trades: DataFrame, config: DedupConfig, time_ms: str = "trade_time_ms") -> DataFrame:
    """Trades without those repeated within the settings' TTL, of rows of one key and time any one; all of them where it is off."""
    return within_ttl(trades, time_ms, config.ttl_ms) if config.enabled else trades
