"""The EWMA recurrence on unbounded input: keyed state in the state store.

A symbol's rows, trades and changes of its settings, go into a buffer in its
state as sorted runs of bounded size. With a ``delay``, a timer at the buffer's
earliest time releases what the watermark has passed, in order of event time,
whatever the order of arrival; without one, what a trigger brought is released
at its end. Released runs are merged as streams, so that a symbol may hold any
share of a trigger's rows: a task holds a run of each stream and no more.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowgauge import schemas
from flowgauge.config import ScorerConfig
from flowgauge.functions import scalars as S
from flowgauge.operators.dedup import KEY

STATE = "ewma double, ewma_var double, trade_count long, z_threshold double, ewma_alpha double, min_trades int"
#: Rows of a run in the buffer, and of a frame that goes on.
RUN_ROWS, FRAME_ROWS = 2_000, 10_000
#: What a buffered row holds; the first three are its order. A change (kind 0) comes before the trades of its time (kind 1).
ROW = ("at_ms", "kind", "id", "signed_ofi", "side", "quantity", "price", "z_threshold", "ewma_alpha", "min_trades")
SCORED = schemas.SCORE + ", z_threshold double, min_trades int, is_toxic boolean, late boolean"
OUT = [c.split()[0] for c in SCORED.split(", ")]


#: The order of rows: (at_ms, kind, id).
IN_ORDER = itemgetter(0, 1, 2)


def _plain(frame: pd.DataFrame, columns: tuple[str, ...]) -> list[tuple]:
    """A frame's rows without pandas' stand-ins for null, column by column."""
    given = lambda c: c.astype(object).where(c.notna(), None) if c.hasnans else c
    return list(zip(*(given(frame[c]).tolist() for c in columns)))


class OrderedProcessor(StatefulProcessor):
    """Takes a key's rows in order: in that of event time as the watermark passes, or in that of a trigger at its end.

    Rows are tuples of ``columns``, the first three of which are their order:
    (at_ms, kind, id). What is done with them is the subclass's: ``begin`` loads
    its state, ``take`` gives a row of ``out`` or None, ``end`` stores the state;
    ``late`` gives a row for one that the watermark has passed already.
    """

    columns: tuple[str, ...]
    out: list[str]

    def __init__(self, ordered: bool):
        self.ordered = ordered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getMapState("runs", "number long", "first long, last long")
        self.rows = handle.getMapState("rows", "number long", "rows binary")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def begin(self) -> None:
        raise NotImplementedError

    def take(self, key: tuple, row: tuple) -> tuple | None:
        raise NotImplementedError

    def end(self) -> None:
        raise NotImplementedError

    def late(self, key: tuple, row: tuple) -> tuple | None:
        raise NotImplementedError

    def idle(self, passed: int) -> int | None:
        """What to do when a timer finds no rows waiting; a later time to be called again, if any."""
        return None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() if self.ordered else None
        number = 1 + max((k[0] for k in self.runs.keys()), default=-1)
        for frame in rows:
            found = sorted(_plain(frame, self.columns), key=IN_ORDER)
            if self.ordered:
                late = [r for r in found if r[0] <= passed]
                found = found[len(late) :]
                said = [o for o in (self.late(key, r) for r in late) if o is not None]
                if said:
                    yield pd.DataFrame(said, columns=self.out)
            for k in range(0, len(found), RUN_ROWS):
                self._put(number, found[k : k + RUN_ROWS])
                number += 1
        if self.ordered:
            self._wait()
        else:
            yield from self._release(key, math.inf)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        yield from self._release(key, passed)
        if not self._wait():
            again = self.idle(passed)
            if again is not None:
                self.handle.registerTimer(again)

    def _put(self, number: int, run: list[tuple]) -> None:
        self.runs.updateValue((number,), (run[0][0], run[-1][0]))
        self.rows.updateValue((number,), (pickle.dumps(run),))

    def _wait(self) -> bool:
        """A timer at the earliest time in the buffer; whether there is one."""
        first = min((v[0] for _, v in self.runs.iterator()), default=None)
        if first is not None:
            self.handle.registerTimer(first)
        return first is not None

    def _read(self, lane: list[int], until: float) -> Iterator[tuple]:
        """The rows up to ``until`` of runs that follow each other; they leave the buffer."""
        for number in lane:
            run = pickle.loads(bytes(self.rows.getValue((number,))[0]))
            self.runs.removeKey((number,))
            self.rows.removeKey((number,))
            rest = [r for r in run if r[0] > until]
            if rest:
                self._put(number, rest)
            yield from run[: len(run) - len(rest)]

    def _release(self, key: tuple, until: float) -> Iterator[pd.DataFrame]:
        lanes, ends = [], []
        for first, last, number in sorted((v[0], v[1], k[0]) for k, v in self.runs.iterator() if v[0] <= until):
            if ends and ends[0][0] < first:
                lane = heapq.heappop(ends)[1]
            else:
                lane = len(lanes)
                lanes.append([])
            lanes[lane].append(number)
            heapq.heappush(ends, (last, lane))
        if not lanes:
            return
        self.begin()
        out = []
        for r in heapq.merge(*(self._read(lane, until) for lane in lanes), key=IN_ORDER):
            made = self.take(key, r)
            if made is not None:
                out.append(made)
            if len(out) == FRAME_ROWS:
                yield pd.DataFrame(out, columns=self.out)
                out = []
        self.end()
        if out:
            yield pd.DataFrame(out, columns=self.out)

    def close(self) -> None:
        pass


class ScoreProcessor(OrderedProcessor):
    """One symbol's mean, variance, count and settings."""

    columns, out = ROW, OUT

    def __init__(self, epsilon: float, ordered: bool):
        super().__init__(ordered)
        self.epsilon = epsilon

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ewma", STATE)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self.state.update((float(r["ewma"]), float(r["ewma_var"]), int(r["trade_count"]), None, None, None))

    def begin(self) -> None:
        self.now = self.state.get() if self.state.exists() else (0.0, 0.0, 0, None, None, None)

    def end(self) -> None:
        self.state.update(self.now)

    def take(self, key: tuple, r: tuple) -> tuple | None:
        mean, var, n, *settings = self.now
        if not r[1]:
            settings = [old if new is None else new for new, old in zip(r[7:], settings)]
            self.now = (mean, var, n, *settings[:2], None if settings[2] is None else int(settings[2]))
            return None
        threshold, alpha, least = settings
        x, a = r[3], r[8] if alpha is None else alpha
        if n == 0:
            mean, var = x, 0.0
        else:
            d = x - mean
            mean, var = a * x + (1 - a) * mean, a * (d * d) + (1 - a) * var
        n += 1
        self.now = (mean, var, n, *settings)
        z = 0.0 if n == 1 else mean / math.sqrt(max(var, self.epsilon))
        limit, warm = r[7] if threshold is None else threshold, int(r[9] if least is None else least)
        return self._row(key[0], r, z, mean, var, n, limit, warm, n >= warm and abs(z) >= limit)

    def late(self, key: tuple, r: tuple) -> tuple | None:
        return self._row(key[0], r, late=True) if r[1] else None

    @staticmethod
    def _row(symbol, r, z=None, mean=None, var=None, n=None, limit=None, warm=None, toxic=None, late=False) -> tuple:
        return (symbol, r[2], z, mean, var, n, r[3], *r[4:7], r[0], limit, warm, toxic, late)


class TtlProcessor(OrderedProcessor):
    """One key's last kept time; it is forgotten once the watermark is a TTL past it, so that the state holds no more than recent keys."""

    columns, out = ("at_ms", "kind", "id", "row"), ["row"]

    def __init__(self, ttl_ms: int, ordered: bool):
        super().__init__(ordered)
        self.ttl = ttl_ms

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("kept", "at_ms long")

    def begin(self) -> None:
        self.kept = self.state.get()[0] if self.state.exists() else None

    def end(self) -> None:
        self.state.update((self.kept,))
        if self.ordered:
            self.handle.registerTimer(self.kept + self.ttl)

    def take(self, key: tuple, r: tuple) -> tuple | None:
        if self.kept is not None and r[0] - self.kept < self.ttl:
            return None
        self.kept = r[0]
        return (r[3],)

    def late(self, key: tuple, r: tuple) -> tuple | None:
        return None

    def idle(self, passed: int) -> int | None:
        if not self.state.exists():
            return None
        end = self.state.get()[0] + self.ttl
        if passed >= end:
            self.state.clear()
            return None
        return end


def score_stream(
    trades: DataFrame,
    config: ScorerConfig | None = None,
    configs: DataFrame | None = None,
    initial: DataFrame | None = None,
    changes: DataFrame | None = None,
    delay: str | None = None,
) -> DataFrame:
    """A stream of trades to scores (schema SCORED) with ``is_toxic``. Needs the RocksDB state store.

    ``configs``, a static table, may give symbols settings of their own;
    ``initial`` (schema SCORER_STATE, a row a symbol) is what the stream's first
    batch starts from. ``changes(symbol, at_ms, change_id, z_threshold,
    ewma_alpha, min_trades)`` is a stream of settings that change while it runs,
    with the meaning that they have in ``settings_as_of``: the states of a
    symbol's settings and of its scores are one, and no other symbol is touched.

    With a ``delay`` rows are taken in order of event time, changes before the
    trades of their time, once the watermark (the latest time seen, less the
    delay) has passed them; trades that come after that are ``late``: they have
    no score and don't advance the state. Without one, rows are ordered within a
    trigger, and across triggers the order of arrival counts. A row without a
    time counts as of time 0, and so is late with a delay. State and offsets are committed together, so a
    restart scores no trade twice.
    """
    config = config or ScorerConfig()
    named = trades.withColumn("symbol", S.upper_symbol(F.col("symbol")))
    threshold, alpha, least = F.coalesce(*[F.when(F.col("symbol") == s, F.lit(float(t))) for s, t in config.thresholds.items()], F.lit(float(config.threshold))), F.lit(config.alpha), F.lit(config.min_trades)
    if configs is not None:
        own = configs.select("symbol", *[F.col(c).alias(f"_{c}") for c in ("z_threshold", "ewma_alpha", "min_trades") if c in configs.columns])
        named = named.join(own, "symbol", "left")
        given = lambda c, other: F.coalesce(f"_{c}", other) if c in configs.columns else other
        threshold, alpha, least = given("z_threshold", threshold), given("ewma_alpha", alpha), given("min_trades", least)
    moment = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias("at_ms")
    rows = named.select(
        "symbol",
        moment("trade_time_ms"),
        F.lit(1).alias("kind"),
        F.col("trade_id").cast("long").alias("id"),
        S.signed_ofi(F.col("side"), F.col("quantity"), F.col("price")).alias("signed_ofi"),
        *("side", "quantity", "price"),
        threshold.alias("z_threshold"),
        alpha.alias("ewma_alpha"),
        least.cast("int").alias("min_trades"),
    )
    if changes is not None:
        said = changes.select(
            S.upper_symbol(F.col("symbol")).alias("symbol"), moment("at_ms"), F.lit(0).alias("kind"), F.col("change_id").cast("long").alias("id"),
            *("z_threshold", "ewma_alpha", "min_trades"),
        )
        rows = rows.unionByName(said, allowMissingColumns=True)
    if delay is not None:
        # the time itself goes no further: Spark would drop late rows, which are to be told of
        rows = rows.withColumn("event_time", F.timestamp_millis("at_ms")).withWatermark("event_time", delay).drop("event_time")
    ready = rows.filter("symbol <> ''")
    start = None if initial is None else initial.withColumn("symbol", S.upper_symbol(F.col("symbol"))).groupBy("symbol")
    mode = "None" if delay is None else "EventTime"
    return ready.groupBy("symbol").transformWithStateInPandas(
        ScoreProcessor(config.epsilon, delay is not None), SCORED, outputMode="append", timeMode=mode, initialState=start
    )


def dedup_stream(trades: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream without repeated (exchange, symbol, trade_id) within ``delay`` of event time. Rows later than that are dropped."""
    timed = trades.withColumn("event_time", F.timestamp_millis("trade_time_ms")).withWatermark("event_time", delay)
    return timed.dropDuplicatesWithinWatermark(["exchange", "symbol", "trade_id"])


def ttl_stream(trades: DataFrame, ttl_ms: int, key: tuple[str, ...] = KEY, time_ms: str = "trade_time_ms", order: str = "trade_id", delay: str | None = None) -> DataFrame:
    """A stream of rows of which none of its key was kept in the ``ttl_ms`` before; a suppressed row does not extend that.

    As ``within_ttl``, of rows of one key and time the first by ``order``, a
    whole number. With a ``delay`` rows are taken in order of event time, and
    those that come after the watermark has passed them are dropped; without
    one, in the order of arrival. Rows without a time are dropped. All columns
    are kept. Needs the RocksDB state store.
    """
    packed = trades.filter(F.col(time_ms).isNotNull()).select(
        F.struct(*[F.col(f"`{c}`") for c in key]).alias("key"),
        F.col(time_ms).cast("long").alias("at_ms"),
        F.lit(1).alias("kind"),
        F.coalesce(F.col(order).cast("long"), F.lit(0).cast("long")).alias("id"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in trades.columns])).alias("row"),
    )
    if delay is not None:
        packed = packed.withColumn("event_time", F.timestamp_millis("at_ms")).withWatermark("event_time", delay).drop("event_time")
    # nulls in a key are equal
    rows = packed.select("*", F.to_json("key", {"ignoreNullFields": "false"}).alias("of")).drop("key").groupBy("of")
    mode = "None" if delay is None else "EventTime"
    kept = rows.transformWithStateInPandas(TtlProcessor(ttl_ms, delay is not None), "row string", outputMode="append", timeMode=mode)
    return kept.select(F.inline(F.array(F.from_json("row", trades.schema))))
