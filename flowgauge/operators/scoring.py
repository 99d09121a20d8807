"""EWMA toxicity scores: a recurrence over each symbol's trades in order of time.

    mean' = a x + (1 - a) mean        var' = a (x - mean)^2 + (1 - a) var

One symbol may hold any share of the trades, so its history is cut into chunks.
Over a chunk the new mean is linear in the old one, and the new variance is
linear in the old one and quadratic in how far the old mean lies from the
chunk's first value: a first pass sums up each chunk in six numbers, those are
composed along each symbol, and a second pass runs every chunk from the state
that it starts with. Distances from the first value keep flow of one size from
cancelling: there they are zero, however large the values.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowgauge.config import ScorerConfig
from flowgauge.functions import scalars as S
from flowgauge.operators.tables import filled, previous
from flowgauge.tables import stored

ORDER = ("trade_time_ms", "trade_id")
STATE = "symbol string, chunk long, ewma double, ewma_var double, trade_count long"
FINAL = "symbol string, ewma double, ewma_var double, trade_count long"


def config_table(spark: SparkSession, config: ScorerConfig) -> DataFrame:
    """The configured thresholds as rows of symbol_configs."""
    rows = [(s, t, config.alpha, config.min_trades) for s, t in sorted(config.thresholds.items())]
    return spark.createDataFrame(rows, "symbol string, z_threshold double, ewma_alpha double, min_trades int")


def _run(x: np.ndarray, alpha: np.ndarray, mean: float, var: float, n: int) -> tuple[list, list]:
    """Means and variances after each value, from a state of ``n`` trades."""
    means, variances = [], []
    for v, a in zip(x.tolist(), alpha.tolist()):
        if n == 0:
            mean, var = v, 0.0
        else:
            d = v - mean
            mean, var = a * v + (1 - a) * mean, a * (d * d) + (1 - a) * var
        n += 1
        means.append(mean)
        variances.append(var)
    return means, variances


def _summary(x: np.ndarray, alpha: np.ndarray, now: tuple[float, ...]) -> tuple[float, ...]:
    """(a, b, p, q, r) after each value from ``now``, at a chunk's start (1, x[0], 0, 0, 0): with u = mean - x[0], mean' = a u + b and var' = a var + p + q u + r u^2."""
    a, b, p, q, r = now
    for v, w in zip(x.tolist(), alpha.tolist()):
        d, keep = v - b, 1 - w
        p, q, r = w * (d * d) + keep * p, keep * q - 2 * w * d * a, keep * r + w * (a * a)
        # a mean that equals the value stays as it is
        a, b = keep * a, w * v + keep * b if d else b
    return a, b, p, q, r


def _compose(group: pd.DataFrame) -> pd.DataFrame:
    """The state with which each chunk of a symbol starts. A symbol's first trade starts from itself."""
    group = group.sort_values("chunk")
    mean, var, n, out = 0.0, 0.0, 0, []
    for c in group.itertuples(index=False):
        if c.chunk < 0:  # a restored state
            mean, var, n = c.first, c.p, c.n
            continue
        out.append((c.symbol, c.chunk, mean, var, n))
        u = 0.0 if n == 0 else mean - c.first
        mean, var, n = c.a * u + c.b, max(0.0, c.a * var + c.p + (c.q + c.r * u) * u), n + c.n
    return pd.DataFrame(out, columns=["symbol", "chunk", "ewma", "ewma_var", "trade_count"])


def _prepared(trades: DataFrame, config: ScorerConfig, configs: DataFrame | None) -> DataFrame:
    """Trades with ``signed_ofi``, ``_alpha``, upper-case symbol; blank symbols are skipped."""
    named = trades.withColumn("symbol", S.upper_symbol(F.col("symbol"))).filter("symbol <> ''")
    alpha = F.lit(config.alpha)
    if configs is not None:
        named = named.join(configs.select("symbol", F.col("ewma_alpha").alias("_own")), "symbol", "left")
        alpha = F.coalesce("_own", alpha)
    elif "ewma_alpha" in trades.columns:  # settings as of each trade
        alpha = F.coalesce("ewma_alpha", alpha)
    return named.withColumn("_alpha", alpha).drop("_own").withColumn(
        "signed_ofi", S.signed_ofi(F.col("side"), F.col("quantity"), F.col("price"))
    )


def _numbers(b: pa.RecordBatch) -> list[np.ndarray]:
    """A batch's ``signed_ofi`` and ``_alpha``."""
    return [b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in ("signed_ofi", "_alpha")]


def _cut(rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cuts a sorted stream into chunks of one symbol and ``rows`` rows at most, each with its number and, in its last row, its summary.

    A task holds a batch, whatever the size of a chunk.
    """
    kind = pa.struct([("n", pa.int64()), *[(c, pa.float64()) for c in ("first", *"abpqr")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, last, size, at, first, now = TaskContext.get().partitionId(), 0, None, 0, None, 0.0, ()

        def told(ends: bool) -> pa.RecordBatch:
            summary = {"n": size, "first": first, **dict(zip("abpqr", now))} if ends else None
            more = [pa.array(np.full(last.num_rows, part << 33 | number)), pa.array([None] * (last.num_rows - 1) + [summary], kind)]
            return pa.RecordBatch.from_arrays([*last.columns, *more], names=[*last.schema.names, "chunk", "_summary"])

        for b in batches:
            names = b.column(b.schema.get_field_index("symbol"))
            edges = [0, *(np.flatnonzero(np.diff(names.dictionary_encode().indices.to_numpy())) + 1).tolist(), b.num_rows]
            for s, e in zip(edges, edges[1:]):
                if s < e and last is not None and names[s].as_py() != at:
                    yield told(True)
                    number, last, size = number + 1, None, 0
                while s < e:
                    if last is not None:
                        yield told(False)
                    last = b.slice(s, min(e - s, rows - size))
                    x, alpha = _numbers(last)
                    if not size:
                        first, now = x[0], (1.0, float(x[0]), 0.0, 0.0, 0.0)
                    now = _summary(x, alpha, now)
                    at, s, size = names[s].as_py(), s + last.num_rows, size + last.num_rows
                    if size == rows:
                        yield told(True)
                        number, last, size = number + 1, None, 0
        if last is not None:
            yield told(True)

    return run


def _finish(columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs each chunk of a sorted stream from the state in the row ahead of it (``_trade`` is false)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, var, n = 0.0, 0.0, 0
        for b in batches:
            states = [b.column(b.schema.get_field_index(c)) for c in ("ewma", "ewma_var", "trade_count")]
            trade = b.column(b.schema.get_field_index("_trade"))
            x, alpha = _numbers(b)
            means, variances, counts, s = [], [], [], 0
            for e in [*np.flatnonzero(~trade.to_numpy(zero_copy_only=False)).tolist(), b.num_rows]:
                if s < e:
                    m, v = _run(x[s:e], alpha[s:e], mean, var, n)
                    means += m
                    variances += v
                    counts.append(np.arange(n + 1, n + 1 + e - s))
                    mean, var, n = m[-1], v[-1], n + e - s
                if e < b.num_rows:
                    (mean, var, n), s = (c[e].as_py() for c in states), e + 1
            if means:
                kept = b.select(columns).filter(trade)
                made = [pa.array(means, pa.float64()), pa.array(variances, pa.float64()), pa.array(np.concatenate(counts), pa.int64())]
                yield pa.RecordBatch.from_arrays([*kept.columns, *made], names=[*columns, "ewma", "ewma_var", "trade_count"])

    return run


def score_trades(
    trades: DataFrame,
    config: ScorerConfig | None = None,
    configs: DataFrame | None = None,
    initial: DataFrame | None = None,
    chunk_rows: int = 200_000,
) -> DataFrame:
    """``trades`` with ``signed_ofi``, ``ewma``, ``ewma_var``, ``trade_count`` and ``z_score``, a row per trade.

    Trades are taken by (trade_time_ms, trade_id) within each upper-case symbol.
    Sides other than BUY and SELL, and values that are no sizes, count as 0 but
    advance the state. z is 0 for a symbol's first trade. ``configs`` may give
    symbols an ``ewma_alpha`` of their own, or the trades themselves have one
    each (``settings_as_of``); ``initial`` (schema FINAL) restores states.

    Up to ``chunk_rows`` trades are scored in one pass; beyond it they are dealt
    by ranges, never more than the session has shuffle partitions, and each range
    is cut into chunks of so many rows at most; the two ways differ by rounding
    at most. Both passes over chunks are streams in order, of which a task holds
    a batch.
    """
    config = config or ScorerConfig()
    epsilon = config.epsilon
    ready = _prepared(trades, config, configs)
    added = [T.StructField(c, T.DoubleType()) for c in ("ewma", "ewma_var")] + [T.StructField("trade_count", T.LongType())]
    # the trades as they came: their count needs no join
    parts = min(int(ready.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(trades.count() / chunk_rows))
    order = ("symbol", *ORDER)

    def alone(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(ORDER), kind="stable")
        means, variances = _run(rows["signed_ofi"].to_numpy(float), rows["_alpha"].to_numpy(float), 0.0, 0.0, 0)
        return rows.assign(ewma=means, ewma_var=variances, trade_count=np.arange(1, 1 + len(rows)))

    if parts <= 1 and initial is None:
        scored = ready.groupBy("symbol").applyInPandas(alone, T.StructType([*ready.schema.fields, *added]))
    else:
        kinds = T.StructType([T.StructField("n", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("first", *"abpqr")]])
        fields = [*ready.schema.fields, T.StructField("chunk", T.LongType()), T.StructField("_summary", kinds)]
        dealt = ready.repartitionByRange(max(parts, 1), *order).sortWithinPartitions(*order)
        cut = stored(dealt.mapInArrow(_cut(chunk_rows), T.StructType(fields)), "chunks")
        summaries = cut.filter("_summary is not null").select("symbol", "chunk", "_summary.*")
        if initial is not None:
            restored = initial.select(
                S.upper_symbol(F.col("symbol")).alias("symbol"),
                F.lit(-1).cast("long").alias("chunk"),
                F.col("trade_count").alias("n"),
                F.col("ewma").alias("first"),
                *[F.lit(0.0).alias(c) for c in "ab"],
                F.col("ewma_var").alias("p"),
                *[F.lit(0.0).alias(c) for c in "qr"],
            )
            summaries = summaries.unionByName(restored)
        states = summaries.groupBy("symbol").applyInPandas(_compose, STATE)
        chunks = cut.drop("_summary")
        schema = T.StructType([*chunks.schema.fields, *added])
        # a chunk's state goes ahead of its trades
        both = chunks.withColumn("_trade", F.lit(True)).unionByName(states.withColumn("_trade", F.lit(False)), allowMissingColumns=True)
        ready = both.repartition("symbol", "chunk").sortWithinPartitions("symbol", "chunk", "_trade", *ORDER)
        scored = ready.mapInArrow(_finish(chunks.columns), schema).drop("chunk")
    z = F.when(F.col("trade_count") == 1, 0.0).otherwise(F.col("ewma") / F.sqrt(F.greatest("ewma_var", F.lit(epsilon))))
    return scored.drop("_alpha").withColumn("z_score", z)


def final_state(scored: DataFrame) -> DataFrame:
    """The last state of each symbol (schema FINAL), by an aggregation with a partial step."""
    last = F.max_by(F.struct("ewma", "ewma_var", "trade_count"), "trade_count").alias("s")
    return scored.groupBy("symbol").agg(last).select("symbol", "s.*")


def current_z(states: DataFrame, epsilon: float = 1e-12) -> DataFrame:
    """The z-score that each state stands at."""
    return states.withColumn("z_score", F.col("ewma") / F.sqrt(F.greatest("ewma_var", F.lit(epsilon))))


def with_thresholds(scored: DataFrame, config: ScorerConfig, configs: DataFrame) -> DataFrame:
    """Scores with the symbol's ``z_threshold`` and ``min_trades``, the defaults where it has none, and ``is_toxic``."""
    own = configs.select("symbol", "z_threshold", "min_trades")
    joined = scored.join(own, "symbol", "left").withColumns(
        {
            "z_threshold": F.coalesce("z_threshold", F.lit(config.threshold)),
            "min_trades": F.coalesce("min_trades", F.lit(config.min_trades)),
        }
    )
    toxic = (F.col("trade_count") >= F.col("min_trades")) & (F.abs("z_score") >= F.col("z_threshold"))
    return joined.withColumn("is_toxic", toxic)


def checkpoint_epochs(scored: DataFrame, every: int = 100) -> DataFrame:
    """Trades in each checkpoint interval of a symbol."""
    epoch = F.floor((F.col("trade_count") - 1) / every).cast("long").alias("epoch")
    return scored.groupBy("symbol", epoch).agg(F.count("*").alias("n_trades"))


SETTINGS = ("z_threshold", "ewma_alpha", "min_trades")


def settings_as_of(trades: DataFrame, changes: DataFrame, config: ScorerConfig | None = None, part_rows: int = 1_000_000) -> DataFrame:
    """``trades`` with the ``z_threshold``, ``ewma_alpha`` and ``min_trades`` that held at their time.

    ``changes(symbol, at_ms, change_id, z_threshold, ewma_alpha, min_trades)``: a
    change counts for its symbol's trades from its time on; of several at one
    time the one with the largest ``change_id`` does; a null leaves a value as it
    was. Before the first one the defaults of ``config`` hold. Trades and changes
    are put in one order and the last known values carried along it, range by
    range, so that a symbol may hold any share of the rows.
    """
    config = config or ScorerConfig()
    named = trades.withColumn("symbol", S.upper_symbol(F.col("symbol")))
    is_trade = F.col("_kind") == 1
    rows = named.select("*", F.col("trade_time_ms").alias("_at"), F.lit(1).alias("_kind"), F.col("trade_id").alias("_id"))
    said = changes.select(
        S.upper_symbol(F.col("symbol")).alias("symbol"), F.col("at_ms").alias("_at"), F.lit(0).alias("_kind"), F.col("change_id").alias("_id"), *SETTINGS
    )
    both = rows.drop(*SETTINGS).unionByName(said, allowMissingColumns=True)
    known = filled(both, SETTINGS, ["_at", "_kind", "_id"], "symbol", part_rows).filter(is_trade).drop("_at", "_kind", "_id")
    default = {"z_threshold": F.coalesce(*[F.when(F.col("symbol") == s, F.lit(t)) for s, t in config.thresholds.items()], F.lit(config.threshold)), "ewma_alpha": F.lit(config.alpha), "min_trades": F.lit(config.min_trades)}
    return known.withColumns({c: F.coalesce(c, v) for c, v in default.items()})


def judged(scored: DataFrame) -> DataFrame:
    """Scores of trades with settings of their own (``settings_as_of``), with ``is_toxic``."""
    return scored.withColumn("is_toxic", (F.col("trade_count") >= F.col("min_trades")) & (F.abs("z_score") >= F.col("z_threshold")))


def ofi_ratio(trades: DataFrame, keys: list[str]) -> DataFrame:
    """(bought - sold) / (bought + sold) volume by ``keys``; null without volume."""
    x = S.signed_ofi(F.col("side"), F.col("quantity"), F.col("price"))
    volume = F.sum(F.abs(x))
    return trades.groupBy(*keys).agg((F.sum(x) / F.when(volume > 0, volume)).alias("ofi_ratio"))


def with_pacing(trades: DataFrame, speed: float, most_ms: float = 2000.0, part_rows: int = 1_000_000) -> DataFrame:
    """The delay before each trade's replay: the gap to the symbol's trade before, divided by ``speed`` and capped."""
    paced = previous(trades, "trade_time_ms", "symbol", ORDER, "_before", part_rows)
    gap = F.col("trade_time_ms") - F.col("_before")
    delay = F.when((gap > 0) & (F.lit(speed) > 0), F.least(F.floor(gap / speed).cast("double"), F.lit(most_ms))).otherwise(0.0)
    return paced.withColumn("delay_ms", F.coalesce(delay, F.lit(0.0))).drop("_before")
