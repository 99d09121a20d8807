"""Counters, histograms and rates over trades and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.functions import scalars as S
from flowgauge.operators.normalize import REASONS

#: Upper bounds of the buckets of ingest lags (milliseconds) and batch sizes.
LAG_BUCKETS = (1, 5, 10, 25, 50, 100, 250, 500, 1000, 5000, 30000)
BATCH_BUCKETS = (1, 10, 50, 100, 250, 500, 1000, 2500, 5000)


#: Upper bounds of the buckets of publish latencies in seconds.
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10)


def producer_counters(batches: DataFrame) -> DataFrame:
    """Totals over ``batches(n_messages, n_bytes, attempts, outcome)``, a row a batch.

    ``outcome`` is published, dead_lettered or dropped; a batch of several
    attempts was retried, and one that wasn't published failed.
    """
    messages = lambda outcome: F.coalesce(F.sum(F.when(F.col("outcome") == outcome, F.col("n_messages"))), F.lit(0)).cast("long")
    published = F.col("outcome") == "published"
    return batches.agg(
        messages("published").alias("published"),
        F.count("*").alias("batches"),
        F.coalesce(F.sum(F.col("attempts") - 1), F.lit(0)).cast("long").alias("retries"),
        F.count_if(~published).alias("failed"),
        messages("dead_lettered").alias("dead_lettered"),
        messages("dropped").alias("dropped"),
        F.coalesce(F.sum(F.when(published, F.col("n_bytes"))), F.lit(0)).cast("long").alias("n_bytes"),
    )


def outcome_counts(size: Column) -> list[Column]:
    """Aggregates over normalised trades, for ``observe``: accepted ones, their bytes by ``size``, and a count for each reason."""
    good = F.col("reason").isNull()
    reasons = [F.count_if(F.coalesce(F.col("reason") == r, F.lit(False))).alias(r) for r in REASONS]
    return [F.count_if(good).alias("ok"), F.coalesce(F.sum(F.when(good, size)), F.lit(0)).cast("long").alias("n_bytes"), *reasons]


def counters(rows: DataFrame, labels: list[str]) -> DataFrame:
    """Rows by label values."""
    return rows.groupBy(*labels).agg(F.count("*").alias("n"))


def counter_sets(rows: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Rows by several sets of labels in one pass; a label outside its set is null."""
    labels = list(dict.fromkeys(c for s in sets for c in s))
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *labels).agg(F.count("*").alias("n"))


def histogram(rows: DataFrame, keys: list[str], value: str, bounds: tuple[int, ...] = LAG_BUCKETS) -> DataFrame:
    """Cumulative buckets ``le_<bound>``, ``total`` and ``n`` of a column, one pass without joins."""
    buckets = [F.count_if(F.col(value) <= b).alias(f"le_{b}".replace(".", "_")) for b in bounds]
    return rows.groupBy(*keys).agg(*buckets, F.sum(value).alias("total"), F.count("*").alias("n"))


def throughput(rows: DataFrame, time: Column, keys: list[str], seconds: int = 15) -> DataFrame:
    """Rows a second in windows of ``seconds``."""
    w = F.window(time, f"{seconds} seconds")
    found = rows.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"))
    return found.select(F.unix_millis("w.start").alias("window_start_ms"), *keys, "n", (F.col("n") / seconds).alias("per_second"))


def message_size(key: Column, value: Column, headers: Column) -> Column:
    """Bytes of a message's key, value and headers."""
    sizes = F.aggregate(
        F.map_entries(headers),
        F.lit(0).cast("long"),
        lambda n, e: n + F.octet_length(e["key"]) + F.octet_length(e["value"]),
    )
    return (F.octet_length(key) + F.octet_length(value)).cast("long") + sizes


def imbalance(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Share of buys among the trades."""
    return trades.groupBy(*keys).agg(F.avg(F.when(F.col("side") == "BUY", 1.0).otherwise(0.0)).alias("buy_share"))


def ofi_windows(
    trades: DataFrame, keys: list[str], size: str = "1 hour", slide: str = "15 minutes", time_ms: str = "trade_time_ms", delay: str | None = None
) -> DataFrame:
    """``(window_start_ms, <keys>, n_trades, net, volume, ofi_ratio)`` of sliding windows of event time.

    Trades are first summed up by slide, before the shuffle as far as they go; a
    window adds up its slides, so that no trade is copied into all its windows.
    The same for a table and, with a ``delay``, for a stream in append mode,
    which gives a window once the watermark has passed its end. ``ofi_ratio`` is
    null without volume. Trades without a time are left out.
    """
    x = S.signed_ofi(F.col("side"), F.col("quantity"), F.col("price"))
    rows = trades.select(*keys, F.timestamp_millis(time_ms).alias("event_time"), x.alias("x")).filter("event_time is not null")
    if delay is not None:
        rows = rows.withWatermark("event_time", delay)
    sums = (F.sum("x").alias("net"), F.sum(F.abs("x")).alias("volume"), F.count("*").alias("n_trades"))
    by_slide = rows.groupBy(F.window("event_time", slide).alias("s"), *keys).agg(*sums)
    again = (F.sum("n_trades").alias("n_trades"), F.sum("net").alias("net"), F.sum("volume").alias("volume"))
    found = by_slide.groupBy(F.window(F.window_time("s"), size, slide).alias("w"), *keys).agg(*again)
    ratio = (F.col("net") / F.when(F.col("volume") > 0, F.col("volume"))).alias("ofi_ratio")
    return found.select(F.unix_millis("w.start").alias("window_start_ms"), *keys, "n_trades", "net", "volume", ratio)
