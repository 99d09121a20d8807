"""Exchange frames in JSON: an envelope ``{stream, data}`` or the bare event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.functions import scalars as S


def decode_frames(frames: DataFrame, value: str = "value", strict: bool = False, now_ms: Column | None = None) -> DataFrame:
    """Frames as raw trades with ``error``, null for a good one.

    Events ``aggTrade`` (id ``a``) and ``trade`` (id ``t``) are known; others
    are errors, as is text that is no JSON object. A missing event time is
    ``now_ms`` (the clock, if none is given); symbols are normalised. ``strict``
    also rejects a zero id, an empty price and a zero time.
    """
    # a generator: each frame is parsed once, and all fields are taken from what it gives
    whole = F.struct(F.try_parse_json(F.col(value)).alias("_whole"))
    read = frames.select(F.col(value), F.inline(F.array(whole)))
    inner = F.try_variant_get("_whole", "$.data", "variant")
    event = F.when(inner.isNull() | F.is_variant_null(inner), F.col("_whole")).otherwise(inner)
    d = read.select(F.col(value), F.inline(F.array(F.struct(event.alias("_event")))))
    pick = lambda c: F.try_variant_get("_event", f"$.{c}", "string")
    number = lambda c: pick(c).try_cast("long")
    kind = pick("e")
    trade_id = F.when(kind == "aggTrade", number("a")).when(kind == "trade", number("t"))
    broken = ~F.coalesce(F.schema_of_variant("_event").startswith("OBJECT"), F.lit(False))
    error = F.when(broken, "malformed_json").when(F.coalesce(kind, F.lit("")) == "", "no event type").when(~kind.isin("aggTrade", "trade"), "unknown event type")
    if strict:
        error = (
            error.when(F.coalesce(trade_id, F.lit(0)) == 0, "no id")
            .when(F.coalesce(pick("p"), F.lit("")) == "", "no price")
            .when(F.coalesce(number("T"), F.lit(0)) == 0, "no time")
        )
    event_time = F.when(number("E") > 0, number("E")).otherwise(F.unix_millis(F.current_timestamp()) if now_ms is None else now_ms)
    return d.select(
        F.lit("binance").alias("exchange"),
        S.normalize_symbol(pick("s")).alias("symbol"),
        F.lit("live").alias("source"),
        trade_id.alias("trade_id"),
        pick("p").alias("price"),
        pick("q").alias("quantity"),
        F.lit(None).cast("string").alias("quote_quantity"),
        F.coalesce(pick("m").try_cast("boolean"), F.lit(False)).alias("is_buyer_maker"),
        number("T").alias("trade_time_ms"),
        event_time.alias("event_time_ms"),
        F.col(value).alias("payload"),
        error.alias("error"),
    )


def with_backfill(history: DataFrame, live: DataFrame) -> DataFrame:
    """What was traded before the stream started, then the stream; repeated trades are left to deduplication."""
    return history.unionByName(live)
