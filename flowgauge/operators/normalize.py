"""Raw trades to canonical trades, with a reason for each rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.config import NormalizeConfig
from flowgauge.functions import scalars as S


#: Why a trade is rejected, in the order in which it is checked.
REASONS = (
    "empty_symbol", "bad_price", "bad_quantity", "bad_quote_quantity", "price_out_of_range", "quantity_out_of_range", "bad_timestamp",
    "stale_trade", "invalid_trade",
)


def _positive(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (x > 0), F.lit(False))


def _not_positive(x: Column) -> Column:
    """Null (it couldn't be read) or at most zero; NaN passes, to be found invalid later."""
    return x.isNull() | (~F.isnan(x) & (x <= 0))


def normalize(raw: DataFrame, config: NormalizeConfig, now_ms: Column) -> DataFrame:
    """``raw`` (schema RAW_TRADE) with canonical columns and ``reason``, null for a good trade.

    The first check that fails gives the reason, in this order: empty_symbol,
    bad_price, bad_quantity, bad_quote_quantity, price_out_of_range,
    quantity_out_of_range, bad_timestamp, stale_trade, invalid_trade. One
    projection: no shuffle, no Python.
    """
    price, quantity = S.parse_number(F.col("price")), S.parse_number(F.col("quantity"))
    given = S.parse_number(F.col("quote_quantity"))
    # a generator: Catalyst can't copy what it makes into every later use, so that each text is parsed once
    numbers = F.struct(price.alias("price"), quantity.alias("quantity"), given.alias("given"))
    read = raw.select(
        *[F.col(c).alias(f"raw_{c}") for c in ("price", "quantity", "quote_quantity", "trade_time_ms", "event_time_ms", "symbol")],
        *[F.col(c) for c in ("source", "trade_id", "is_buyer_maker", "payload")],
        S.normalize_exchange(F.col("exchange")).alias("exchange"),
        F.coalesce(S.normalize_symbol(F.col("symbol")), F.lit("")).alias("symbol"),
        F.inline(F.array(numbers)),
    )
    has_quote = F.coalesce(F.col("raw_quote_quantity"), F.lit("")) != ""
    quoted = has_quote & _positive(F.col("given"))
    parsed = read.withColumns(
        {
            "bad_quote": has_quote & ~_positive(F.col("given")),
            "quote_quantity": F.when(quoted, F.col("given")).otherwise(F.col("price") * F.col("quantity")),
            "trade_time_ms": F.when(F.col("raw_trade_time_ms") > 0, F.col("raw_trade_time_ms")).otherwise(F.col("raw_event_time_ms")),
            "ingested_at_ms": now_ms.cast("long"),
        }
    ).drop("given")
    event = F.when(F.col("raw_event_time_ms") > 0, F.col("raw_event_time_ms")).otherwise(F.col("trade_time_ms"))
    above = lambda c, most: (F.lit(most) > 0) & ~F.isnan(c) & (F.col(c) > most)
    sound = F.lit(True)
    for c in ("price", "quantity", "quote_quantity"):
        sound = sound & S.is_finite(F.col(c)) & (F.col(c) > 0)
    sound = sound & (F.coalesce(F.col("trade_id"), F.lit(0)) >= 0) & (F.col("ingested_at_ms") > 0)
    reason = (
        F.when(F.col("symbol") == "", "empty_symbol")
        .when(_not_positive(F.col("price")), "bad_price")
        .when(_not_positive(F.col("quantity")), "bad_quantity")
        .when(F.lit(not config.compute_quote_quantity) & F.col("bad_quote"), "bad_quote_quantity")
        .when(above("price", config.max_price), "price_out_of_range")
        .when(above("quantity", config.max_quantity), "quantity_out_of_range")
        .when(~F.coalesce(F.col("trade_time_ms") > 0, F.lit(False)), "bad_timestamp")
        .when((F.lit(config.max_age_ms) > 0) & (F.col("ingested_at_ms") - F.col("trade_time_ms") > config.max_age_ms), "stale_trade")
        .when(~F.coalesce(sound, F.lit(False)), "invalid_trade")
    )
    return parsed.withColumn("event_time_ms", event).withColumn("side", S.side_of_maker(F.col("is_buyer_maker"))).withColumn("reason", reason)


def good_trades(normalized: DataFrame, config: NormalizeConfig | None = None) -> DataFrame:
    """Accepted rows as trades, without ``sequence``. The id is the version 5 UUID of exchange, symbol and trade_id."""
    config = config or NormalizeConfig()
    key = F.concat_ws("|", "exchange", "symbol", F.col("trade_id").cast("string"))
    return normalized.filter("reason is null").select(
        S.uuid5_dns(key).alias("event_id"),
        F.lit(config.schema_version).alias("schema_version"),
        *("source", "exchange", "symbol", "trade_id", "price", "quantity"),
        F.col("quantity").alias("size"),
        *("quote_quantity", "side", "is_buyer_maker", "trade_time_ms"),
        F.col("trade_time_ms").alias("timestamp"),
        *("event_time_ms", "ingested_at_ms"),
        F.lit(config.host).alias("ingestion_host"),
    )


def dead_letters(normalized: DataFrame, config: NormalizeConfig | None = None) -> DataFrame:
    """Rejected rows in the envelope of the dead-letter output (schema DLQ)."""
    config = config or NormalizeConfig()
    named = lambda name, c: F.concat(F.lit(f"{name}="), F.coalesce(F.col(c).cast("string"), F.lit("")))
    detail = (
        F.when(F.col("reason") == "empty_symbol", "symbol missing")
        .when(F.col("reason").isin("bad_price", "price_out_of_range"), named("price", "raw_price"))
        .when(F.col("reason").isin("bad_quantity", "quantity_out_of_range"), named("quantity", "raw_quantity"))
        .when(F.col("reason") == "bad_quote_quantity", named("quote_quantity", "raw_quote_quantity"))
        .otherwise(named("trade_time", "raw_trade_time_ms"))
    )
    return normalized.filter("reason is not null").select(
        F.col("ingested_at_ms").alias("failed_at_ms"),
        "reason",
        detail.alias("detail"),
        *("exchange", F.col("raw_symbol").alias("symbol"), "trade_id"),
        F.col("payload").alias("raw_payload"),
        F.lit(config.host).alias("host"),
    )


def validate_json(messages: DataFrame, value: str = "value") -> DataFrame:
    """JSON trades with ``reason`` and the fields read; the first failing check counts.

    Order: malformed_json, symbol, side, price, quantity, trade_time_ms. Numbers
    written as strings aren't numbers. A missing event_id becomes the version 5
    UUID of the message. ``trade_id`` and ``exchange`` are read unless the
    messages have such columns. Empty messages are skipped; other columns are kept.
    """
    v = F.try_parse_json(F.col(value))
    text = lambda name: F.when(
        F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == "STRING", F.try_variant_get(v, f"$.{name}", "string")
    )
    number = lambda name: F.when(
        ~F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")).isin("STRING", "BOOLEAN"), F.lit(True)),
        F.try_variant_get(v, f"$.{name}", "double"),
    )
    kind = lambda name: F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    # whole numbers as they are written; only others pass through double, and lose their fraction
    whole = lambda name: F.when(kind(name) == "BIGINT", F.try_variant_get(v, f"$.{name}", "long")).otherwise(number(name).cast("long"))
    others = [F.col(c) for c in messages.columns]
    read = messages.filter(F.length(value) > 0).select(
        *others,
        (v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT")).alias("malformed"),
        S.upper_symbol(text("symbol")).alias("symbol"),
        F.upper(S.strip(text("side"))).alias("side"),
        number("price").alias("price"),
        number("quantity").alias("quantity"),
        whole("trade_time_ms").alias("trade_time_ms"),
        *([] if "trade_id" in messages.columns else [whole("trade_id").alias("trade_id")]),
        *([] if "exchange" in messages.columns else [S.normalize_exchange(text("exchange")).alias("exchange")]),
        F.coalesce(F.nullif(S.strip(text("event_id")), F.lit("")), S.uuid5_dns(F.col(value))).alias("event_id"),
    )
    bad = lambda test: ~F.coalesce(test, F.lit(False))
    reason = (
        F.when(F.coalesce(F.col("malformed"), F.lit(True)), "malformed_json")
        .when(bad(F.col("symbol") != ""), "symbol")
        .when(bad(F.col("side").isin("BUY", "SELL")), "side")
        .when(bad(F.col("price") > 0), "price")
        .when(bad(F.col("quantity") > 0), "quantity")
        .when(bad(F.col("trade_time_ms") > 0), "trade_time_ms")
    )
    return read.withColumn("reason", reason).drop("malformed")
