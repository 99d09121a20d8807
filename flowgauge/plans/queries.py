"""Queries over the driver's tables, one for each operator, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from flowgauge.config import FeedConfig, NormalizeConfig
from flowgauge.functions import scalars as S
from flowgauge.functions.sql import register_functions
from flowgauge.operators import alerts as A
from flowgauge.operators import audit, dedup, layout, metrics, scoring, snapshots, tables
from flowgauge.operators.normalize import REASONS, dead_letters, good_trades, normalize, validate_json
from flowgauge.plans import views as V
from flowgauge.sources import brokers, csv_trades, frames, replay
from flowgauge.streaming import transactional
from flowgauge.streaming.scorer import dedup_stream, score_stream, ttl_stream
from flowgauge.streaming.sinks import alert_writer, json_writer, ndjson, retrying, split_writer
from flowgauge.tables import shared_path, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query by its function's name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# ---- scalar functions ----


@query(f"with {V.TRADES} select symbol, count(*) n from trades where trade_id % 23 <> 0 group by symbol union all select '', count(*) from trades where trade_id % 23 = 0")
def sca01_symbol(spark, sf_dir):
    named = V.raw_trades(spark, sf_dir).select(S.normalize_symbol(F.col("symbol")).alias("symbol"))
    return named.groupBy("symbol").agg(F.count("*").alias("n"))


@query(f"with {V.TRADES} select trade_id, case when trade_id % 23 = 0 then '' else symbol[1:3] || '-' || symbol[4:] end symbol from trades")
def sca02_upper_symbol(spark, sf_dir):
    """Trimmed and upper-case only: separators stay."""
    return V.raw_trades(spark, sf_dir).select("trade_id", S.upper_symbol(F.col("symbol")).alias("symbol"))


@query(f"with {V.TRADES} select trade_id, case trade_id % 3 when 0 then trade_time_ms // 1000 * 1000 else trade_time_ms + 7 end at_ms from trades")
def sca25_alert_time(spark, sf_dir):
    """A stated time where it can be read, else milliseconds."""
    i, at = F.col("trade_id") % 3, F.timestamp_millis("trade_time_ms")
    stated = F.when(i == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(i == 1, "soon")
    return V.trades(spark, sf_dir).select("trade_id", F.unix_millis(S.alert_time(stated, F.col("trade_time_ms") + 7)).alias("at_ms"))


@query(f"with {V.TRADES} select trade_id, side from trades")
def sca04_side(spark, sf_dir):
    return V.trades(spark, sf_dir).select("trade_id", S.side_of_maker(F.col("is_buyer_maker")).alias("side"))


@query(f"with {V.TRADES} select trade_id, case when trade_id % 11 = 0 then 0::double when side = 'BUY' then quantity else -quantity end signed_ofi from trades")
def sca05_signed_ofi(spark, sf_dir):
    side = F.when(F.col("trade_id") % 11 == 0, "HOLD").otherwise(F.col("side"))
    return V.trades(spark, sf_dir).select("trade_id", S.signed_ofi(side, F.col("quantity"), F.col("price")).alias("signed_ofi"))


@query("""
select event_id trade_id, case event_id % 4 when 0 then epoch_us(ts) // 1000 when 3 then null
       else epoch_us(ts) // 1000000 * 1000 end time_ms from events""")
def sca07_time(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    text = (
        F.when(F.col("event_id") % 4 == 0, F.unix_millis("ts").cast("string"))
        .when(F.col("event_id") % 4 == 1, F.unix_seconds("ts").cast("string"))
        .when(F.col("event_id") % 4 == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise("yesterday")
    )
    return e.select(F.col("event_id").alias("trade_id"), S.parse_time_ms(text).alias("time_ms"))


@query(f"with {V.TRADES} select trade_id, case when trade_id % 5 = 0 then 99999::double else price * quantity end quote_quantity from trades")
def sca09_quote(spark, sf_dir):
    given = F.when(F.col("trade_id") % 5 == 0, "99999").when(F.col("trade_id") % 7 == 0, "bad")
    quote = S.quote_quantity(S.parse_number(given), F.col("price"), F.col("quantity"))
    return V.trades(spark, sf_dir).select("trade_id", quote.alias("quote_quantity"))


@query(f"with {V.TRADES} select case when trade_id % 13 = 0 then 'trade.unknown.unknown' else 'trade.binance.' || lower(symbol) end routing_key, count(*) n from trades group by 1")
def sca12_routing_key(spark, sf_dir):
    lost = F.col("trade_id") % 13 == 0
    part = lambda c: F.when(~lost, F.col(c))
    key = S.routing_key(part("exchange"), part("symbol"))
    return V.trades(spark, sf_dir).select(key.alias("routing_key")).groupBy("routing_key").agg(F.count("*").alias("n"))


@query(f"with {V.TRADES} select trade_id, trade_id % 32 attempt, cast(least(1000, 100 * power(2, trade_id % 32)) as bigint) delay_ms from trades")
def sca14_backoff(spark, sf_dir):
    attempt = F.col("trade_id") % 32
    return V.trades(spark, sf_dir).select("trade_id", attempt.alias("attempt"), S.backoff_ms(attempt, 100, 1000).alias("delay_ms"))


@query(f"""
with {V.TRADES}, h as (select trade_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(trade_id::varchar)) h from trades)
select trade_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ('89ab89ab89ab89ab')[instr('0123456789abcdef', h[17])] || h[18:20] || '-' || h[21:32] event_id from h""")
def sca21_uuid5(spark, sf_dir):
    return V.trades(spark, sf_dir).select("trade_id", S.uuid5_dns(F.col("trade_id").cast("string")).alias("event_id"))


@query(f"""
with {V.TRADES}, h as (select trade_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(trade_id::varchar)) h from trades)
select trade_id, case when trade_id % 3 = 2 then 'fresh'
  else h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ('89ab89ab89ab89ab')[instr('0123456789abcdef', h[17])] || h[18:20] || '-' || h[21:32] end event_id from h""")
def sca21_uuid_repair(spark, sf_dir):
    """Capitals in braces become canonical, other text its version 5 UUID, blanks a fresh version 4 one."""
    i = F.col("trade_id")
    text = i.cast("string")
    sent = F.when(i % 3 == 0, F.concat(F.lit("{"), F.upper(S.uuid5_dns(text)), F.lit("}"))).when(i % 3 == 1, text).otherwise(" ")
    made = V.trades(spark, sf_dir).select("trade_id", S.repair_uuid(sent).alias("made"))
    fresh = F.col("made").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    return made.select("trade_id", F.when((i % 3 == 2) & fresh, "fresh").otherwise(F.col("made")).alias("event_id"))


@query(f"""
with {V.TRADES}, s as (select symbol, count(*) n from trades group by symbol)
select symbol, n, cast(list_reduce(list_prepend(2166136261::bigint, list_transform(range(1, len(symbol) + 1), lambda i: ascii(symbol[i])::bigint)),
       lambda a, b: (xor(a, b) * 16777619) & 4294967295) % 4 as integer) shard from s""")
def sca22_fnv_shard(spark, sf_dir):
    counted = V.trades(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"))
    return counted.withColumn("shard", S.shard(F.col("symbol"), 4))


@query(f"with {V.TRADES} select case trade_id % 3 when 0 then 'binance' when 1 then 'unknown' else 'kraken' end exchange, count(*) n from trades group by 1")
def sca03_exchange(spark, sf_dir):
    text = F.when(F.col("trade_id") % 3 == 0, " BINANCE\t").when(F.col("trade_id") % 3 == 1, "  ").otherwise("Kraken")
    return V.trades(spark, sf_dir).groupBy(S.normalize_exchange(text).alias("exchange")).agg(F.count("*").alias("n"))


@query(f"with {V.TRADES} select trade_id, case trade_id % 5 when 0 then price when 1 then null when 2 then 1000::double when 3 then null else -0.5::double end number from trades")
def sca06_parse_number(spark, sf_dir):
    i = F.col("trade_id") % 5
    text = F.when(i == 0, F.concat(F.lit(" "), F.col("price").cast("string"))).when(i == 1, "1_0").when(i == 2, "1e3\n").when(i == 3, "1e400").otherwise("-.5")
    return V.trades(spark, sf_dir).select("trade_id", S.parse_number(text).alias("number"))


@query(f"with {V.TRADES} select trade_id, trade_id % 4 < 2 flag from trades")
def sca08_flag(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, [" TRUE", "y", "no", ""])), (F.col("trade_id") % 4).cast("int") + 1)
    return V.trades(spark, sf_dir).select("trade_id", S.parse_flag(text).alias("flag"))


@query(f"with {V.TRADES}, {V.RAW} select trade_id, at_ms trade_time_ms from raw")
def sca10_time_fallback(spark, sf_dir):
    return V.normalized(spark, sf_dir).select("trade_id", F.coalesce("trade_time_ms", F.lit(0).cast("long")).alias("trade_time_ms"))


@query(f"with {V.TRADES} select exchange || ':' || symbol partition_key, count(*) n from trades group by 1")
def sca11_partition_key(spark, sf_dir):
    key = S.partition_key(F.col("exchange"), F.col("symbol")).alias("partition_key")
    return V.trades(spark, sf_dir).groupBy(key).agg(F.count("*").alias("n"))


@query(f"with {V.TRADES} select trade_id, greatest(0, trade_id % 500 - 100) lag_ms from trades")
def sca13_lag(spark, sf_dir):
    ingested = F.col("trade_time_ms") + F.col("trade_id") % 500 - 100
    return V.trades(spark, sf_dir).select("trade_id", S.lag_ms(ingested, F.col("trade_time_ms")).alias("lag_ms"))


@query(f"with {V.TRADES} select trade_id, 'exchange=' || exchange || ';side=' || side || ';symbol=' || symbol headers from trades")
def sca16_sorted_headers(spark, sf_dir):
    sent = S.sorted_headers(S.header_map(symbol=F.col("symbol"), exchange=F.col("exchange"), side=F.col("side")))
    text = F.array_join(F.transform(sent, lambda h: F.concat(h["key"], F.lit("="), h["value"])), ";")
    return V.trades(spark, sf_dir).select("trade_id", text.alias("headers"))


@query(f"with {V.TRADES} select trade_id, quantity size, trade_time_ms \"timestamp\" from trades where trade_id % 23 <> 0 and trade_id % 17 <> 0 and trade_id % 19 <> 0 and trade_id % 29 <> 0 and trade_id % 31 <> 0")
def sca17_aliases(spark, sf_dir):
    return good_trades(V.normalized(spark, sf_dir)).select("trade_id", "size", "timestamp")


@query(f"with {V.TRADES} select trade_id, round(price / 0.5::double) * 0.5::double ticked from trades")
def sca26_round_to(spark, sf_dir):
    return V.trades(spark, sf_dir).select("trade_id", S.round_to(F.col("price"), 0.5).alias("ticked"))


# ---- normalisation ----


@query(f"""with {V.TRADES}, {V.RAW}
select trade_id, case when reason in ('empty_symbol', 'bad_price', 'bad_quantity') then reason when price > 140 and trade_id % 31 <> 0 then 'price_out_of_range'
  when quantity > 4 then 'quantity_out_of_range' when reason = 'bad_timestamp' then reason
  when 1706745600000 - at_ms > 1728000000 then 'stale_trade' else reason end reason from raw""")
def flt03_guards(spark, sf_dir):
    guards = NormalizeConfig(max_price=140.0, max_quantity=4.0, max_age_ms=1_728_000_000)
    return normalize(V.raw_trades(spark, sf_dir), guards, F.lit(V.NOW_MS)).select("trade_id", "reason")


@query(f"with {V.TRADES}, {V.RAW} select trade_id, reason from raw")
def flt01_reason(spark, sf_dir):
    return V.normalized(spark, sf_dir).select("trade_id", "reason")


@query(f"with {V.TRADES}, {V.RAW} select trade_id, reason from raw")
def sca_sql_reason(spark, sf_dir):
    """The same reasons by a query in SQL text, with the helpers as functions of SQL."""
    register_functions(spark)
    V.raw_trades(spark, sf_dir).createOrReplaceTempView("flow_raw")
    return spark.sql("""
      with read as (
        select *, flow_normalize_symbol(symbol) as name, flow_parse_number(price) as p, flow_parse_number(quantity) as q, flow_parse_number(quote_quantity) as given,
               if(trade_time_ms > 0, trade_time_ms, event_time_ms) as at_ms from flow_raw),
      quoted as (select *, flow_quote_quantity(given, p, q) as quote from read)
      select trade_id, case
        when coalesce(name, '') = '' then 'empty_symbol'
        when p is null or (not isnan(p) and p <= 0) then 'bad_price'
        when q is null or (not isnan(q) and q <= 0) then 'bad_quantity'
        when not coalesce(at_ms > 0, false) then 'bad_timestamp'
        when not (flow_is_finite(p) and flow_is_finite(q) and flow_is_finite(quote) and trade_id >= 0) then 'invalid_trade' end as reason
      from quoted""")


@query(f"""with {V.TRADES}, {V.RAW}
select trade_id, exchange, symbol, side, price, quantity, quote quote_quantity, at_ms trade_time_ms from raw where reason is null""")
def flt01_good(spark, sf_dir):
    columns = ("trade_id", "exchange", "symbol", "side", "price", "quantity", "quote_quantity", "trade_time_ms")
    return good_trades(V.normalized(spark, sf_dir)).select(*columns)


@query(f"with {V.TRADES}, {V.RAW} select trade_id, reason, 'raw-' || trade_id raw_payload from raw where reason is not null")
def flt01_dlq(spark, sf_dir):
    return dead_letters(V.normalized(spark, sf_dir)).select("trade_id", "reason", "raw_payload")


@query(f"""with {V.TRADES}
select trade_id, case when trade_id % 17 = 0 then 'malformed_json' when trade_id % 13 = 0 then 'symbol' when trade_id % 11 = 0 then 'side'
  when trade_id % 7 = 0 then 'price' when trade_id % 5 = 0 then 'quantity' when trade_id % 3 = 0 then 'trade_time_ms' end reason from trades""")
def flt05_json_validate(spark, sf_dir):
    i = F.col("trade_id")
    good = F.to_json(
        F.struct(
            F.when(i % 13 == 0, " ").otherwise(F.lower("symbol")).alias("symbol"),
            F.when(i % 11 == 0, "HOLD").otherwise(F.lower("side")).alias("side"),
            F.when(i % 7 != 0, F.col("price")).alias("price"),
            F.when(i % 5 == 0, F.lit(-1.0)).otherwise(F.col("quantity")).alias("quantity"),
            F.when(i % 3 != 0, F.col("trade_time_ms")).otherwise(F.lit(0)).alias("trade_time_ms"),
        )
    )
    sent = V.trades(spark, sf_dir).select("trade_id", F.when(i % 17 == 0, "{broken").otherwise(good).alias("value"))
    return validate_json(sent).select("trade_id", "reason")


@query(f"""with {V.TRADES} select case when trade_id % 7 = 0 then 'malformed_json' when trade_id % 5 = 0 then 'side' else 'ok' end reason, count(*) n from trades where trade_id % 3 <> 0 group by 1""")
def flt06_empty(spark, sf_dir):
    """Empty and missing messages are skipped, not rejected."""
    i = F.col("trade_id")
    side = F.when(i % 5 == 0, "HOLD").otherwise(F.col("side"))
    text = F.to_json(F.struct("symbol", side.alias("side"), "price", "quantity", "trade_time_ms"))
    sent = V.trades(spark, sf_dir).select("trade_id", F.when(i % 6 == 0, "").when(i % 3 == 0, F.lit(None)).when(i % 7 == 0, "[").otherwise(text).alias("value"))
    return validate_json(sent).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""with recursive {V.TRADES.replace("from events", "from events where event_id % 23 <> 0")}, {V.SCORED} select trade_id, symbol, ewma, trade_count from scored""")
def flt07_no_symbol(spark, sf_dir):
    """Trades without a symbol are passed over: they get no score and advance none."""
    blank = F.element_at(F.array(F.lit(""), F.lit(" \t"), F.lit(None)), (F.col("trade_id") % 3).cast("int") + 1)
    t = V.trades(spark, sf_dir).withColumn("symbol", F.when(F.col("trade_id") % 23 == 0, blank).otherwise(F.col("symbol")))
    return scoring.score_trades(t, V.CONFIG).select("trade_id", "symbol", "ewma", "trade_count")


@query(f"""with {V.TRADES}, m as (
  select trade_id, trade_id::varchar "key", symbol, trade_time_ms, case when trade_id % 5 = 0 then 'HOLD' else lower(side) end said from trades)
select "key", trade_id % 5 <> 0 and trade_id % 7 <> 0 forwarded,
  case when trade_id % 7 = 0 then '{{broken' when trade_id % 5 = 0 then
    '{{"trade_id":' || trade_id || ',"symbol":" ' || symbol || '","side":"' || said || '","price":1,"quantity":2.5,"trade_time_ms":' || trade_time_ms || '}}'
  else trade_id || ' ' || symbol || ' ' || upper(said) || ' ' || trade_time_ms end said from m""")
def snk09_json_split(spark, sf_dir):
    """Messages that pass, read back from their canonical JSON; the others as they came."""
    said = F.when(F.col("trade_id") % 5 == 0, "HOLD").otherwise(F.lower("side"))
    parts = F.lit('{"trade_id":'), F.col("trade_id"), F.lit(',"symbol":" '), F.col("symbol"), F.lit('","side":"'), said
    text = F.concat(*parts, F.lit('","price":1,"quantity":2.5,"trade_time_ms":'), F.col("trade_time_ms"), F.lit("}"))
    sent = V.trades(spark, sf_dir).select(F.col("trade_id").cast("string").alias("key"), F.when(F.col("trade_id") % 7 == 0, "{broken").otherwise(text).alias("value"))
    good, bad = shared_path(spark, "forwarded"), shared_path(spark, "rejected")
    json_writer(good, bad)(sent, 0)
    read = F.concat_ws(" ", *[F.get_json_object("value", f"$.{c}") for c in ("trade_id", "symbol", "side", "trade_time_ms")])
    forwarded = spark.read.parquet(f"{good}/batch=0").select("key", F.lit(True).alias("forwarded"), read.alias("said"))
    return forwarded.unionByName(spark.read.parquet(f"{bad}/batch=0").select("key", F.lit(False).alias("forwarded"), F.col("value").alias("said")))


# ---- deduplication ----


@query(f"with {V.TRADES} select trade_id, symbol, price from trades")
def agg01_dedup(spark, sf_dir):
    t = V.trades(spark, sf_dir).withColumn("copy", F.lit(0))
    again = t.filter("trade_id % 10 = 0").withColumn("copy", F.lit(1)).withColumn("price", F.lit(-1.0))
    return dedup.first_of_each(t.unionByName(again), [F.col("copy")]).select("trade_id", "symbol", "price")


@query(f"""with recursive {V.TRADES},
k as (select symbol, trade_time_ms // 3600000 as hr, trade_time_ms t from trades),
o as (select *, row_number() over (partition by symbol, hr order by t) n from (select distinct * from k)),
r as (select symbol, hr, t, n, t kept, true keep from o where n = 1
      union all
      select o.symbol, o.hr, o.t, o.n, case when o.t - r.kept >= 600000 then o.t else r.kept end, o.t - r.kept >= 600000
      from r join o on o.symbol = r.symbol and o.hr = r.hr and o.n = r.n + 1)
select symbol, hr as "hour", t kept_ms from r where keep""")
def agg01_dedup_ttl(spark, sf_dir):
    keyed = V.trades(spark, sf_dir).withColumn("hour", F.floor(F.col("trade_time_ms") / 3_600_000))
    kept = dedup.within_ttl(keyed, "trade_time_ms", 600_000, ("symbol", "hour"), ("trade_id",))
    return kept.select("symbol", "hour", F.col("trade_time_ms").alias("kept_ms"))


@query(f"""with recursive {V.TRADES}, o as (select distinct trade_time_ms t from trades),
r as (select min(t) t from o union all select (select min(o.t) from o where o.t >= r.t + 1800000) from r where r.t is not null)
select t kept_ms from r where t is not null""")
def agg01_ttl_hot(spark, sf_dir):
    """One key holds all trades."""
    kept = dedup.within_ttl(V.trades(spark, sf_dir), "trade_time_ms", 1_800_000, ("exchange",), ("trade_id",))
    return kept.select(F.col("trade_time_ms").alias("kept_ms"))


# ---- scoring ----

SCORED_COLUMNS = "trade_id, symbol, signed_ofi, ewma, ewma_var, trade_count, z_score"


@query(f"with recursive {V.TRADES}, {V.SCORED} select {SCORED_COLUMNS} from scored")
def agg02_score(spark, sf_dir):
    return V.scored(spark, sf_dir).select(*SCORED_COLUMNS.split(", "))


ROUNDED = ("ewma", "ewma_var", "z_score")


@query(f"with recursive {V.TRADES}, {V.SCORED} select trade_id, trade_count, {', '.join(f'round({c}, 6) {c}' for c in ROUNDED)} from scored")
def agg02_score_chunks(spark, sf_dir):
    """Small chunks, composed: equal up to rounding."""
    found = scoring.score_trades(V.trades(spark, sf_dir), V.CONFIG, V.configs(spark), chunk_rows=1000)
    return found.select("trade_id", "trade_count", *[F.round(c, 6).alias(c) for c in ROUNDED])


LAST = "last as (select symbol, ewma, ewma_var, trade_count from scored qualify row_number() over (partition by symbol order by trade_count desc) = 1)"


@query(f"with recursive {V.TRADES}, {V.SCORED}, {LAST} select * from last")
def agg03_final_state(spark, sf_dir):
    return scoring.final_state(V.scored(spark, sf_dir))


@query(f"with recursive {V.TRADES}, {V.SCORED}, {LAST} select symbol, ewma / sqrt(greatest(ewma_var, 1e-12::double)) z_score from last")
def agg04_current_z(spark, sf_dir):
    return scoring.current_z(scoring.final_state(V.scored(spark, sf_dir))).select("symbol", "z_score")


@query(f"{V.ALL} select trade_id, symbol, trade_count, z_score from toxic")
def flt08_toxic(spark, sf_dir):
    return V.toxic(spark, sf_dir).select("trade_id", "symbol", "trade_count", "z_score")


@query(f"{V.ALL} select symbol, z_threshold, min_trades, count(*) n from judged group by all")
def jon01_threshold_join(spark, sf_dir):
    judged = scoring.with_thresholds(V.scored(spark, sf_dir), V.CONFIG, V.configs(spark))
    return judged.groupBy("symbol", "z_threshold", "min_trades").agg(F.count("*").alias("n"))


@query(f"""with {V.TRADES}, {V.CONFIGS}, o as (select symbol, max(quantity) top from trades where symbol in ('BTCUSDT', 'BNBUSDT') group by symbol),
w as (select coalesce(o.symbol, c.symbol) symbol, coalesce(o.top, c.z_threshold) z_threshold from configs c full join o using (symbol))
select trade_id, symbol, coalesce(z_threshold, 3::double) z_threshold from trades left join w using (symbol)""")
def jon02_config_overlay(spark, sf_dir):
    """Thresholds named in the environment (here the largest trades of two symbols) over those configured, joined to the trades."""
    t = V.trades(spark, sf_dir)
    named = t.filter(F.lower("symbol").isin("btcusdt", "bnbusdt")).groupBy(F.lower("symbol").alias("symbol")).agg(F.max("quantity").alias("top")).collect()  # two rows
    config = V.CONFIG.with_overrides({f"SCORER_THRESHOLD_{r['symbol']}": str(r["top"]) for r in named})
    joined = t.join(scoring.config_table(spark, config).select("symbol", "z_threshold"), "symbol", "left")
    return joined.select("trade_id", "symbol", F.coalesce("z_threshold", F.lit(config.threshold)).alias("z_threshold"))


@query(f"""with recursive {V.TRADES}, {V.SCORED},
cut as (select max(trade_time_ms) // 2 + min(trade_time_ms) // 2 cut_ms from trades)
select trade_id, symbol, trade_count, ewma, ewma_var, z_score from scored, cut where trade_time_ms >= cut_ms""")
def jon03_restore(spark, sf_dir):
    before, later = _halves(spark, sf_dir)
    return scoring.score_trades(later, V.CONFIG, initial=before).select("trade_id", "symbol", "trade_count", "ewma", "ewma_var", "z_score")


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The states at the middle of the trades' time, and the trades from there on."""
    t = V.trades(spark, sf_dir)
    ends = t.agg(F.max("trade_time_ms").alias("b"), F.min("trade_time_ms").alias("a")).first()
    at = ends["b"] // 2 + ends["a"] // 2
    return scoring.final_state(scoring.score_trades(t.filter(F.col("trade_time_ms") < at), V.CONFIG)), t.filter(F.col("trade_time_ms") >= at)


@query(f"with recursive {V.TRADES}, {V.SCORED} select symbol, (trade_count - 1) // 100 epoch, count(*) n_trades from scored group by all")
def agg12_ckpt_epochs(spark, sf_dir):
    return scoring.checkpoint_epochs(V.scored(spark, sf_dir))


@query(f"with {V.TRADES} select symbol, round(sum(case when side = 'BUY' then quantity else -quantity end) / sum(quantity), 9) ofi_ratio from trades group by symbol")
def agg16_ofi_ratio(spark, sf_dir):
    return scoring.ofi_ratio(V.trades(spark, sf_dir), ["symbol"]).withColumn("ofi_ratio", F.round("ofi_ratio", 9))


WINDOWS = f"""with {V.TRADES}, w as (
  select trade_time_ms // 900000 * 900000 - k * 900000 window_start_ms, symbol, case when side = 'BUY' then quantity else -quantity end x from trades, (select unnest([0, 1, 2, 3]) k))
select window_start_ms, symbol, count(*) n_trades, round(sum(x), 6) net, round(sum(x) / sum(abs(x)), 9) ofi_ratio from w group by all"""


@query(WINDOWS)
def agg16_windows(spark, sf_dir):
    return metrics.ofi_windows(V.trades(spark, sf_dir), ["symbol"]).select("window_start_ms", "symbol", "n_trades", F.round("net", 6).alias("net"), F.round("ofi_ratio", 9).alias("ofi_ratio"))


@query(WINDOWS)
def agg16_window_stream(spark, sf_dir):
    """The same from a stream, each window once it is complete; a last trade of no symbol lets the watermark pass all others."""
    source, out, offsets = (shared_path(spark, n) for n in ("window-in", "windows", "window-offsets"))
    t = V.trades(spark, sf_dir)
    t.repartitionByRange(3, "trade_time_ms").write.parquet(source)
    end = t.agg(F.max("trade_time_ms")).first()[0]
    t.limit(1).withColumns({"symbol": F.lit("~"), "trade_time_ms": F.lit(2 * end)}).write.mode("append").parquet(source)
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 2).parquet(source)
    found = metrics.ofi_windows(stream, ["symbol"], delay="30 days")
    writer = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", offsets)
    writer.trigger(availableNow=True).start().awaitTermination()
    # not before: Spark would leave the last trade out ahead of the watermark
    done = spark.read.parquet(out).filter("symbol <> '~'")
    return done.select("window_start_ms", "symbol", "n_trades", F.round("net", 6).alias("net"), F.round("ofi_ratio", 9).alias("ofi_ratio"))


@query(f"""with {V.TRADES}, g as (select trade_id, trade_time_ms - lag(trade_time_ms) over (partition by symbol order by trade_time_ms, trade_id) gap from trades)
select trade_id, case when gap > 0 then least(floor(gap / 50.0::double), 2000::double) else 0::double end delay_ms from g""")
def win02_pacing(spark, sf_dir):
    return scoring.with_pacing(V.trades(spark, sf_dir), 50.0).select("trade_id", "delay_ms")


# ---- alerts ----

MATCH = "symbol = 'ETHUSDT' and alerted_at >= timestamp '2024-01-03' and alerted_at <= timestamp '2024-01-25' and abs(z_score) between 3 and 20"


@query(f"{V.ALL} select count(*) n from alerts where {MATCH}")
def agg05_count(spark, sf_dir):
    return V.filtered(spark, sf_dir).agg(F.count("*").alias("n"))


@query(f"{V.ALL} select id, symbol, z_score, trade_time_ms from alerts where {MATCH}")
def flt09_history(spark, sf_dir):
    return V.filtered(spark, sf_dir).select("id", "symbol", "z_score", "trade_time_ms")


@query(f"{V.ALL} select id, symbol, z_score, trade_time_ms from alerts where {MATCH}")
def srt06_curve(spark, sf_dir):
    """The same history from a table clustered by symbol, time and score, of which only files that may match are read."""
    path = shared_path(spark, "curve")
    layout.write_alerts(V.alerts(spark, sf_dir), path, files=16)
    asked = {"symbol": " ethusdt ", "from_time": "2024-01-03 00:00:00", "to_time": "2024-01-25 00:00:00", "min_z": 3.0, "max_z": 20.0}
    return A.alert_history(layout.curve_rows(spark, path, layout.alert_files(spark, path, **asked)), **asked).select("id", "symbol", "z_score", "trade_time_ms")


@query(f"""with {V.TRADES}, o as (select *, row_number() over (order by trade_time_ms desc, trade_id desc) place, count(*) over () total from trades)
select trade_id, symbol, total from o where place > total - total // 3 and place <= total - total // 3 + 50""")
def srt01_deep_page(spark, sf_dir):
    """A page two thirds down all trades, newest first, from the files that hold it; the total is the index's."""
    path, order = shared_path(spark, "sorted"), [F.desc("trade_time_ms"), F.desc("trade_id")]
    layout.write_sorted(V.trades(spark, sf_dir), path, order, files=16)
    total = layout.sorted_total(spark, path)
    return layout.sorted_page(spark, path, order, 50, total - total // 3).select("trade_id", "symbol", F.lit(total).cast("long").alias("total"))


@query(f"{V.ALL} select id, trade_id from alerts where symbol = 'DOGEUSDT' and abs(z_score) >= 2.75")
def flt10_alerts(spark, sf_dir):
    return A.alert_history(V.alerts(spark, sf_dir), "dogeusdt", min_z=2.75).select("id", "trade_id")


@query(f"""{V.ALL} select symbol "key", trade_id, exchange, round(quantity * price, 6) quote_quantity, round(z_score, 6) z_score, 'toxicity' alert_type, trade_time_ms + 5 alerted_at_ms from toxic""")
def snk10_alert_messages(spark, sf_dir):
    """Alerts as messages: the symbol is the key, and the trade's own columns flow through to the value."""
    made = A.alert_json(A.build_alerts(V.toxic(spark, sf_dir), F.col("trade_time_ms") + 5))
    said = F.from_json("value", "trade_id long, exchange string, quote_quantity double, z_score double, alert_type string, alerted_at_ms long")
    rows = made.select("key", F.inline(F.array(said)))
    return rows.withColumn("quote_quantity", F.round("quote_quantity", 6)).select("key", "trade_id", "exchange", "quote_quantity", "z_score", "alert_type", "alerted_at_ms")


@query(f"""{V.ALL} select trade_id, id % 3 batch, 'ALERT' event_type, 'system' actor, symbol, round(z_score, 9) z_score, 'alerted_at,event_id,ewma' first_keys, true ok from alerts""")
def aud02_alert_log(spark, sf_dir):
    """Alerts stored in three batches with their audit entries: details with sorted keys, and chains that verify."""
    kept, log = shared_path(spark, "alert-store"), shared_path(spark, "alert-log")
    found = stored(V.alerts(spark, sf_dir), "found")
    write = alert_writer(kept, log)
    for n in range(3):
        write(found.filter(F.col("id") % 3 == n), n)
    entries = audit.verify_chain(spark.read.parquet(log))
    keys = F.array_join(F.slice(F.json_object_keys("details"), 1, 3), ",")
    z = F.round(F.get_json_object("details", "$.z_score").cast("double"), 9)
    return entries.select(F.col("event_id").cast("long").alias("trade_id"), F.col("batch").cast("long").alias("batch"), "event_type", "actor", "symbol", z.alias("z_score"), keys.alias("first_keys"), "ok")


@query(f"{V.ALL} select id, symbol, trade_time_ms from alerts order by alerted_at desc, id desc limit 25 offset 25")
def srt01_page2(spark, sf_dir):
    return A.page(V.alerts(spark, sf_dir), A.newest_first(), 25, 25).select("id", "symbol", "trade_time_ms")


@query(f"""{V.ALL} select id as "ID", symbol as "Symbol", exchange as "Exchange", side as "Side", quantity as "Quantity", price as "Price",
strftime(alerted_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as "Alerted At" from alerts order by alerted_at desc, id desc limit 5000""")
def snk15_export(spark, sf_dir):
    return A.export_alerts(V.alerts(spark, sf_dir)).select("ID", "Symbol", "Exchange", "Side", "Quantity", "Price", "Alerted At")


HEADED = ", ".join(f'{c} as "{h}"' for c, h in A.EXPORT.items() if c not in ("event_id", "alerted_at"))


@query(f"""{V.ALL}, h as (select *, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(trade_id::varchar)) hx from alerts)
select {HEADED}, hx[1:8] || '-' || hx[9:12] || '-5' || hx[14:16] || '-' || ('89ab89ab89ab89ab')[instr('0123456789abcdef', hx[17])] || hx[18:20] || '-' || hx[21:32] as "Event ID",
strftime(alerted_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as "Alerted At" from h where symbol = 'DOGEUSDT' order by alerted_at desc, id desc limit 20""")
def snk15_export_symbol(spark, sf_dir):
    return A.export_alerts(V.alerts(spark, sf_dir), "dogeusdt", 20)


@query(f"{V.ALL} select id, trade_id from alerts where trade_id % 7 not in (0, 1)")
def flt11_alert_type(spark, sf_dir):
    kind = F.when(F.col("trade_id") % 7 == 0, "latency").when(F.col("trade_id") % 7 != 1, "toxicity")
    return A.toxicity_only(V.alerts(spark, sf_dir).withColumn("alert_type", kind)).select("id", "trade_id")


@query(f"{V.ALL} select trade_id, round(z_score, 6) z_score, round(ewma, 8) ewma, round(ewma_var, 8) ewma_var, round(signed_ofi, 8) signed_ofi from toxic")
def sca24_alert_rounding(spark, sf_dir):
    made = A.build_alerts(V.toxic(spark, sf_dir), F.col("trade_time_ms"))
    return made.select("trade_id", "z_score", "ewma", "ewma_var", "signed_ofi")


@query(f"""{V.ALL} select id, printf('%.2f', z_score) z_score, printf('%.6f', signed_ofi) signed_ofi, printf('%.6f', quantity) quantity,
strftime(alerted_at, '%Y-%m-%d %H:%M:%S') "time" from alerts""")
def sca30_display(spark, sf_dir):
    kept = V.alerts(spark, sf_dir)
    late = kept.withColumn("alerted_at", F.when(F.col("id") % 2 == 0, F.col("alerted_at"))).withColumn("side", F.col("id").cast("string"))
    return A.display(late).select(F.col("side").cast("long").alias("id"), "z_score", "signed_ofi", "quantity", "time")


@query(f"{V.ALL} select symbol, count(*) n, max(abs(z_score)) top_z from alerts group by symbol")
def flagship_alerts(spark, sf_dir):
    return V.alerts(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), F.max(F.abs("z_score")).alias("top_z"))


@query(f"{V.ALL} select id, symbol from alerts order by alerted_at desc, id desc limit 20")
def agg14_latest(spark, sf_dir):
    return A.page(V.alerts(spark, sf_dir), A.newest_first(), 20).select("id", "symbol")


@query(f"{V.ALL} select id, side || ' · Z ' || printf('%.2f', z_score) || chr(10) || 'Price: $' || printf('%.2f', price) body from alerts")
def snk16_notification(spark, sf_dir):
    text = S.notification(F.col("side"), F.col("z_score"), F.col("price"))
    return V.alerts(spark, sf_dir).select("id", text.alias("body"))


# ---- audit and tables ----


def _audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a log with a segment for every four years; some details hold the separator."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.to_date("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.lit("CONFIG_CHANGE").alias("event_type"),
        F.concat(F.lit("user-"), F.col("o_custkey").cast("string")).alias("actor"),
        F.col("o_orderpriority").alias("symbol"),
        F.lit(None).cast("string").alias("event_id"),
        F.when(F.col("o_orderkey") % 5 == 0, F.concat("o_orderstatus", F.lit("|"))).otherwise(F.col("o_orderstatus")).alias("details"),
        (F.unix_date(day).cast("long") * 86_400_000).alias("created_at_ms"),
        F.floor(F.year(day) / 4).cast("int").alias("segment"),
    )


PART = 4096
CHAIN = f"""
e as (select o_orderkey id, 'user-' || o_custkey actor, o_orderpriority symbol, o_orderstatus || case when o_orderkey % 5 = 0 then '\\|' else '' end details,
             date_diff('day', date '1970-01-01', cast(o_orderdate as date)) on_day, (year(o_orderdate) // 4)::integer segment from orders),
f as (select *, 'CONFIG_CHANGE|' || actor || '|' || symbol || '||' || details || '|' || (on_day::bigint * 86400000) || '|' body,
             row_number() over (partition by segment order by id) entry from e),
c as (select segment, entry, id, (entry - 1) // {PART} part, null::varchar previous_hash, sha256(body) entry_hash from f where (entry - 1) % {PART} = 0
      union all
      select f.segment, f.entry, f.id, c.part, c.entry_hash, sha256(f.body || c.entry_hash)
      from c join f on f.segment = c.segment and f.entry = c.entry + 1 where c.entry % {PART} > 0)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.build_chain(_audit_events(spark, sf_dir), part_rows=PART)


@query(f"with recursive {CHAIN} select id, segment, entry, part, previous_hash, entry_hash from c")
def aud01_chain(spark, sf_dir):
    return _log(spark, sf_dir).select("id", "segment", "entry", "part", "previous_hash", "entry_hash")


@query("select o_orderkey id, o_orderkey % 97 <> 0 ok from orders")
def aud01_verify(spark, sf_dir):
    forged = _log(spark, sf_dir).withColumn("details", F.when(F.col("id") % 97 == 0, "forged").otherwise(F.col("details")))
    return audit.verify_chain(forged, part_rows=PART).select("id", "ok")


@query(f"""with recursive {CHAIN}, n as (select distinct segment, part, max(part) over (partition by segment) last_part from c)
select segment, part, case when part = last_part then 'missing' when part = 0 then 'short' end problem from n""")
def aud01_parts(spark, sf_dir):
    """A log of which each segment's last part is gone, and of the other first parts the last entry."""
    log = stored(_log(spark, sf_dir), "log")
    heads = stored(audit.chain_heads(log), "heads")
    last = heads.groupBy("segment").agg(F.max("part").alias("last_part"))
    cut = log.join(last, "segment").filter((F.col("part") < F.col("last_part")) & ((F.col("part") > 0) | (F.col("entry") < PART)))
    return audit.verify_parts(cut.drop("last_part"), heads)


#: Nodes go up by themselves where there is no pair, so that every level has one, up to the last.
TREE = f"""{CHAIN},
tree as (
  select segment, 0 as "level", entry - 1 idx, sha256('leaf|' || entry_hash) hash from c
  union all
  select segment, "level" + 1, idx // 2, case when count(*) = 2 then sha256('node|' || string_agg(hash, '' order by idx)) else min(hash) end
  from tree where "level" < 24 group by segment, "level", idx // 2)"""


@query(f"""with recursive {TREE}
select segment, count(*) filter ("level" = 0) n_entries, max(hash) filter ("level" = 24) root from tree group by segment""")
def aud01_root(spark, sf_dir):
    return audit.roots(audit.merkle_tree(_log(spark, sf_dir)))


@query(f"""with recursive {TREE},
p as (select c.id, t."level", t.hash, t.idx % 2 = 0 on_left from c join tree t on t.segment = c.segment and t.idx = xor((c.entry - 1) >> t."level", 1))
select id, count(*) n_hashes, sha256(string_agg(case when on_left then 'l' else 'r' end || hash, '' order by "level")) proof_sha256, true ok from p group by id""")
def aud01_proof(spark, sf_dir):
    """Every entry's proof, and whether it leads to the root."""
    log = stored(_log(spark, sf_dir), "log")
    tree = audit.merkle_tree(log)
    proofs = audit.prove(tree, log.select("segment", "entry", "id", "entry_hash"))
    text = F.array_join(F.transform("proof", lambda s: F.concat(F.when(s["on_left"], "l").otherwise("r"), s["hash"])), "")
    # a row for each segment
    checked = proofs.join(F.broadcast(audit.roots(tree)), "segment")
    return checked.select("id", F.size("proof").cast("long").alias("n_hashes"), F.sha2(text, 256).alias("proof_sha256"), (audit.root_of(F.col("entry_hash"), F.col("proof")) == F.col("root")).alias("ok"))


@query("""select o_orderkey id, o_orderpriority symbol, case when o_orderkey % 3 = 0 then 'ALERT' else 'CONFIG_CHANGE' end event_type from orders
where o_orderkey % 3 = 0 and o_orderpriority = '1-URGENT' and cast(o_orderdate as date) between date '1994-01-01' and date '1995-06-30'""")
def srt06_audit(spark, sf_dir):
    """Entries of a type, a symbol and a time from a log clustered by all three."""
    path = shared_path(spark, "audit-curve")
    kind = F.when(F.col("id") % 3 == 0, "ALERT").otherwise("CONFIG_CHANGE")
    layout.write_audit(_audit_events(spark, sf_dir).withColumn("event_type", kind), path, files=16)
    days = lambda y, m, d: (date(y, m, d) - date(1970, 1, 1)).days * 86_400_000
    found = layout.audit_history(spark, path, "ALERT", "1-URGENT", days(1994, 1, 1), days(1995, 6, 30))
    return found.select("id", "symbol", "event_type")


@query("select o_orderkey id, 'user-' || o_custkey actor from orders order by o_orderkey desc limit 100")
def srt03_audit_topk(spark, sf_dir):
    return A.page(_audit_events(spark, sf_dir), [F.desc("id")], 100).select("id", "actor")


def _drawn_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings for the symbols traded in all but the first: the largest quantity as threshold, their number of trades (100 at most) as warm-up."""
    t = V.trades(spark, sf_dir).filter("symbol <> 'BTCUSDT'")
    return t.groupBy("symbol").agg(F.max("quantity").alias("z_threshold"), F.lit(0.2).alias("ewma_alpha"), F.least(F.count("*"), F.lit(100)).cast("int").alias("min_trades"))


DRAWN = "drawn as (select symbol, max(quantity) z_threshold, 0.2::double ewma_alpha, least(count(*), 100)::integer min_trades from trades where symbol <> 'BTCUSDT' group by symbol)"


@query(f"with {V.TRADES}, {V.CONFIGS}, {DRAWN} select * from drawn union all select * from configs where symbol not in (select symbol from drawn)")
def dml01_upsert(spark, sf_dir):
    return tables.upsert(V.configs(spark), _drawn_settings(spark, sf_dir), ["symbol"])


@query(f"""with {V.TRADES}, s as (select symbol, max(quantity) top, count(*) n from trades where symbol <> 'BTCUSDT' group by symbol)
select cast(row_number() over (order by symbol) + 40 as bigint) id, 'CONFIG_CHANGE' event_type, 'ann' actor, symbol, n min_trades, top z_threshold from s""")
def dml01_config_audit(spark, sf_dir):
    """New settings for the symbols that were traded: their audit entries, and what the table then holds."""
    t = V.trades(spark, sf_dir).filter("symbol <> 'BTCUSDT'").groupBy(F.lower("symbol").alias("symbol"))
    changes = t.agg(F.max("quantity").alias("z_threshold"), F.lit(0.2).alias("ewma_alpha"), F.count("*").cast("int").alias("min_trades"))
    table, entries = tables.configure(V.configs(spark), changes, "ann", F.lit(V.NOW_MS), first_id=41)
    said = F.get_json_object("details", "$.min_trades").cast("long").alias("min_trades")
    return entries.select("id", "event_type", "actor", "symbol", said).join(table.select("symbol", "z_threshold"), "symbol")


@query(f"""with {V.TRADES} select strftime(make_timestamp(trade_time_ms * 1000), '%Y-%m-%d') ingest_date, symbol, count(*) n, sum(trade_id)::bigint ids from trades
where trade_time_ms >= 1704844800000 and trade_time_ms < 1705708800000 and symbol = 'BNBUSDT' group by all""")
def dml04_archive(spark, sf_dir):
    """Trades written by day and read back for ten of them."""
    path = shared_path(spark, "archive")
    tables.write_archive(V.trades(spark, sf_dir), path, files=8, time_ms="trade_time_ms")
    kept = spark.read.parquet(path).filter("ingest_date >= date'2024-01-10' and ingest_date < date'2024-01-20' and symbol = 'BNBUSDT'")
    return kept.groupBy(F.col("ingest_date").cast("string").alias("ingest_date"), "symbol").agg(F.count("*").alias("n"), F.sum("trade_id").alias("ids"))


@query(f"with {V.TRADES}, {V.CONFIGS}, {DRAWN} select * from configs union all select * from drawn where symbol not in (select symbol from configs)")
def dml03_seed(spark, sf_dir):
    return tables.seed(V.configs(spark), _drawn_settings(spark, sf_dir), ["symbol"])


@query(f"""with {V.TRADES}, {V.CONFIGS}, {DRAWN}, w as (select * from drawn union all select * from configs where symbol not in (select symbol from drawn))
select symbol, z_threshold, row_number() over (order by symbol) place from w""")
def srt02_configs(spark, sf_dir):
    """The settings in the order in which they are listed, with their places."""
    table = tables.upsert(V.configs(spark), _drawn_settings(spark, sf_dir), ["symbol"])
    return tables.numbered(table.orderBy("symbol"), ["symbol"], "place").select("symbol", "z_threshold", "place")


@query(f"""with recursive {V.TRADES}, {V.SCORED}, {LAST}
select symbol, case when symbol = 'ETHUSDT' then 7::bigint else trade_count end trade_count from last""")
def dml02_state_upsert(spark, sf_dir):
    states = scoring.final_state(V.scored(spark, sf_dir))
    change = spark.createDataFrame([("ETHUSDT", 1.0, 0.5, 7)], states.schema)
    return tables.upsert(states, change, ["symbol"]).select("symbol", "trade_count")


@query(f"""with {V.TRADES}, u as (select t.*, e.user_id from trades t join events e on e.event_id = t.trade_id)
select user_id, max_by(trade_id, (trade_time_ms, trade_id)) trade_id, max(trade_time_ms) trade_time_ms, count(distinct user_id) over () total from u group by user_id""")
def dml02_snapshots(spark, sf_dir):
    """Each user's last trade, merged from four stretches of time as four versions, and their number by the manifest."""
    path = shared_path(spark, "last-trades")
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("trade_id"), "user_id")
    t = stored(V.trades(spark, sf_dir).select("trade_id", "trade_time_ms").join(users, "trade_id"), "user-trades")
    ends = t.agg(F.min("trade_time_ms").alias("a"), F.max("trade_time_ms").alias("b")).first()
    step = (ends["b"] - ends["a"]) // 4 + 1
    for k in range(4):
        some = t.filter(F.floor((F.col("trade_time_ms") - ends["a"]) / step) == k)
        last = F.max_by(F.struct("trade_id", "trade_time_ms"), F.struct("trade_time_ms", "trade_id")).alias("s")
        snapshots.merge(path, some.groupBy("user_id").agg(last).select("user_id", "s.*"), ["user_id"], 16)
        snapshots.expire(path, 2)
    now = snapshots.snapshot(path)
    return now.rows(spark).withColumn("total", F.lit(now.total).cast("long"))


@query(f"""with recursive {V.TRADES}, {V.SCORED}, {V.CONFIGS}
select s.symbol, count(*) n from scored s left join configs c using (symbol)
where trade_count >= 10 and abs(z_score) >= case when s.symbol = 'ETHUSDT' then 6 else coalesce(z_threshold, 3) end group by 1""")
def dml05_threshold_change(spark, sf_dir):
    changed = tables.upsert(V.configs(spark), spark.createDataFrame([("ETHUSDT", 6.0, 0.1, 10)], V.configs(spark).schema), ["symbol"])
    judged = scoring.with_thresholds(V.scored(spark, sf_dir), V.CONFIG, changed)
    return judged.filter("is_toxic").groupBy("symbol").agg(F.count("*").alias("n"))


#: Every 40th trade changes its symbol's settings; some leave values as they are.
AS_OF = """
change as (
  select symbol, trade_time_ms at_ms, trade_id change_id, case when trade_id % 120 > 0 then 2::double + trade_id // 40 % 5 / 2::double end z_threshold,
         case when trade_id % 200 > 0 then (1 + trade_id // 40 % 3) / 10::double end ewma_alpha, (10 + trade_id // 40 % 50)::integer min_trades
  from trades where trade_id % 40 = 0),
base as (
  select *, trade_time_ms at_ms, 1 kind, trade_id seq, null::double z_threshold, null::double ewma_alpha, null::integer min_trades from trades
  union all by name select symbol, at_ms, 0 kind, change_id seq, z_threshold, ewma_alpha, min_trades from change),
known as (
  select * exclude (z_threshold, ewma_alpha, min_trades),
    coalesce(last_value(z_threshold ignore nulls) over w, case when symbol = 'DOGEUSDT' then 2.5::double else 3::double end) z_threshold,
    coalesce(last_value(ewma_alpha ignore nulls) over w, 0.1::double) ewma_alpha, coalesce(last_value(min_trades ignore nulls) over w, 10) min_trades
  from base window w as (partition by symbol order by at_ms, kind, seq rows between unbounded preceding and current row)),
t as (select *, case when is_buyer_maker then -quantity else quantity end x, row_number() over (partition by symbol order by trade_time_ms, trade_id) n from known where kind = 1),
r as (select symbol, n, x ewma, 0::double ewma_var from t where n = 1
      union all
      select t.symbol, t.n, t.ewma_alpha * t.x + (1 - t.ewma_alpha) * r.ewma,
             t.ewma_alpha * ((t.x - r.ewma) * (t.x - r.ewma)) + (1 - t.ewma_alpha) * r.ewma_var
      from r join t on t.symbol = r.symbol and t.n = r.n + 1),
s as (select t.*, r.ewma, r.ewma_var, case when t.n = 1 then 0::double else r.ewma / sqrt(greatest(r.ewma_var, 1e-12::double)) end z_score
      from t join r on t.symbol = r.symbol and t.n = r.n)"""
AS_OF_ROWS = f"""with recursive {V.TRADES}, {AS_OF}
select trade_id, symbol, ewma, z_score, z_threshold, min_trades, n >= min_trades and abs(z_score) >= z_threshold is_toxic from s"""


def _changes(trades: DataFrame) -> DataFrame:
    """Changes of settings, drawn from the trades."""
    i = F.col("trade_id")
    step = F.floor(i / 40)
    return trades.filter(i % 40 == 0).select(
        "symbol",
        F.col("trade_time_ms").alias("at_ms"),
        i.alias("change_id"),
        F.when(i % 120 > 0, 2.0 + step % 5 / 2.0).alias("z_threshold"),
        F.when(i % 200 > 0, (1 + step % 3) / 10.0).alias("ewma_alpha"),
        (10 + step % 50).cast("int").alias("min_trades"),
    )


@query(AS_OF_ROWS)
def dml05_as_of(spark, sf_dir):
    """Each trade under the settings that held at its time."""
    t = V.trades(spark, sf_dir)
    known = scoring.settings_as_of(t, _changes(t), V.CONFIG)
    return scoring.judged(scoring.score_trades(known, V.CONFIG)).select("trade_id", "symbol", "ewma", "z_score", "z_threshold", "min_trades", "is_toxic")


# ---- metrics ----


SIZES = ", ".join(f"count(*) filter (n_messages <= {b}) le_{b}" for b in metrics.BATCH_BUCKETS)


@query(f"""with {V.TRADES}, b as (select exchange, trade_id // 500 batch, count(*) n_messages from trades group by all)
select exchange, {SIZES}, cast(sum(n_messages) as bigint) total, count(*) n from b group by exchange""")
def agg08_batch_hist(spark, sf_dir):
    batch = F.floor(F.col("trade_id") / 500).alias("batch")
    batches = V.trades(spark, sf_dir).groupBy("exchange", batch).agg(F.count("*").alias("n_messages"))
    return metrics.histogram(batches, ["exchange"], "n_messages", metrics.BATCH_BUCKETS)


@query(f"""with {V.TRADES}, {V.RAW} select count(*) filter (reason is null) published, count(*) filter (reason is not null) dead_lettered,
cast(sum(length('raw-' || trade_id)) filter (reason is null) as bigint) n_bytes from raw""")
def agg10_producer_counters(spark, sf_dir):
    good = F.col("reason").isNull()
    sizes = F.when(good, F.octet_length("payload"))
    return V.normalized(spark, sf_dir).agg(
        F.count_if(good).alias("published"), F.count_if(~good).alias("dead_lettered"), F.sum(sizes).cast("long").alias("n_bytes")
    )


@query(f"with {V.TRADES}, {V.RAW} select coalesce(reason, 'ok') outcome, count(*) n from raw group by 1")
def agg06_counters(spark, sf_dir):
    marked = V.normalized(spark, sf_dir).withColumn("outcome", F.coalesce("reason", F.lit("ok")))
    return metrics.counters(marked, ["outcome"])


@query(f"""with {V.TRADES} select trade_id % 6 batch, case trade_id % 3 when 0 then 'published' when 1 then 'dead_lettered' else 'dropped' end outcome,
case trade_id % 6 when 0 then 1 when 3 then 2 else 3 end attempts, case when trade_id % 3 < 2 then count(*) else 0 end n_rows from trades group by 1, 2, 3, trade_id % 3""")
def snk07_outcomes(spark, sf_dir):
    """Six batches through a sink that fails: at once, never, always, and with its dead letters."""
    good, dead = shared_path(spark, "sent"), shared_path(spark, "dead")
    tried, told = {}, []

    def send(batch: DataFrame, n: int) -> None:
        tried[n] = tried.get(n, 0) + 1
        if n % 3 or (n == 3 and tried[n] == 1):
            raise ConnectionError("the sink is down")
        batch.write.parquet(f"{good}/batch={n}")

    def bury(batch: DataFrame, n: int) -> None:
        if n % 3 == 2:
            raise ConnectionError("the dead letters are down, too")
        batch.write.parquet(f"{dead}/batch={n}")

    write = retrying(send, bury, retries=2, base_s=0.0, told=lambda *x: told.append(x))
    t = V.trades(spark, sf_dir)
    for n in range(6):
        write(t.filter(F.col("trade_id") % 6 == n), n)
    outcomes = spark.createDataFrame(told, "batch long, outcome string, attempts int")
    rows = spark.read.parquet(good).unionByName(spark.read.parquet(dead)).groupBy("batch").agg(F.count("*").alias("n_rows"))
    return outcomes.join(rows, "batch", "left").select("batch", "outcome", "attempts", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))


@query(f"""with {V.TRADES} select trade_id, case when trade_id % 7 = 0 then 'DLQ ' else '' end || '{{"trade_id":' || trade_id || ',"symbol":"' || symbol || '","side":"' || side || '"}}' line from trades""")
def snk02_lines(spark, sf_dir):
    """Trades as JSON lines, dead letters with their prefix."""
    t = V.trades(spark, sf_dir).select("trade_id", "symbol", "side")
    lines = ndjson(t.filter("trade_id % 7 <> 0")).unionByName(ndjson(t.filter("trade_id % 7 = 0"), "DLQ "))
    return lines.select(F.regexp_extract("value", '"trade_id":([0-9]+)', 1).cast("long").alias("trade_id"), F.col("value").alias("line"))


@query(f"with {V.TRADES}, {V.RAW} select coalesce(reason, 'ok') outcome, count(*) n from raw group by 1")
def agg06_observed(spark, sf_dir):
    """The same counters from the writer of a stream, which counts what passes by, a row a batch."""
    source, good, bad, counts, offsets = (shared_path(spark, n) for n in ("raw", "accepted", "rejected", "outcomes", "split-offsets"))
    raw = V.raw_trades(spark, sf_dir)
    raw.repartitionByRange(3, "trade_id").write.parquet(source)
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(source)
    writer = stream.writeStream.foreachBatch(split_writer(good, bad, NormalizeConfig(), counts))
    writer.option("checkpointLocation", offsets).trigger(availableNow=True).start().awaitTermination()
    kinds = ("ok", *REASONS)
    rows = spark.read.schema(", ".join(f"{k} long" for k in kinds)).json(counts)
    total = rows.agg(*[F.sum(k).alias(k) for k in kinds])
    return total.unpivot([], list(kinds), "outcome", "n").filter("n > 0")


@query(f"with {V.TRADES} select exchange, symbol, side, count(*) n from trades group by grouping sets ((exchange, symbol), (exchange, side), ())")
def agg06_grouping_sets(spark, sf_dir):
    return metrics.counter_sets(V.trades(spark, sf_dir), [["exchange", "symbol"], ["exchange", "side"], []])


LATENCIES = ", ".join(f"count(*) filter (secs <= {b}) le_{str(b).replace('.', '_')}" for b in metrics.LATENCY_BUCKETS)


@query(f"with {V.TRADES} select exchange, {LATENCIES}, sum(secs) total, count(*) n from (select exchange, (trade_id % 4096) / 256.0::double secs from trades) group by exchange")
def agg08_latency_hist(spark, sf_dir):
    timed = V.trades(spark, sf_dir).withColumn("seconds", (F.col("trade_id") % 4096) / 256.0)
    return metrics.histogram(timed, ["exchange"], "seconds", metrics.LATENCY_BUCKETS)


@query(f"""with {V.TRADES}, b as (select trade_id // 100 batch, count(*) n, sum(length(symbol))::bigint w from trades group by 1),
o as (select *, case when batch % 11 = 0 then 'dropped' when batch % 7 = 0 then 'dead_lettered' else 'published' end outcome, 1 + batch % 3 attempts from b)
select coalesce(sum(n) filter (outcome = 'published'), 0)::bigint published, count(*) batches, sum(attempts - 1)::bigint retries, count(*) filter (outcome <> 'published') failed,
  coalesce(sum(n) filter (outcome = 'dead_lettered'), 0)::bigint dead_lettered, coalesce(sum(n) filter (outcome = 'dropped'), 0)::bigint dropped,
  coalesce(sum(w) filter (outcome = 'published'), 0)::bigint n_bytes from o""")
def agg10_batch_counters(spark, sf_dir):
    batch = F.floor(F.col("trade_id") / 100).alias("batch")
    sent = V.trades(spark, sf_dir).groupBy(batch).agg(F.count("*").alias("n_messages"), F.sum(F.length("symbol")).alias("n_bytes"))
    outcome = F.when(F.col("batch") % 11 == 0, "dropped").when(F.col("batch") % 7 == 0, "dead_lettered").otherwise("published")
    return metrics.producer_counters(sent.withColumn("outcome", outcome).withColumn("attempts", 1 + F.col("batch") % 3))


LAGS = ", ".join(f"count(*) filter (lag_ms <= {b}) le_{b}" for b in metrics.LAG_BUCKETS)


@query(f"with {V.TRADES} select symbol, {LAGS}, cast(sum(lag_ms) as bigint) total, count(*) n from (select symbol, (trade_id * 37) % 40000 lag_ms from trades) group by symbol")
def agg07_lag_hist(spark, sf_dir):
    t = V.trades(spark, sf_dir)
    lag = S.lag_ms(F.col("trade_time_ms") + (F.col("trade_id") * 37) % 40000, F.col("trade_time_ms"))
    return metrics.histogram(t.withColumn("lag_ms", lag), ["symbol"], "lag_ms")


@query(f"with {V.TRADES} select trade_time_ms // 15000 * 15000 window_start_ms, exchange, count(*) n, count(*) / 15.0::double per_second from trades group by all")
def agg09_throughput(spark, sf_dir):
    return metrics.throughput(V.trades(spark, sf_dir), F.timestamp_millis("trade_time_ms"), ["exchange"])


@query(f"""with {V.TRADES} select symbol, cast(sum(length('binance:' || symbol) + length('trade-' || trade_id) + 8 + 7 + 6 + length(symbol)) as bigint) n_bytes
from trades group by symbol""")
def agg11_msg_size(spark, sf_dir):
    headers = S.header_map(exchange=F.col("exchange"), symbol=F.col("symbol"))
    value = F.concat(F.lit("trade-"), F.col("trade_id").cast("string"))
    size = metrics.message_size(S.partition_key(F.col("exchange"), F.col("symbol")), value, headers)
    return V.trades(spark, sf_dir).groupBy("symbol").agg(F.sum(size).alias("n_bytes"))


@query(f"with {V.TRADES} select trade_id, row_number() over (order by trade_time_ms, trade_id) sequence from trades")
def agg13_sequence(spark, sf_dir):
    return tables.numbered(V.trades(spark, sf_dir), ["trade_time_ms", "trade_id"]).select("trade_id", "sequence")


@query(f"with {V.TRADES} select symbol, count(*) filter (side = 'BUY') / count(*)::double buy_share from trades group by symbol")
def agg15_imbalance(spark, sf_dir):
    return metrics.imbalance(V.trades(spark, sf_dir), ["symbol"])


# ---- sources ----


def _lines(spark: SparkSession, sf_dir: str, quote: bool) -> DataFrame:
    fields = ["trade_id", "price", "quantity", *(["quote_quantity"] if quote else []), "trade_time_ms", "is_buyer_maker"]
    text = [F.col(c).cast("string") for c in fields]
    broken = F.when(F.col("trade_id") % 41 == 0, F.lit("not-an-id")).otherwise(text[0])
    return V.trades(spark, sf_dir).select(F.concat_ws(",", broken, *text[1:], F.lit("true")).alias("value"), "symbol")


READ = "select trade_id, price::varchar::double price_read, is_buyer_maker, trade_time_ms from trades where trade_id % 41 <> 0"


@query(f"with {V.TRADES} {READ}")
def src05_alias(spark, sf_dir):
    positions = csv_trades.column_positions("ID,Price,Qty,quote-Qty,Time,is_Buyer_Maker,isBestMatch", 7, "trades")
    raw = csv_trades.readable(csv_trades.parse_lines(_lines(spark, sf_dir, True), "value", positions, F.col("symbol"), "binance"))
    return raw.select("trade_id", S.parse_number(F.col("price")).alias("price_read"), "is_buyer_maker", "trade_time_ms")


@query(f"with {V.TRADES} {READ}")
def src05_alias_short(spark, sf_dir):
    """Headers of single letters: a for the id, m for the maker, T for the time."""
    fields = ["trade_id", "price", "quantity", "trade_time_ms", "is_buyer_maker"]
    text = [F.col(c).cast("string") for c in fields]
    lines = V.trades(spark, sf_dir).filter("trade_id % 41 <> 0").select(F.concat_ws(",", *text).alias("value"), "symbol")
    raw = csv_trades.readable(csv_trades.parse_lines(lines, "value", csv_trades.column_positions("a,p,q,T,m", 5, "aggTrades"), F.col("symbol"), "binance"))
    return raw.select("trade_id", S.parse_number(F.col("price")).alias("price_read"), "is_buyer_maker", "trade_time_ms")


@query(f"""with {V.TRADES} select 'BTCUSDT' symbol, count(*) n_rows, count(*) filter (trade_id % 41 = 0) n_skipped, count(*) filter (is_buyer_maker and trade_id % 41 <> 0) n_sold,
max(case when trade_id % 41 <> 0 then trade_time_ms end) last_ms from trades""")
def src02_quotes(spark, sf_dir):
    """Files of two layouts, one with quoted fields that hold commas; broken rows are counted."""
    path = shared_path(spark, "dump")
    t = V.trades(spark, sf_dir)
    i = F.when(F.col("trade_id") % 41 == 0, F.lit("not-an-id")).otherwise(F.col("trade_id").cast("string"))
    even = t.filter("trade_id % 2 = 0").select(F.concat_ws(",", F.lit('"a, note"'), i, "price", "quantity", "trade_time_ms", "is_buyer_maker").alias("value"))
    odd = t.filter("trade_id % 2 = 1").select(F.concat_ws(",", i, "price", "quantity", F.lit("1"), "trade_time_ms", "is_buyer_maker", F.lit("true")).alias("value"))
    for name, rows in (("noted", even), ("plain", odd)):
        head = spark.createDataFrame([('"some, note",id,price,qty,time,m', 0)] if name == "noted" else [], "value string, n int")
        body = rows.select("value", F.lit(1).alias("n"))
        head.unionByName(body).coalesce(1).sortWithinPartitions("n").select("value").write.text(f"{path}/{name}.csv")
    raw = csv_trades.parse_files(spark, f"{path}/*.csv", FeedConfig(symbols=("BTCUSDT",)))
    counted = csv_trades.skipped(raw)
    read = csv_trades.readable(raw).groupBy("symbol").agg(F.count_if("is_buyer_maker").alias("n_sold"), F.max("trade_time_ms").alias("last_ms"))
    return counted.join(read, "symbol")


@query(f"with {V.TRADES} {READ}")
def src08_agg_trades(spark, sf_dir):
    header = "aggTradeId,price,quantity,firstTradeId,lastTradeId,transactTime,isBuyerMaker,isBestMatch"
    i = F.when(F.col("trade_id") % 41 == 0, "not-an-id").otherwise(F.col("trade_id").cast("string"))
    parts = [i, *[F.col(c).cast("string") for c in ("price", "quantity", "trade_id", "trade_id", "trade_time_ms", "is_buyer_maker")], F.lit("true")]
    lines = V.trades(spark, sf_dir).select(F.concat_ws(",", *parts).alias("value"), "symbol")
    positions = csv_trades.column_positions(header, 8, csv_trades.layout_of(header))
    raw = csv_trades.readable(csv_trades.parse_lines(lines, "value", positions, F.col("symbol"), "binance"))
    return raw.select("trade_id", S.parse_number(F.col("price")).alias("price_read"), "is_buyer_maker", "trade_time_ms")


@query(f"with {V.TRADES} select trade_id, price::varchar::double price_read, is_buyer_maker, trade_time_ms from trades where trade_id % 41 <> 0")
def src07_positional(spark, sf_dir):
    positions = csv_trades.column_positions(None, 6, "trades")
    raw = csv_trades.readable(csv_trades.parse_lines(_lines(spark, sf_dir, False), "value", positions, F.col("symbol"), "binance", plain_time=True))
    return raw.select("trade_id", S.parse_number(F.col("price")).alias("price_read"), "is_buyer_maker", "trade_time_ms")


@query(f"""with {V.TRADES}, o as (select trade_id, row_number() over (order by trade_time_ms, trade_id) number from trades),
m as (select *, count(*) over () n from o where number >= 101), p as (select trade_id, pass, pass * n + number - 101 k from m, (select unnest([0, 1, 2]) pass))
select trade_id, cast(pass as integer) pass from p where k < 2000""")
def src09_slice_loop(spark, sf_dir):
    rows = tables.numbered(V.trades(spark, sf_dir), ["trade_time_ms", "trade_id"], "number")
    return tables.replay(rows, "number", start_row=101, max_rows=2000, passes=3).select("trade_id", "pass")


@query(f"""with {V.TRADES} select case when trade_id % 2 = 0 then symbol else 'BTCUSDT' end symbol, count(*) n from trades group by 1""")
def src11_symbol_from_path(spark, sf_dir):
    name = F.when(F.col("trade_id") % 2 == 0, F.concat(F.lit("/data/"), F.lower("symbol"), F.lit("-trades-2024-01-01.csv")))
    path = name.otherwise("/data/sample_binance_trades.csv")
    found = V.trades(spark, sf_dir).select(S.symbol_of_path(path, ["btc-usdt"]).alias("symbol"))
    return found.groupBy("symbol").agg(F.count("*").alias("n"))


@query(f"""with {V.TRADES} select case when trade_id % 9 = 0 then null else trade_id end trade_id, symbol, trade_time_ms, trade_id % 9 = 0 bad from trades""")
def src16_frame_decode(spark, sf_dir):
    i = F.col("trade_id")
    kind = F.when(i % 9 == 0, "depth").when(i % 2 == 0, "trade").otherwise("aggTrade")
    event = F.struct(
        kind.alias("e"),
        F.when(i % 2 == 1, i).alias("a"),
        F.when(i % 2 == 0, i).alias("t"),
        F.col("symbol").alias("s"),
        F.col("price").cast("string").alias("p"),
        F.col("quantity").cast("string").alias("q"),
        F.col("trade_time_ms").alias("T"),
        F.col("is_buyer_maker").alias("m"),
    )
    bare = F.to_json(event)
    wrapped = F.concat(F.lit('{"stream":"x@aggTrade","data":'), bare, F.lit("}"))
    sent = V.trades(spark, sf_dir).select(F.when(i % 3 == 0, bare).otherwise(wrapped).alias("value"))
    return frames.decode_frames(sent, now_ms=F.lit(V.NOW_MS)).select("trade_id", "symbol", "trade_time_ms", F.col("error").isNotNull().alias("bad"))


@query(f"""with {V.TRADES} select trade_id, case when trade_id % 3 = 0 then 'no id' when trade_id % 5 = 0 then 'no price' when trade_id % 7 = 0 then 'no time' end error from trades""")
def src17_strict_frames(spark, sf_dir):
    """Frames without an id, a price or a time are errors where that is asked for."""
    i = F.col("trade_id")
    event = F.struct(
        F.lit("aggTrade").alias("e"), F.when(i % 3 > 0, i).otherwise(0).alias("a"), F.col("symbol").alias("s"), F.when(i % 5 == 0, "").otherwise("1.5").alias("p"),
        F.when(i % 7 > 0, F.col("trade_time_ms")).alias("T"), i.alias("id"),
    )
    sent = V.trades(spark, sf_dir).select(F.to_json(event).alias("value"))
    found = frames.decode_frames(sent, strict=True, now_ms=F.lit(V.NOW_MS))
    return found.select(F.get_json_object("payload", "$.id").cast("long").alias("trade_id"), "error")


@query(f"with {V.TRADES} select trade_id, symbol from trades")
def src18_backfill(spark, sf_dir):
    t = V.trades(spark, sf_dir).select("exchange", "symbol", "trade_id", "trade_time_ms")
    both = frames.with_backfill(t.filter("trade_id <= 1000"), t.filter("trade_id > 500"))
    return dedup.first_of_each(both, [F.col("trade_time_ms")]).select("trade_id", "symbol")


@query(f"""with {V.TRADES} select trade_id, exchange || ':' || symbol "key", 9 n_headers,
'content-type=application/json;event_id=e' || trade_id || ';exchange=' || exchange || ';ingested_at_ms=' || {V.NOW_MS} || ';schema_version=1.0.0;side=' || side
|| ';source=csv;symbol=' || symbol || ';trade_time_ms=' || trade_time_ms headers from trades""")
def snk04_kafka_rows(spark, sf_dir):
    """Key, JSON value and sorted headers of the messages that a Kafka sink is given."""
    more = {"schema_version": F.lit("1.0.0"), "event_id": F.concat(F.lit("e"), F.col("trade_id").cast("string")), "source": F.lit("csv"), "ingested_at_ms": F.lit(V.NOW_MS)}
    rows = brokers.kafka_rows(V.trades(spark, sf_dir).withColumns(more))
    said = F.array_join(F.transform("headers", lambda h: F.concat(h["key"], F.lit("="), h["value"].cast("string"))), ";")
    return rows.select(F.get_json_object("value", "$.trade_id").cast("long").alias("trade_id"), "key", F.size("headers").alias("n_headers"), said.alias("headers"))


# ---- streams ----


@query(f"with {V.TRADES} select trade_id, symbol, price, is_buyer_maker, trade_time_ms from trades")
def src10_replay_stream(spark, sf_dir):
    """The trades replayed as a stream that is stopped and started again until it has admitted all."""
    path, out, offsets = (shared_path(spark, n) for n in ("recorded", "replayed", "replay-offsets"))
    t = V.trades(spark, sf_dir)
    replay.prepare_replay(t, path, speed=0.0)
    runs = 5
    for _ in range(runs):
        stream = replay.replay_stream(spark, path, f"{offsets}-progress/at.json", -(-t.count() // runs))
        writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", offsets)
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("trade_id", "symbol", "price", "is_buyer_maker", "trade_time_ms")


def _arriving(spark: SparkSession, rows: DataFrame, time: str, arrival: Column | None, ends: Row) -> DataFrame:
    """Rows as a stream of files. With ``arrival`` (milliseconds after their time) they come in that order, a tenth of the time a trigger."""
    path = shared_path(spark, "stream-in")
    if arrival is None:
        rows.repartitionByRange(3, time).write.parquet(path)
        return spark.readStream.schema(rows.schema).parquet(path)
    dealt, turns = rows.withColumn("_turn", F.floor((F.col(time) + arrival - ends["a"]) * 10 / (ends["b"] - ends["a"]))), shared_path(spark, "arrivals")
    dealt.write.partitionBy("_turn").parquet(turns)
    # a folder for each turn: what a turn brings is read once, not once for every turn
    held = spark.read.schema(dealt.schema).parquet(turns)
    for turn in range(12):
        held.filter(F.col("_turn") == turn).drop("_turn").coalesce(1).write.mode("append").parquet(path)
    if time == "trade_time_ms":  # a last trade of no symbol lets the watermark pass all others
        last = rows.limit(1).withColumns({"symbol": F.lit("~"), time: F.lit(ends["b"] * 2)})
        last.write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run_to_end(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """What a stream with keyed state gives until its source is read."""
    out, offsets = shared_path(spark, "stream-out"), shared_path(spark, "stream-offsets")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", offsets)
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.parquet(out)


def _ends(trades: DataFrame) -> Row:
    return trades.agg(F.min("trade_time_ms").alias("a"), F.max("trade_time_ms").alias("b")).first()


def _run_stream(spark: SparkSession, trades: DataFrame, changes: DataFrame | None = None, arrival: Column | None = None, **options) -> DataFrame:
    """The trades as a stream of files, scored with keyed state; the stream is run to its end."""
    ends = _ends(trades)
    if changes is not None:
        options["changes"] = _arriving(spark, changes, "at_ms", arrival, ends)
    return _run_to_end(spark, score_stream(_arriving(spark, trades, "trade_time_ms", arrival, ends), V.CONFIG, **options))


@query(f"""with recursive {V.TRADES}, o as (select distinct symbol, trade_time_ms t from trades),
r as (select symbol, min(t) t from o group by symbol
      union all select r.symbol, min(o.t) from r join o on o.symbol = r.symbol and o.t >= r.t + 3600000 group by r.symbol)
select symbol, t kept_ms from r""")
def agg01_ttl_stream(spark, sf_dir):
    """TTL suppression of trades that arrive up to a day late, in the order of their times."""
    t = V.trades(spark, sf_dir)
    late = F.pmod(F.xxhash64("trade_id"), F.lit(86_400_000))
    kept = ttl_stream(_arriving(spark, t, "trade_time_ms", late, _ends(t)), 3_600_000, ("symbol",), delay="1 day")
    return _run_to_end(spark, kept).select("symbol", F.col("trade_time_ms").alias("kept_ms"))


@query(f"with {V.TRADES} select trade_id, symbol, price from trades")
def agg01_dedup_stream(spark, sf_dir):
    """Trades that come again in a later trigger, within the delay."""
    t, path = V.trades(spark, sf_dir), shared_path(spark, "repeats")
    t.coalesce(1).write.parquet(path)
    t.filter("trade_id % 7 = 0").withColumn("price", F.lit(-1.0)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return _run_to_end(spark, dedup_stream(stream, "60 days")).select("trade_id", "symbol", "price")


@query(f"with {V.TRADES} select trade_id, symbol, price, trade_time_ms from trades")
def snk12_epochs(spark, sf_dir):
    """Trades through the transactional sink, epoch by epoch, and back from its manifests."""
    path, offsets, source = (shared_path(spark, n) for n in ("epochs", "epoch-offsets", "epoch-in"))
    t = V.trades(spark, sf_dir).select("trade_id", "symbol", "price", "trade_time_ms")
    t.repartitionByRange(4, "trade_id").write.parquet(source)
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(source)
    transactional.write_epochs(stream, path, offsets).trigger(availableNow=True).start().awaitTermination()
    return transactional.read_epochs(spark, path, t.schema)


STREAMED = "trade_id, symbol, ewma, ewma_var, trade_count, z_score"


@query(f"with recursive {V.TRADES}, {V.SCORED} select {STREAMED} from scored")
def str04_stream_score(spark, sf_dir):
    return _run_stream(spark, V.trades(spark, sf_dir), configs=V.configs(spark)).select(*STREAMED.split(", "))


@query(f"""with recursive {V.TRADES}, {V.SCORED},
cut as (select max(trade_time_ms) // 2 + min(trade_time_ms) // 2 cut_ms from trades)
select {STREAMED} from scored, cut where trade_time_ms >= cut_ms""")
def str06_stream_restored(spark, sf_dir):
    """The later half as a stream that starts from the states of the earlier one."""
    before, later = _halves(spark, sf_dir)
    return _run_stream(spark, later, initial=before).select(*STREAMED.split(", "))


@query(f"with recursive {V.TRADES}, {V.SCORED} select {STREAMED} from scored")
def str05_stopped(spark, sf_dir):
    """A stream that is stopped twice and goes on from its checkpoint: no trade is scored twice, none is missing."""
    source, out, offsets = (shared_path(spark, n) for n in ("stopped-in", "stopped-out", "stopped-offsets"))
    t = stored(V.trades(spark, sf_dir).repartitionByRange(6, "trade_time_ms", "trade_id").withColumn("_turn", F.spark_partition_id()), "turns")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(3):
            t.filter(F.floor(F.col("_turn") / 2) == k).drop("_turn").write.mode("append").parquet(source)
            stream = spark.readStream.schema(t.drop("_turn").schema).parquet(source)
            writer = score_stream(stream, V.CONFIG).writeStream.format("parquet").option("path", out)
            writer.option("checkpointLocation", offsets).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.parquet(out).select(*STREAMED.split(", "))


@query(f"with recursive {V.TRADES}, {V.SCORED} select {STREAMED} from scored")
def str03_reordered(spark, sf_dir):
    """Trades that arrive up to a day after their time, out of order over many triggers, scored in the order of their times."""
    late = F.pmod(F.xxhash64("trade_id"), F.lit(86_400_000))
    return _run_stream(spark, V.trades(spark, sf_dir), arrival=late, configs=V.configs(spark), delay="1 day").select(*STREAMED.split(", "))


@query(AS_OF_ROWS)
def dml05_stream(spark, sf_dir):
    """Trades and changes of settings as two streams, both out of order: each trade under the settings that held at its time."""
    t = V.trades(spark, sf_dir)
    late = F.pmod(F.xxhash64("symbol", F.lit(3)), F.lit(43_200_000))
    found = _run_stream(spark, t, _changes(t), arrival=late, delay="1 day")
    return found.select("trade_id", "symbol", "ewma", "z_score", "z_threshold", "min_trades", "is_toxic")
