"""The trade model over the table ``events``, for Spark and as DuckDB SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge import schemas
from flowgauge.config import NormalizeConfig, ScorerConfig
from flowgauge.functions import scalars as S
from flowgauge.operators.alerts import alert_history
from flowgauge.operators.normalize import normalize
from flowgauge.operators.scoring import score_trades, with_thresholds
from flowgauge.operators.tables import numbered
from flowgauge.tables import stored

SYMBOLS = ["BTCUSDT", "ETHUSDT", "DOGEUSDT", "BNBUSDT"]
NOW_MS = 1_706_745_600_000
CONFIG = ScorerConfig()


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided flow with one-sided blocks of 300 ids in every 1,000."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    block = i % 1000
    maker = F.when(block.between(400, 699), F.floor(i / 1000) % 2 == 1).otherwise(F.col("event_type").isin("view", "signup", "error"))
    view = events.select(
        i.alias("trade_id"),
        F.lit("binance").alias("exchange"),
        F.element_at(F.array(*map(F.lit, SYMBOLS)), (F.col("user_id") % 4).cast("int") + 1).alias("symbol"),
        (F.lit(100.0) + F.get_json_object("props", "$.k").cast("double")).alias("price"),
        (F.lit(1.0) + F.col("value") / F.lit(100.0)).alias("quantity"),
        maker.alias("is_buyer_maker"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("trade_time_ms"),
    )
    return view.withColumn("side", S.side_of_maker(F.col("is_buyer_maker"))).withColumn("quote_quantity", F.col("price") * F.col("quantity"))


#: The same rows in DuckDB; epoch_us floors like Spark's milliseconds, epoch_ms rounds.
TRADES = """
trades as (
  select *, case when is_buyer_maker then 'SELL' else 'BUY' end side, price * quantity quote_quantity from (
    select event_id trade_id, 'binance' exchange,
           (['BTCUSDT', 'ETHUSDT', 'DOGEUSDT', 'BNBUSDT'])[user_id % 4 + 1] symbol,
           100::double + cast(json_extract_string(props, '$.k') as double) price,
           1::double + value / 100::double quantity,
           case when event_id % 1000 between 400 and 699 then (event_id // 1000) % 2 = 1
                else event_type in ('view', 'signup', 'error') end is_buyer_maker,
           epoch_us(ts) // 1000 trade_time_ms
    from events))"""


def raw_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text records (schema RAW_TRADE), some of them broken by their id."""
    t, i = trades(spark, sf_dir), F.col("trade_id")
    time = F.when(i % 29 == 0, 0).otherwise(F.col("trade_time_ms")).cast("long")
    mangled = F.concat(F.lit(" "), F.lower(F.substring("symbol", 1, 3)), F.lit("-"), F.lower(F.substring("symbol", 4, 9)))
    return t.select(
        F.lit(" Binance ").alias("exchange"),
        F.when(i % 23 == 0, "").otherwise(mangled).alias("symbol"),
        F.lit("csv").alias("source"),
        "trade_id",
        F.when(i % 17 == 0, "oops").when(i % 31 == 0, "NaN").otherwise(F.col("price").cast("string")).alias("price"),
        F.when(i % 19 == 0, "0").otherwise(F.col("quantity").cast("string")).alias("quantity"),
        F.when(i % 5 == 0, "99999").when(i % 7 == 0, "bad").otherwise("").alias("quote_quantity"),
        "is_buyer_maker",
        time.alias("trade_time_ms"),
        F.when(i % 3 == 0, F.lit(0)).otherwise(time).cast("long").alias("event_time_ms"),
        F.concat(F.lit("raw-"), i.cast("string")).alias("payload"),
    )


RAW = """
raw as (
  select *, case when trade_id % 29 = 0 then 0 else trade_time_ms end at_ms,
    case when trade_id % 23 = 0 then 'empty_symbol' when trade_id % 17 = 0 then 'bad_price'
         when trade_id % 19 = 0 then 'bad_quantity' when trade_id % 29 = 0 then 'bad_timestamp'
         when trade_id % 31 = 0 then 'invalid_trade' end reason,
    case when trade_id % 5 = 0 then 99999::double else price * quantity end quote
  from trades)"""


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(raw_trades(spark, sf_dir), NormalizeConfig(), F.lit(NOW_MS))


def configs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(schemas.SEED_CONFIGS, schemas.SYMBOL_CONFIG)


CONFIGS = """
configs as (
  select * from (values ('BTCUSDT', 3::double, 0.1::double, 10::integer), ('ETHUSDT', 3::double, 0.1::double, 10::integer),
    ('DOGEUSDT', 2.5::double, 0.1::double, 10::integer)) c(symbol, z_threshold, ewma_alpha, min_trades))"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_trades(trades(spark, sf_dir), CONFIG, configs(spark))


#: Needs ``with recursive``. The order of operations is that of the scorer, so that values are equal to the last bit.
SCORED = """
t as (select *, case when is_buyer_maker then -quantity else quantity end x,
             row_number() over (partition by symbol order by trade_time_ms, trade_id) n from trades),
r as (select symbol, n, x ewma, 0::double ewma_var from t where n = 1
      union all
      select t.symbol, t.n, 0.1::double * t.x + (1 - 0.1::double) * r.ewma,
             0.1::double * ((t.x - r.ewma) * (t.x - r.ewma)) + (1 - 0.1::double) * r.ewma_var
      from r join t on t.symbol = r.symbol and t.n = r.n + 1),
scored as (
  select t.*, t.x signed_ofi, r.ewma, r.ewma_var, t.n trade_count,
         case when t.n = 1 then 0::double else r.ewma / sqrt(greatest(r.ewma_var, 1e-12::double)) end z_score
  from t join r on t.symbol = r.symbol and t.n = r.n)"""


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_thresholds(scored(spark, sf_dir), CONFIG, configs(spark)).filter("is_toxic")


TOXIC = """
judged as (
  select s.*, coalesce(c.z_threshold, 3::double) z_threshold, coalesce(c.min_trades, 10) min_trades
  from scored s left join configs c using (symbol)),
toxic as (select * from judged where trade_count >= min_trades and abs(z_score) >= z_threshold)"""


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic trades as stored alerts: numbered by time, with an event_id and a time stamp."""
    found = toxic(spark, sf_dir).select(
        S.uuid5_dns(F.col("trade_id").cast("string")).alias("event_id"),
        *("symbol", "exchange", "z_score", "ewma", "ewma_var", "signed_ofi", "side", "quantity", "price", "trade_time_ms", "trade_id"),
        F.timestamp_millis("trade_time_ms").alias("alerted_at"),
    )
    # stored, so that counting, dealing by ranges and numbering don't score again
    return numbered(stored(found, "alerts"), ["trade_time_ms", "trade_id"], "id")


ALERTS = """
alerts as (
  select *, row_number() over (order by trade_time_ms, trade_id) id, make_timestamp(trade_time_ms * 1000) alerted_at from toxic)"""
ALL = f"with recursive {TRADES}, {SCORED}, {CONFIGS}, {TOXIC}, {ALERTS}"


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_history(
        alerts(spark, sf_dir), " ethusdt ", "2024-01-03 00:00:00", "2024-01-25 00:00:00", min_z=3.0, max_z=20.0
    )
