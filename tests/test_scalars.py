import uuid

import pytest
from pyspark.sql import functions as F

from flowgauge.config import FeedConfig, ScorerConfig, read_env_file
from flowgauge.functions import scalars as S


def values(spark, make, inputs, kind="string"):
    table = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], f"k int, x {kind}")
    return [r[0] for r in table.orderBy("k").select(make(F.col("x"))).collect()]


def test_symbols(spark):
    assert values(spark, S.normalize_symbol, ["btcusdt", " BTC-USDT\t", "eth/usdt", "sol_usdt", ""]) == ["BTCUSDT", "BTCUSDT", "ETHUSDT", "SOLUSDT", ""]
    assert values(spark, S.upper_symbol, [" btc-usdt\n"]) == ["BTC-USDT"]
    assert values(spark, S.normalize_exchange, [" Binance ", "", None]) == ["binance", "unknown", "unknown"]


def test_numbers(spark):
    got = values(spark, S.parse_number, ["65000.25", " 1e3\n", ".5", "abc", "", None, "1.0d", "0x1p3", "1_000", "1e400", "Inf", "-5"])
    assert got == [65000.25, 1000.0, 0.5, None, None, None, None, None, None, None, float("inf"), -5.0]
    assert str(values(spark, S.parse_number, ["NaN"])[0]) == "nan"


def test_times(spark):
    got = values(spark, S.parse_time_ms, ["1704153600000", "1704153600", "1704153600.5", "2024-01-02T00:00:00Z", "2024-01-02 00:00:00", "yesterday", ""])
    assert got == [1704153600000, 1704153600000, 1704153600500, 1704153600000, 1704153600000, None, None]


def test_flags(spark):
    assert values(spark, S.parse_flag, ["1", "T", "true", "Y", "yes", "0", "no", "", None]) == [True] * 5 + [False] * 4


def test_signed_ofi(spark):
    rows = [("BUY", 5.0, 1.0), ("sell", 2.0, 1.0), ("HOLD", 2.0, 1.0), ("BUY", -1.0, 1.0), ("BUY", float("nan"), 1.0), ("BUY", float("inf"), 1.0), ("BUY", 1.0, float("nan")), (None, 1.0, 1.0), ("BUY", None, 1.0)]
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, s string, q double, p double")
    got = [r[0] for r in table.orderBy("k").select(S.signed_ofi(F.col("s"), F.col("q"), F.col("p"))).collect()]
    assert got == [5.0, -2.0] + [0.0] * 7


def test_routing_and_backoff(spark):
    rows = [(0, "binance", "BTCUSDT", None), (1, None, None, None), (2, "", "", "coinbase:ETHUSDT"), (3, None, None, "odd")]
    table = spark.createDataFrame(rows, "k int, e string, s string, p string").orderBy("k")
    got = [r[0] for r in table.select(S.routing_key(F.col("e"), F.col("s"), F.col("p"))).collect()]
    assert got == ["trade.binance.btcusdt", "trade.unknown.unknown", "trade.coinbase.ethusdt", "trade.unknown.unknown"]
    assert values(spark, lambda n: S.backoff_ms(n, 100, 1000), [0, 1, 100], "int") == [100, 200, 1000]


def test_uuids(spark):
    names = ["synthetic-001", "", "é"]
    assert values(spark, S.uuid5_dns, names) == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]
    u = str(uuid.uuid4())
    got = values(spark, S.repair_uuid, [u.upper(), u.replace("-", ""), "nope", None])
    assert got[:3] == [u, u, str(uuid.uuid5(uuid.NAMESPACE_DNS, "nope"))] and uuid.UUID(got[3]).version == 4


def test_fnv(spark):
    def fnv(text):
        h = 2166136261
        for b in text.encode():
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        return h

    words = ["", "BTCUSDT", "é😀"]
    assert values(spark, S.fnv1a_32, words) == [fnv(w) for w in words]
    a, b = values(spark, lambda c: S.shard(c, 4), ["btcusdt", "BTC-USDT"])
    assert a == b and values(spark, lambda c: S.shard(c, 1), ["x"]) == [0]


def test_symbol_of_path(spark):
    paths = ["/d/BTCUSDT-trades-2024-01-01.csv", "ETHUSDT-x.csv", "sample_binance_trades.csv", "file:/a/solusdt.csv", "btc-usdt.csv"]
    assert values(spark, lambda c: S.symbol_of_path(c, ["BTCUSDT"]), paths) == ["BTCUSDT", "ETHUSDT", "BTCUSDT", "SOLUSDT", "BTCUSDT"]


def test_small_helpers(spark):
    row = spark.range(1).select(
        S.lag_ms(F.lit(1250), F.lit(1000)),
        S.lag_ms(F.lit(900), F.lit(1000)),
        S.round_to(F.lit(1.26), 0.5),
        S.notification(F.lit("BUY"), F.lit(3.456), F.lit(65000.5)),
        S.sorted_headers(S.header_map(b=F.lit(1), a=F.lit("x"))),
        S.partition_key(F.lit("binance"), F.lit("BTCUSDT")),
    ).first()
    assert row[:4] == (250, 0, 1.5, "BUY · Z 3.46\nPrice: $65,000.50")
    assert [tuple(h) for h in row[4]] == [("a", "x"), ("b", "1")] and row[5] == "binance:BTCUSDT"


def test_rounding_to_even(spark):
    import random

    rng = random.Random(3)
    xs = [0.0000005, 0.0000015, 2.5e-6, -2.5e-6, 0.5e-6, 1e-7, 123456.1234565, -0.0, 1e15, 1e300, float("inf"), None]
    xs += [rng.uniform(-50, 50) for _ in range(500)] + [rng.randrange(10**9) / 2e6 for _ in range(500)] + [rng.randrange(10**6) / 1e6 + 5e-7 for _ in range(500)]
    for places in (6, 8):
        got = values(spark, lambda c: S.round_half_even(c, places), xs, "double")  # noqa: B023
        assert got == [None if x is None else round(x, places) if abs(x) < 1e300 else x for x in xs]


def test_config():
    for bad in ({"alpha": 0}, {"alpha": 1.1}, {"threshold": 0}, {"min_trades": -1}):
        with pytest.raises(ValueError):
            ScorerConfig(**bad)
    for bad in ({"mode": "x"}, {"layout": "x"}, {"passes": 0}, {"speed": -1}):
        with pytest.raises(ValueError):
            FeedConfig(**bad)
    assert read_env_file("# c\nexport A='1'\n\nB = x=y\n") == {"A": "1", "B": "x=y"}
    with pytest.raises(ValueError):
        read_env_file("nonsense")


def test_settings():
    from flowgauge.config import DedupConfig, NormalizeConfig, SinkConfig, load_config, redacted

    feed = load_config(FeedConfig, {"FEED_SYMBOLS": "btcusdt, ethusdt,btcusdt", "CSV_SPEED": "0", "CSV_FORMAT": " "})
    assert feed.symbols == ("BTCUSDT", "ETHUSDT") and feed.speed == 0.0 and feed.layout == "auto"
    assert load_config(DedupConfig, {"DEDUP_TTL": "1m30s", "DEDUP_ENABLED": "no"}) == DedupConfig(False, 90_000)
    assert load_config(SinkConfig, {"PRODUCER_MAX_RETRIES": "2"}).max_retries == 2
    assert load_config(ScorerConfig, {"SCORER_MIN_TRADES": "3", "SCORER_THRESHOLD_btcusdt": "4"}).thresholds["BTCUSDT"] == 4.0
    for kind, env in ((NormalizeConfig, {"NORMALIZE_MAX_PRICE": "x"}), (DedupConfig, {"DEDUP_TTL": "soon"}), (SinkConfig, {"BROKER": "paper"}), (SinkConfig, {"KAFKA_TLS_ENABLED": "maybe"})):
        with pytest.raises(ValueError):
            load_config(kind, env)
    assert redacted(SinkConfig(sasl_password="p"))["sasl_password"] == "***"
