import functools
import itertools
import random

import pytest
from pyspark.sql import functions as F

from flowgauge import schemas
from flowgauge.config import DedupConfig, NormalizeConfig
from flowgauge.operators import dedup
from flowgauge.operators.dedup import first_of_each, within_ttl
from flowgauge.operators.normalize import dead_letters, good_trades, normalize, validate_json
from flowgauge.tables import stored

NOW = 1704153600000 + 7_200_000
BASE = {
    "exchange": "binance", "symbol": "btcusdt", "source": "csv", "trade_id": 4001, "price": "65000.25", "quantity": "0.5",
    "quote_quantity": "", "is_buyer_maker": True, "trade_time_ms": 1704153600000, "event_time_ms": 1704153600005, "payload": "raw",
}


def run(spark, config=None, **changes):
    row = tuple((BASE | changes).values())
    return normalize(spark.createDataFrame([row], schemas.RAW_TRADE), config or NormalizeConfig(), F.lit(NOW))


def test_good(spark):
    t = good_trades(run(spark)).first()
    assert (t["symbol"], t["side"], t["quote_quantity"], t["schema_version"]) == ("BTCUSDT", "SELL", 32500.125, "1.0.0")
    assert (t["size"], t["timestamp"], t["event_time_ms"]) == (0.5, 1704153600000, 1704153600005)


@pytest.mark.parametrize(
    "changes, config, reason",
    [
        ({"symbol": ""}, {}, "empty_symbol"),
        ({"symbol": None}, {}, "empty_symbol"),
        ({"price": "abc"}, {}, "bad_price"),
        ({"price": ""}, {}, "bad_price"),
        ({"price": None}, {}, "bad_price"),
        ({"price": "-1"}, {}, "bad_price"),
        ({"quantity": "0"}, {}, "bad_quantity"),
        ({"quantity": "NaNx"}, {}, "bad_quantity"),
        ({"quote_quantity": "not-a-number"}, {"compute_quote_quantity": False}, "bad_quote_quantity"),
        ({"quote_quantity": "not-a-number"}, {}, None),
        ({}, {"max_price": 1000.0}, "price_out_of_range"),
        ({"price": "10", "quantity": "1000"}, {"max_quantity": 10.0}, "quantity_out_of_range"),
        ({"trade_time_ms": 0, "event_time_ms": 0}, {}, "bad_timestamp"),
        ({"trade_time_ms": 0}, {}, None),
        ({"price": "10"}, {"max_age_ms": 60_000}, "stale_trade"),
        ({"price": "NaN"}, {}, "invalid_trade"),
        ({"price": "Inf"}, {}, "invalid_trade"),
        ({"trade_id": -1}, {}, "invalid_trade"),
    ],
)
def test_reasons(spark, changes, config, reason):
    found = run(spark, NormalizeConfig(**config), **changes)
    assert found.first()["reason"] == reason
    assert dead_letters(found).count() == (reason is not None) and good_trades(found).count() == (reason is None)


def test_quote(spark):
    assert good_trades(run(spark, quote_quantity="99999")).first()["quote_quantity"] == 99999.0
    assert good_trades(run(spark, quote_quantity="bad")).first()["quote_quantity"] == 32500.125


def test_json(spark):
    good = '{"symbol":" btcusdt","side":"buy","price":10.5,"quantity":2,"trade_time_ms":1704153600000,"event_id":"e"}'
    rows = [
        (good, None), (good.replace(" btcusdt", " "), "symbol"), (good.replace("buy", "HOLD"), "side"), (good.replace("10.5", "0"), "price"),
        (good.replace("10.5", '"10.5"'), "price"), (good.replace(":2,", ":-2,"), "quantity"), (good.replace("1704153600000", "0"), "trade_time_ms"), ("{oops", "malformed_json"), ("[1]", "malformed_json"),
    ]
    found = validate_json(spark.createDataFrame([*rows, ("", "skipped")], "value string, expected string"))
    assert [(r["reason"], r["expected"]) for r in found.collect()] == [(e, e) for _, e in rows]
    assert found.filter("reason is null").first()["symbol"] == "BTCUSDT"
    big = spark.createDataFrame([('{"symbol":"a","trade_time_ms":9007199254740993,"trade_id":7.9,"exchange":" X "}',)], "value string")
    r = validate_json(big).first()
    assert (r["trade_time_ms"], r["trade_id"], r["exchange"]) == (9007199254740993, 7, "x")


def test_dedup(spark):
    rows = [("binance", "BTCUSDT", 1, 0), ("binance", "BTCUSDT", 1, 1), ("binance", "BTCUSDT", 2, 2), ("binance", "ETHUSDT", 1, 3), ("coinbase", "BTCUSDT", 1, 4)]
    table = spark.createDataFrame(rows, "exchange string, symbol string, trade_id long, n int")
    assert sorted(r["n"] for r in first_of_each(table, [F.col("n")]).collect()) == [0, 2, 3, 4]


def test_dedup_ttl(spark):
    rows = [("b", "S", 1, t, f"r{t}") for t in (0, 30, 49, 50, 60, 100, 101)] + [("b", None, 1, 5, "x"), ("b", None, 1, 5, "w"), ("b", "S", 1, None, "y"), ("b", "S", 2, 60, "z")]
    table = spark.createDataFrame(rows, "exchange string, symbol string, trade_id long, t long, note string")
    kept = within_ttl(table, "t", 50, order=("note",))
    assert kept.columns == table.columns and sorted(r["note"] for r in kept.collect()) == ["r0", "r100", "r50", "w", "z"]
    assert within_ttl(table.limit(0), "t", 50).count() == 0
    hot = table.filter("note = 'r0'").crossJoin(spark.range(1000)).drop("id")
    assert [r["note"] for r in within_ttl(hot, "t", 50).collect()] == ["r0"]
    assert within_ttl(table.select("exchange", "symbol", "trade_id", "t"), "t", 50).count() == 5


@pytest.mark.parametrize("seed", range(5))
def test_ttl_over_ranges(spark, seed, monkeypatch):
    """A hot key over most ranges, others of few rows, bursts and gaps: one by one gives the same, in few rounds, and no range holds the key."""
    draw = random.Random(seed)
    steps = [draw.choice([0, 1, 3, 7]) if draw.random() < 0.97 else draw.choice([60, 400]) for _ in range(3000)]
    times = {"hot": list(itertools.accumulate(steps))} | {f"k{n}": [draw.randrange(5000) for _ in range(draw.randrange(30))] for n in range(40)} | {None: list(range(0, 300, 2))}
    rows = [(k, t, n) for k, ts in times.items() for n, t in enumerate(ts)]
    draw.shuffle(rows)
    table = spark.createDataFrame(rows, "k string, t long, n long").repartition(7)
    want, ttl = [], draw.choice([1, 40, 200, 3000])
    for k, ts in times.items():
        last = None
        for t in sorted(set(ts)):
            if last is None or t - last >= ttl:
                want.append((k, t))
                last = t
    written = []
    monkeypatch.setattr(dedup, "stored", lambda df, name: written.append((name, stored(df, name))) or written[-1][1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = within_ttl(table, "t", ttl, ("k",), ("n",)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(((r["k"], r["t"]) for r in got), key=str) == sorted(want, key=str)
    assert sum(name == "reached" for name, _ in written) <= 6  # 16 ranges: 4 doublings, and one that finds nothing new
    ranges = next(df for name, df in written if name == "ttl").filter("_start is null and k = 'hot'").groupBy("_part").count().collect()
    assert len(ranges) > 8 and max(r["count"] for r in ranges) < 700


def test_ttl_with_many_starts(spark, monkeypatch):
    """More starts than one task takes: their links are found by ranges too."""
    monkeypatch.setattr(dedup, "filled", functools.partial(dedup.filled, part_rows=20))
    rows = [(k, t) for k in ("a", None) for t in range(0, 900, 3)]
    table = spark.createDataFrame(rows, "k string, t long").repartition(5)
    got = within_ttl(table, "t", 50, ("k",)).collect()
    assert sorted(((r["k"], r["t"]) for r in got), key=str) == sorted(((k, t) for k in ("a", None) for t in range(0, 900, 51)), key=str)


def test_suppression_by_settings(spark):
    t = spark.createDataFrame([("b", "S", 1, 1000), ("b", "S", 1, 1000), ("b", "S", 1, 1900), ("b", "S", 1, 2000)], "exchange string, symbol string, trade_id long, trade_time_ms long")
    assert sorted(r["trade_time_ms"] for r in dedup.suppress(t, DedupConfig(ttl_ms=1000)).collect()) == [1000, 2000]
    assert dedup.suppress(t, DedupConfig(enabled=False)).count() == 4


def test_starts_become_one():
    """Every start's own end, and no more passes alive than times within a TTL."""
    times = [0, 3, 5, 9, 10, 14, 30, 31, 52]
    passes = dedup._Starts(10, True)
    for t in times:
        passes.see(t)
        assert len(passes.alive) <= 5

    def last(start):
        kept = start
        for t in times:
            kept = t if t >= kept + 10 else kept
        return kept

    assert passes.ends() == ([0, 3, 5, 9, 10], [last(s) for s in (0, 3, 5, 9, 10)])
