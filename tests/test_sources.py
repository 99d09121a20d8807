import pytest
from pyspark.sql import functions as F

from flowgauge.config import FeedConfig
from flowgauge.operators import metrics
from flowgauge.sources import brokers, csv_trades, frames

HEADER = "id,price,qty,quoteQty,time,isBuyerMaker,isBestMatch"
AT = 1717243200000  # 2024-06-01 12:00 UTC


def read(spark, folder, lines, name="SOLUSDT-dump-7.csv", **config):
    path = folder / name
    path.write_text("\n".join(lines) + "\n")
    return csv_trades.read_csv_trades(spark, str(path), FeedConfig(**config)).orderBy("trade_id").collect()


def line(i, price="7.25", qty="3", time=AT, more=""):
    return f"{i},{price},{qty},{more}{time},TRUE,no"


def test_a_dump_with_header(spark, tmp_path):
    """Text stays as it stands; a time in seconds, one in milliseconds and a date are one moment."""
    rows = [line(31, "0.0810", "1200", AT, "97.2,"), line(32, time=AT // 1000, more=","), line(33, time="2024-06-01 12:00:00", more="x,"), line(34, time="noon", more="1,")]
    got = read(spark, tmp_path, [HEADER, *rows])
    assert [(r["trade_id"], r["price"], r["quantity"], r["quote_quantity"]) for r in got] == [(31, "0.0810", "1200", "97.2"), (32, "7.25", "3", None), (33, "7.25", "3", "x")]
    assert {r["trade_time_ms"] for r in got} == {AT} and {r["symbol"] for r in got} == {"SOLUSDT"} and all(r["is_buyer_maker"] for r in got)
    assert got[0]["payload"] == rows[0]


def test_dumps_without_header(spark, tmp_path):
    """Six fields have no quote, more have one; a comma between quotes parts no fields. Names that say no symbol take the setting."""
    six = read(spark, tmp_path, [line(8)])
    assert (six[0]["quote_quantity"], six[0]["trade_time_ms"], six[0]["quantity"]) == (None, AT, "3")
    seven = read(spark, tmp_path, [line(9, more="21.75,")], name="part-0.csv", symbols=("XRPUSDT",))
    assert (seven[0]["quote_quantity"], seven[0]["symbol"]) == ("21.75", "XRPUSDT")
    quoted = read(spark, tmp_path, [f'5,"1,5",2,{AT},"TRUE",no', line(6)], name="ADAUSDT_q.csv")
    assert [(r["trade_id"], r["price"], r["trade_time_ms"]) for r in quoted] == [(5, "1,5", AT), (6, "7.25", AT)]


def test_aggregates_and_broken_lines(spark, tmp_path):
    lines = ["aggTradeId,price,quantity,firstTradeId,lastTradeId,transactTime,isBuyerMaker,isBestMatch", f"77,7.25,3,400,409,{AT},false,true"]
    assert [(r["trade_id"], r["trade_time_ms"], r["is_buyer_maker"]) for r in read(spark, tmp_path, lines)] == [(77, AT, False)]
    bad = [HEADER, line(5, more="1,"), line("five", more="1,"), "", "6", line(7, more="1,"), line(8, time="", more="1,")]
    assert [r["trade_id"] for r in read(spark, tmp_path, bad)] == [5, 7]
    with pytest.raises(ValueError, match="lacks"):
        read(spark, tmp_path, ["id,cost", "4,5"])


def test_short_names_and_quotes(spark, tmp_path):
    got = read(spark, tmp_path, ["a,p,q,T,m", f'7,"1.5",2,{AT},true', f'8,1,"2",{AT},false'])
    assert [(r["trade_id"], r["price"], r["quantity"], r["is_buyer_maker"]) for r in got] == [(7, "1.5", "2", True), (8, "1", "2", False)]
    got = read(spark, tmp_path, ["note,id,price,qty,time", f'"a, ""b""",1,2,3,{AT // 1000}', f'say "x,2,2,3,{AT // 1000}', f",3,2,3,{AT // 1000}"])
    assert [(r["trade_id"], r["trade_time_ms"]) for r in got] == [(1, AT), (2, AT), (3, AT)]


def test_each_file_has_its_layout(spark, tmp_path):
    (tmp_path / "SOLUSDT-a.csv").write_text(f"id,price,qty,time\n1,10,1,{AT}\nx,10,1,{AT}\n")
    (tmp_path / "ADAUSDT-b.csv").write_text(f"2,20,1,20,{AT},true,true\n3,20,1,20,{AT // 1000},true,true\n")
    (tmp_path / "DOTUSDT-c.csv").write_text("")
    raw = csv_trades.parse_files(spark, str(tmp_path), FeedConfig())
    assert sorted(map(tuple, csv_trades.skipped(raw).collect())) == [("ADAUSDT", 2, 0), ("SOLUSDT", 2, 1)]
    got = csv_trades.readable(raw).orderBy("trade_id").collect()
    # without a header, times stand as they are
    assert [(r["symbol"], r["price"], r["trade_time_ms"], r["is_buyer_maker"]) for r in got] == [
        ("SOLUSDT", "10", AT, False), ("ADAUSDT", "20", AT, True), ("ADAUSDT", "20", AT // 1000, True)
    ]


def test_slices(spark, tmp_path):
    lines = [HEADER, *[line(i, time=AT + 5 * i, more="1,") for i in (4, 3, 2, 1)]]
    ids = lambda **config: [r["trade_id"] for r in read(spark, tmp_path, lines, **config)]
    assert ids(max_rows=3) == [1, 2, 3] and ids(start_row=2) == [2, 3, 4] and ids(passes=2, max_rows=5) == [1, 1, 2, 3, 4]


def test_frames(spark):
    event = '{"e":"aggTrade","E":5,"s":"sol-usdt","a":7,"p":"1.5","q":"2","T":4,"m":true}'
    rows = [event, '{"stream":"s","data":' + event + "}", event.replace("aggTrade", "trade").replace('"a":7', '"t":8'), event.replace("aggTrade", "depth"), "oops", event.replace('"a":7', '"a":0')]
    table = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, value string").orderBy("k")
    got = frames.decode_frames(table, strict=True).collect()
    assert [r["trade_id"] for r in got] == [7, 7, 8, None, None, 0]
    assert [r["error"] for r in got] == [None, None, None, "unknown event type", "malformed_json", "no id"]
    assert (got[0]["symbol"], got[0]["price"], got[0]["trade_time_ms"], got[0]["event_time_ms"], got[0]["is_buyer_maker"]) == ("SOLUSDT", "1.5", 4, 5, True)
    odd = ["[1]", "3", "null", '{"data":"text"}', '{"data":[]}', '{"data":null,"e":"trade","t":"9","T":"6"}', '{"e":"trade","t":1000}', "", None]
    got = frames.decode_frames(spark.createDataFrame([(k, x) for k, x in enumerate(odd)], "k int, value string").coalesce(1).orderBy("k"), now_ms=F.lit(1)).collect()
    assert [r["error"] for r in got] == ["malformed_json"] * 5 + [None, None, "malformed_json", "malformed_json"]
    assert [(r["trade_id"], r["trade_time_ms"], r["event_time_ms"]) for r in got[5:7]] == [(9, 6, 1), (1000, None, 1)]


def test_a_frame_is_parsed_once(spark):
    table = spark.createDataFrame([("{}",)], "value string")
    plan = frames.decode_frames(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1 and "from_json" not in plan


def test_options():
    o = brokers.kafka_sink_options("h:9092", "t", acks="one", compression="zstd", sasl="SCRAM-SHA-512", user="u", password="p", tls=True)
    assert o["kafka.acks"] == "1" and o["kafka.security.protocol"] == "SASL_SSL" and "ScramLoginModule" in o["kafka.sasl.jaas.config"]
    assert brokers.kafka_source_options("h", "t", most_offsets=5)["maxOffsetsPerTrigger"] == "5"
    with pytest.raises(ValueError):
        brokers.kafka_sink_options("h", "t", acks="some")
