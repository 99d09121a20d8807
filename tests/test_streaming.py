from pyspark.sql import functions as F

from flowgauge import schemas
from flowgauge.config import NormalizeConfig
from flowgauge.operators import snapshots
from flowgauge.operators.scoring import score_trades
from flowgauge.plans import queries, views
from flowgauge.streaming.scorer import dedup_stream
from flowgauge.streaming.sinks import alert_writer, ndjson, retrying, sink, split_writer, state_writer

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    columns = ("symbol", "trade_id", "ewma", "ewma_var", "trade_count", "z_score")
    stream = queries.str04_stream_score(spark, SF).select(*columns)
    batch = score_trades(views.trades(spark, SF)).select(*columns)
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))


def test_dedup_stream(spark, tmp_path):
    t = views.trades(spark, SF)
    t.unionByName(t).write.parquet(f"{tmp_path}/in")
    kept = dedup_stream(spark.readStream.schema(t.schema).parquet(f"{tmp_path}/in"), "60 days")
    sink(kept, "files", f"{tmp_path}/out", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == t.count()


def test_split(spark, tmp_path):
    raw = views.raw_trades(spark, SF)
    raw.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(raw.schema).parquet(f"{tmp_path}/in")
    write = split_writer(f"{tmp_path}/good", f"{tmp_path}/bad", NormalizeConfig())
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    good, bad = spark.read.parquet(f"{tmp_path}/good"), spark.read.parquet(f"{tmp_path}/bad")
    assert good.count() + bad.count() == raw.count() and bad.count() > 0
    assert set(schemas.DLQ.replace(" long", "").replace(" string", "").split(", ")) <= set(bad.columns)


def test_state_table(spark, tmp_path):
    write = state_writer(str(tmp_path))
    state = lambda s, n: spark.createDataFrame([(s, 1.0 * n, 0.0, n)], schemas.SCORER_STATE)
    write(state("A", 1).union(state("A", 2)), 0)
    write(state("B", 1), 1)
    write(state("B", 1), 1)  # a batch again
    kept = snapshots.snapshot(str(tmp_path))
    assert kept.version == 1 and kept.total == 2
    assert sorted((r["symbol"], r["trade_count"]) for r in kept.rows(spark).collect()) == [("A", 2), ("B", 1)]


def test_lines(spark):
    assert [r[0] for r in ndjson(spark.range(1), "DLQ ").collect()] == ['DLQ {"id":0}']


def test_alert_writer(spark, tmp_path):
    from flowgauge.operators.audit import verify_chain, verify_parts

    seen = []
    write = alert_writer(f"{tmp_path}/alerts", f"{tmp_path}/log", lambda rows, n: seen.append((n, rows.count())), f"{tmp_path}/heads")
    alerts = spark.createDataFrame([(k, "AB"[k % 2], 3.5, 1000 + k) for k in range(6)], "trade_id long, symbol string, z_score double, trade_time_ms long")
    write(alerts, 0)
    write(alerts, 0)
    write(alerts, 1)
    assert seen == [(0, 6), (0, 6), (1, 6)] and spark.read.parquet(f"{tmp_path}/alerts").count() == 12
    log = spark.read.parquet(f"{tmp_path}/log")
    assert log.count() == 12 and verify_chain(log).filter("not ok").count() == 0
    heads = spark.read.parquet(f"{tmp_path}/heads")
    assert verify_parts(log, heads).filter("problem is not null").count() == 0
    cut = verify_parts(log.filter("segment <> '1/A' and not (segment = '0/B' and entry = 3)"), heads).filter("problem is not null").collect()
    assert sorted((r["segment"], r["problem"]) for r in cut) == [("0/B", "short"), ("1/A", "missing")]


def test_retrying(spark):
    calls, dead = [], []

    def fails(times):
        def write(batch, n):
            calls.append(n)
            if len(calls) <= times:
                raise RuntimeError("down")

        return write

    retrying(fails(2), lambda b, n: dead.append(n), 3, 0.0)(spark.range(1), 7)
    assert calls == [7, 7, 7] and dead == []
    calls.clear()
    retrying(fails(9), lambda b, n: dead.append(n), 3, 0.0)(spark.range(1), 8)
    assert calls == [8] * 4 and dead == [8]
