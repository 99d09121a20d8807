"""Counts taken as rows pass by, a row a batch, windows of event time, and the helpers as functions of SQL."""

import time

from pyspark.sql import functions as F

from flowgauge.config import NormalizeConfig
from flowgauge.functions import scalars as S
from flowgauge.functions.sql import FUNCTIONS, register_functions
from flowgauge.operators import metrics
from flowgauge.operators.normalize import normalize
from flowgauge.plans import queries, views
from flowgauge.sources.files import listed
from flowgauge.streaming.sinks import BatchRows

SF = "/root/testdata/sf0.001"


def test_a_row_for_each_batch(spark, tmp_path):
    """The listener's rows add up to the counters of the whole table."""
    raw = views.raw_trades(spark, SF)
    raw.repartitionByRange(3, "trade_id").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen = normalize(stream, NormalizeConfig(), F.lit(views.NOW_MS)).observe("trades", *metrics.outcome_counts(F.octet_length("payload")))
    listener = BatchRows(f"{tmp_path}/rows")
    spark.streams.addListener(listener)
    try:
        seen.select("trade_id").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            if len(listed(f"{tmp_path}/rows")) >= 3:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    rows = spark.read.json(f"{tmp_path}/rows").filter("input_rows > 0").collect()
    want = {r["outcome"]: r["n"] for r in queries.agg06_counters(spark, SF).collect()}
    assert len(rows) == 3 and sum(r["input_rows"] for r in rows) == sum(want.values())
    assert {k: sum(r[f"trades.{k}"] for r in rows) for k in want} == want
    assert sum(r["trades.n_bytes"] for r in rows) == queries.agg10_producer_counters(spark, SF).first()["n_bytes"]


def test_windows(spark):
    """Every trade in size / slide windows; no volume gives null; rows without a time are left out."""
    rows = [("A", 0, "BUY", 2.0), ("A", 59_000, "SELL", 1.0), ("A", 60_000, "BUY", 1.0), ("B", 30_000, "HOLD", 5.0), ("A", None, "BUY", 9.0)]
    t = spark.createDataFrame(rows, "symbol string, trade_time_ms long, side string, quantity double").withColumn("price", F.lit(1.0))
    got = {(r["symbol"], r["window_start_ms"]): (r["n_trades"], r["net"], r["ofi_ratio"]) for r in metrics.ofi_windows(t, ["symbol"], "2 minutes", "1 minute").collect()}
    assert got == {("A", -60_000): (2, 1.0, 1 / 3), ("A", 0): (3, 2.0, 0.5), ("A", 60_000): (1, 1.0, 1.0), ("B", -60_000): (1, 0.0, None), ("B", 0): (1, 0.0, None)}
    assert metrics.ofi_windows(t.limit(0), ["symbol"]).count() == 0


def test_sql_functions_are_the_helpers(spark):
    """Each function gives what its helper gives, over odd values, and no plan has a UDF."""
    assert register_functions(spark) == ["flow_" + n for n in FUNCTIONS]
    odd = {"string": [None, "", " Btc-usdt ", "1e3", "-.5", "1717243200", "2024-06-01 12:00:00", "yes", "BUY", "x:y"], "double": [None, float("nan"), float("inf"), -1.0, 0.0, 2.5, 0.000000005], "bigint": [None, -5, 0, 10**13], "boolean": [None, True, False]}
    for name, (parameters, helper) in FUNCTIONS.items():
        if name == "alert_time":  # falls back on the clock
            continue
        rows = [tuple(odd[t][(k * (3 + j)) % len(odd[t])] for j, t in enumerate(parameters.values())) for k in range(40)]
        table = spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in parameters.items()))
        table.createOrReplaceTempView("odd")
        by_sql = spark.sql(f"select flow_{name}({', '.join(parameters)}) as v from odd")
        plan = by_sql._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("UDF", "Python", "Arrow")), name
        assert list(map(str, by_sql.collect())) == [str(r) for r in table.select(helper(*map(F.col, parameters)).alias("v")).collect()], name
    plan = queries.sca_sql_reason(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("UDF", "Python", "Exchange"))


def test_alert_time(spark):
    row = spark.createDataFrame([("2024-06-01 12:00:00", 5), ("soon", 5), (None, None)], "t string, ms long")
    got = [r["at"] for r in row.select(S.alert_time(F.col("t"), F.col("ms")).alias("at")).collect()]
    assert got[0].year == 2024 and got[1].year == 1970 and got[2].year >= 2024
