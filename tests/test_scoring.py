import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowgauge.config import ScorerConfig
from flowgauge.operators import scoring
from flowgauge.operators.scoring import checkpoint_epochs, config_table, current_z, final_state, score_trades, settings_as_of, with_thresholds
from flowgauge.tables import stored


def flow(spark, values, symbol="BTCUSDT"):
    rows = [(symbol, k, k, "BUY" if v >= 0 else "SELL", abs(float(v)), 1.0) for k, v in enumerate(values, 1)]
    return spark.createDataFrame(rows, "symbol string, trade_id long, trade_time_ms long, side string, quantity double, price double")


def scores(df):
    return [(r["ewma"], r["ewma_var"], r["trade_count"], r["z_score"]) for r in df.orderBy("symbol", "trade_id").collect()]


def test_first_and_second(spark):
    assert scores(score_trades(flow(spark, [5]))) == [(5.0, 0.0, 1, 0.0)]
    m, v, n, z = scores(score_trades(flow(spark, [5, -5])))[1]
    assert (m, v, n) == (4.0, 10.0, 2) and math.isclose(z, 1.2649, rel_tol=1e-4)


def test_constant_flow_is_toxic_after_warm_up(spark):
    judged = with_thresholds(score_trades(flow(spark, [1] * 10)), ScorerConfig(), config_table(spark, ScorerConfig()))
    assert [r["is_toxic"] for r in judged.orderBy("trade_id").collect()] == [False] * 9 + [True]


def test_odd_rows_decay(spark):
    t = flow(spark, [5, 3]).withColumn("side", F.when(F.col("trade_id") == 2, "HOLD").otherwise(F.col("side")))
    assert scores(score_trades(t))[1][:3] == (4.5, 2.5, 2)


def test_alpha_one(spark):
    assert [s[:2] for s in scores(score_trades(flow(spark, [1, 4, 2]), ScorerConfig(alpha=1.0)))] == [(1.0, 0.0), (4.0, 9.0), (2.0, 4.0)]


def test_symbols_do_not_mix(spark):
    a, b = flow(spark, [1, -2, 3]), flow(spark, [9, 9], "eth")
    both = score_trades(a.unionByName(b))
    assert scores(both.filter("symbol = 'BTCUSDT'")) == scores(score_trades(a))
    assert scores(both.filter("symbol = 'ETH'")) == scores(score_trades(b))


@pytest.mark.parametrize("rows", [7, 50])
def test_chunks_agree_with_one_pass(spark, rows):
    t = flow(spark, [((k * 37) % 19) - 9 for k in range(120)]).unionByName(flow(spark, [1, 2, -3], "eth"))
    whole, parts = scores(score_trades(t)), scores(score_trades(t, chunk_rows=rows))
    assert len(whole) == len(parts) == 123
    for x, y in zip(whole, parts):
        assert x[2] == y[2] and all(math.isclose(p, q, rel_tol=1e-9, abs_tol=1e-9) for p, q in zip(x, y))


@pytest.mark.parametrize("size", [1000.1, 100_000.3, 1_000_000.7])
@pytest.mark.parametrize("rows", [7, 50, 1000])
def test_constant_flow_in_chunks(spark, size, rows):
    """Nearly constant flow: z depends on variances far below the values' squares."""
    t = flow(spark, [3, -7, 2 * size, 5, -size, *[size] * 275])
    whole, parts = scores(score_trades(t)), scores(score_trades(t, chunk_rows=rows))
    assert len(parts) == 280 and all(p[1] >= 0 for p in parts)
    for x, y in zip(whole, parts):
        assert x[2] == y[2] and math.isclose(x[0], y[0], rel_tol=1e-12)
        assert math.isclose(x[1], y[1], rel_tol=1e-7, abs_tol=1e-13) and math.isclose(x[3], y[3], rel_tol=1e-6)


def test_tiny_chunks_stay_in_bounded_ranges(spark, monkeypatch):
    """10,000 trades in chunks of three: no more files than shuffle partitions, many symbols and a hot one, and the same scores."""
    from flowgauge.operators import scoring

    written = []
    monkeypatch.setattr(scoring, "stored", lambda df, name: written.append(stored(df, name)) or written[-1])
    t = spark.range(10_000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 40).cast("string"))).alias("symbol"), F.col("id").alias("trade_id"),
        F.col("id").alias("trade_time_ms"), F.when(F.col("id") % 7 < 3, "BUY").otherwise("SELL").alias("side"), (F.col("id") % 11 + 0.5).alias("quantity"), F.lit(1.0).alias("price"),
    )
    whole, parts = scores(score_trades(t)), scores(score_trades(t, chunk_rows=3))
    assert len(written[0].inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert written[0].groupBy("chunk").count().agg(F.max("count")).first()[0] == 3
    assert len(whole) == len(parts) == 10_000
    assert all(x[2] == y[2] and all(math.isclose(p, q, rel_tol=1e-9, abs_tol=1e-9) for p, q in zip(x, y)) for x, y in zip(whole, parts))


def test_settings_as_of(spark):
    """Changes at a trade's time count, the larger id of two does, nulls leave a value, other symbols don't change; ranges agree."""
    t = flow(spark, range(1, 61)).unionByName(flow(spark, range(1, 61), "eth"))
    changes = spark.createDataFrame(
        [("btcusdt", 10, 1, 5.0, 0.5, 3), ("BTCUSDT", 10, 2, 6.0, None, None), ("BTCUSDT", 30, 3, None, 0.2, 7), ("ETH", 0, 4, 1.0, None, None)],
        "symbol string, at_ms long, change_id long, z_threshold double, ewma_alpha double, min_trades int",
    )
    for part_rows in (1000, 10):
        got = {(r["symbol"], r["trade_id"]): (r["z_threshold"], r["ewma_alpha"], r["min_trades"]) for r in settings_as_of(t, changes, part_rows=part_rows).collect()}
        assert len(got) == 120
        for k in range(1, 61):
            assert got["BTCUSDT", k] == ((3.0, 0.1, 10) if k < 10 else (6.0, 0.5, 3) if k < 30 else (6.0, 0.2, 7))
            assert got["ETH", k] == (1.0, 0.1, 10)
    known = settings_as_of(t, changes)
    assert scores(score_trades(known).filter("symbol = 'ETH'")) == scores(score_trades(flow(spark, range(1, 61), "eth")))
    a, b = scores(score_trades(known)), scores(score_trades(known, chunk_rows=9))
    assert all(math.isclose(p, q, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a, b) for p, q in zip(x, y))
    assert settings_as_of(t.limit(0), changes).count() == 0 and settings_as_of(t, changes.limit(0)).count() == 120


def test_restored_state(spark):
    t = flow(spark, [3, -1, 4, 1, -5, 9])
    before = final_state(score_trades(t.filter("trade_id <= 3")))
    rest = scores(score_trades(t.filter("trade_id > 3"), initial=before))
    assert rest == scores(score_trades(t))[3:]


def test_state_and_epochs(spark):
    s = score_trades(flow(spark, range(1, 251)))
    state = final_state(s).first()
    assert state["trade_count"] == 250 and current_z(final_state(s)).first()["z_score"] == state["ewma"] / math.sqrt(state["ewma_var"])
    assert sorted((r["epoch"], r["n_trades"]) for r in checkpoint_epochs(s).collect()) == [(0, 100), (1, 100), (2, 50)]


def test_own_alpha_and_empty(spark):
    own = spark.createDataFrame([("BTCUSDT", 1.0)], "symbol string, ewma_alpha double")
    assert scores(score_trades(flow(spark, [1, 4]), configs=own))[1][:2] == (4.0, 9.0)
    assert score_trades(flow(spark, [1]).limit(0)).count() == 0


def test_passes_over_chunks_hold_a_batch(spark, monkeypatch):
    """Rows of a long chunk go on while later ones come, in both passes; their scores are those of one pass, whatever the batches."""
    monkeypatch.setattr(scoring.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 3})())
    taken = []

    def batches(columns, size=10):
        for k in range(20):
            taken.append(k)
            yield pa.RecordBatch.from_pydict({c: f(range(k * size, (k + 1) * size)) for c, f in columns.items()})

    numbers = {"symbol": lambda r: ["A"] * len(r), "signed_ofi": lambda r: [float(i % 7) for i in r], "_alpha": lambda r: [0.1] * len(r)}
    cut = scoring._cut(1000)(batches(numbers))
    first = next(cut)
    assert first.num_rows == 10 and len(taken) == 2
    rest = pa.Table.from_batches([first, *cut]).to_pylist()
    assert len(rest) == 200 and [r["_summary"] is None for r in rest] == [True] * 199 + [False]
    one = scoring._summary(np.array([r["signed_ofi"] for r in rest]), np.array([0.1] * 200), (1.0, 0.0, 0.0, 0.0, 0.0))
    assert rest[-1]["_summary"] == {"n": 200, "first": 0.0, **dict(zip("abpqr", one))}
    taken.clear()
    begun = {"ewma": lambda r: [2.0 if not i else None for i in r], "ewma_var": lambda r: [1.0 if not i else None for i in r], "trade_count": lambda r: pa.array([5 if not i else None for i in r], pa.int64()), "_trade": lambda r: [i > 0 for i in r]}
    made = scoring._finish(list(numbers))(batches(numbers | begun))
    first = next(made)
    assert first.num_rows == 9 and len(taken) == 1
    scored = pa.Table.from_batches([first, *made])
    means, variances = scoring._run(np.array([float(i % 7) for i in range(1, 200)]), np.array([0.1] * 199), 2.0, 1.0, 5)
    assert (scored["ewma"].to_pylist(), scored["ewma_var"].to_pylist(), scored["trade_count"].to_pylist()) == (means, variances, list(range(6, 205)))
