"""The scorer's buffer in state, driven without a stream: any order of arrival, late rows, settings, and what a task holds."""

import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowgauge.config import ScorerConfig
from flowgauge.operators import scoring
from flowgauge.plans import queries, views
from flowgauge.streaming import scorer
from flowgauge.tables import shared_path

SF = "/root/testdata/sf0.001"


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Map:
    def __init__(self):
        self.held = {}
        self.updateValue, self.removeKey, self.getValue = self.held.__setitem__, self.held.pop, self.held.__getitem__
        self.keys, self.iterator = lambda: list(self.held), lambda: list(self.held.items())


class Handle:
    def __init__(self):
        self.timers, self.maps = set(), {}
        self.registerTimer = self.timers.add

    def getValueState(self, name, schema):
        return Value()

    def getMapState(self, name, key, value):
        return self.maps.setdefault(name, Map())


def drive(batches, ordered=True, delay=100, p=None):
    """Batches of rows through the processor of one symbol, the watermark after each; all rows that it gave."""
    p = p or scorer.ScoreProcessor(1e-12, ordered)
    handle, passed, seen, out = Handle(), 0, 0, []
    p.init(handle)
    for batch in [*batches, []]:
        at = SimpleNamespace(getCurrentWatermarkInMs=lambda: passed)  # noqa: B023
        if batch:
            frames = iter([pd.DataFrame(batch[k : k + 7], columns=p.columns) for k in range(0, len(batch), 7)])
            out += list(p.handleInputRows(("S",), frames, at))
            seen = max([seen, *[r[0] for r in batch]])
        for t in sorted(t for t in handle.timers if ordered and t <= passed):
            handle.timers.discard(t)
            out += list(p.handleExpiredTimer(("S",), at, None))
        passed = max(passed, seen - delay)
    rows = pd.concat([f.astype(object) for f in out]) if out else pd.DataFrame(columns=p.out)
    return rows, handle


def trade(at, k, x=1.0):
    return (at, 1, k, x, "BUY" if x > 0 else "SELL", abs(x), 1.0, 3.0, 0.1, 2)


def change(at, k, threshold=None, alpha=None, least=None):
    return (at, 0, k, None, None, None, None, threshold, alpha, least)


def in_order(rows):
    """All rows at once, by plain recurrence: (id, ewma, ewma_var, toxic)."""
    mean = var = 0.0
    n, known, out = 0, [3.0, 0.1, 2], []
    for r in sorted(rows, key=lambda r: r[:3]):
        if not r[1]:
            known = [old if new is None else new for new, old in zip(r[7:], known)]
            continue
        a = known[1]
        d = r[3] - mean
        mean, var = (r[3], 0.0) if n == 0 else (a * r[3] + (1 - a) * mean, a * (d * d) + (1 - a) * var)
        n += 1
        z = 0.0 if n == 1 else mean / max(var, 1e-12) ** 0.5
        out.append((r[2], mean, var, n >= known[2] and abs(z) >= known[0]))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_any_arrival_within_the_delay(monkeypatch, seed):
    """Small runs, ties of time, changes among the trades: the scores of the rows in order, and never many runs in hand."""
    monkeypatch.setattr(scorer, "RUN_ROWS", 5)
    monkeypatch.setattr(scorer, "FRAME_ROWS", 16)
    draw = random.Random(seed)
    rows = [trade(1000 + draw.randrange(2000), k, draw.choice([-2.0, 1.0, 3.5])) for k in range(600)]
    rows += [change(1000 + draw.randrange(2000), k, draw.choice([None, 0.5, 2.0]), draw.choice([None, 0.3]), draw.choice([None, 1, 50])) for k in range(40)]
    arriving = sorted(rows, key=lambda r: r[0] + draw.randrange(99))
    batches = [arriving[k : k + 50] for k in range(0, len(arriving), 50)] + [[trade(10**6, 9999)]]
    got, handle = drive(batches)
    assert not got["late"].any()
    assert list(zip(got["trade_id"], got["ewma"], got["ewma_var"], got["is_toxic"])) == in_order(rows)
    assert len(handle.maps["runs"].held) == len(handle.maps["rows"].held) == 1  # the last trade waits


def test_late_rows_are_told_and_change_nothing():
    rows = [trade(1000 + 10 * k, k, 1.0 + k) for k in range(100)]
    got, _ = drive([rows[:50], [rows[50]], [trade(1200, 777), trade(1390, 778), *rows[51:]], [trade(10**6, 9999)]])
    late = got[got["late"]]
    assert list(late["trade_id"]) == [777, 778] and late["z_score"].isna().all() and list(late["trade_time_ms"]) == [1200, 1390]
    rest = got[~got["late"].astype(bool)]
    assert list(zip(rest["trade_id"], rest["ewma"], rest["ewma_var"], rest["is_toxic"])) == in_order(rows)


def test_without_a_delay_a_trigger_is_its_own_order():
    rows = [trade(1000 - k, k, 1.0 + k % 3) for k in range(40)]
    got, handle = drive([rows[:20], rows[20:]], ordered=False)
    assert list(got["trade_id"]) == [*range(19, -1, -1), *range(39, 19, -1)] and not handle.timers and not handle.maps["runs"].held


def test_a_hot_symbol_is_merged_run_by_run(monkeypatch):
    """Runs that don't overlap share a lane: reading them in order holds one at a time."""
    monkeypatch.setattr(scorer, "RUN_ROWS", 10)
    p, handle = scorer.ScoreProcessor(1e-12, False), Handle()
    p.init(handle)
    held = []
    read = p._read
    monkeypatch.setattr(p, "_read", lambda lane, until: held.append(len(lane)) or read(lane, until))
    rows = [trade(k, k) for k in range(1000)]
    frames = iter([pd.DataFrame(rows[k : k + 100], columns=scorer.ROW) for k in range(0, 1000, 100)])
    assert sum(map(len, p.handleInputRows(("S",), frames, None))) == 1000
    assert held == [100]  # one lane of a hundred runs


@pytest.mark.parametrize("seed", range(4))
def test_ttl_in_a_stream(monkeypatch, seed):
    """Any order of arrival gives what one pass over the sorted rows gives; a key that is quiet is forgotten."""
    monkeypatch.setattr(scorer, "RUN_ROWS", 4)
    draw = random.Random(seed)
    times = [1000 + draw.randrange(3000) for _ in range(400)]
    rows = [(t, 1, k, f"r{k}") for k, t in enumerate(times)]
    ttl = draw.choice([1, 60, 500])
    want, last = [], None
    for t, _, k, row in sorted(rows):
        if last is None or t - last >= ttl:
            want.append(row)
            last = t
    arriving = sorted(rows, key=lambda r: r[0] + draw.randrange(99))
    p = scorer.TtlProcessor(ttl, True)
    got, _ = drive([*(arriving[k : k + 40] for k in range(0, 400, 40)), [(10**6, 1, 9, "far")], [(2 * 10**6, 1, 9, "farther")]], p=p)
    assert list(got["row"]) == [*want, "far"]
    quiet = scorer.TtlProcessor(50, True)
    got, handle = drive([[(100, 1, 1, "a")], [(5000, 1, 2, "b")], [], []], p=quiet, delay=10)
    at = SimpleNamespace(getCurrentWatermarkInMs=lambda: 10**6)
    assert list(got["row"]) == ["a"] and quiet.state.exists() and list(quiet.handleExpiredTimer(("S",), at, None))[0]["row"].tolist() == ["b"]
    assert quiet.state.held is None and list(quiet.handleExpiredTimer(("S",), at, None)) == []  # forgotten


def test_stream_settings_leave_other_symbols_alone(spark):
    t = views.trades(spark, SF)
    changes = spark.createDataFrame([("ETHUSDT", 0, 1, 0.1, 0.5, 1)], "symbol string, at_ms long, change_id long, z_threshold double, ewma_alpha double, min_trades int")
    got = queries._run_stream(spark, t, changes=changes.withColumn("at_ms", F.lit(t.agg(F.min("trade_time_ms")).first()[0])), arrival=F.lit(0), delay="1 hour")
    want = scoring.judged(scoring.score_trades(scoring.settings_as_of(t, spark.createDataFrame([], changes.schema)), ScorerConfig()))
    columns = ("trade_id", "ewma", "z_score", "is_toxic")
    rows = lambda df, test: sorted(map(tuple, df.filter(test).select(*columns).collect()))
    assert rows(got, "symbol <> 'ETHUSDT'") == rows(want, "symbol <> 'ETHUSDT'")
    assert got.filter("symbol = 'ETHUSDT' and is_toxic").count() > want.filter("symbol = 'ETHUSDT' and is_toxic").count()


def test_late_side_output(spark, tmp_path):
    from flowgauge.streaming.sinks import scores_writer

    rows = [("S", k, 1000 + 1000 * k, "BUY", 1.0, 1.0) for k in range(50)]
    seen = []
    schema = "symbol string, trade_id long, trade_time_ms long, side string, quantity double, price double"
    for n, some in enumerate((rows[:40], rows[40:], [("S", 99, 5000, "BUY", 1.0, 1.0), ("S", 98, None, "BUY", 1.0, 1.0)], [("~", 0, 10**7, "BUY", 1.0, 1.0)])):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    scores = scorer.score_stream(stream, delay="2 seconds")
    write = scores_writer(f"{tmp_path}/scores", f"{tmp_path}/late", lambda n, counts: seen.append(counts))
    scores.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/scores").count() == 50
    assert sorted(r["trade_id"] for r in spark.read.parquet(f"{tmp_path}/late").collect()) == [98, 99]
    assert sum(c["scored"] for c in seen) == 50 and sum(c["late"] for c in seen) == 2


def test_rows_are_read_by_column():
    """Nulls of any kind become None."""
    frame = pd.DataFrame({"at_ms": [3, 1], "x": [None, 2.5], "side": ["BUY", None], "n": [float("nan"), 4.0], "t": [pd.NaT, pd.NaT]})
    assert scorer._plain(frame, ("at_ms", "x", "side", "n")) == [(3, None, "BUY", None), (1, 2.5, None, 4.0)]
    assert scorer._plain(frame, ("t",)) == [(None,), (None,)]


def test_a_turn_is_read_once(spark, monkeypatch):
    """Arrivals lie in a folder for each turn, so that a turn's file is made from its own rows alone."""
    rows = spark.range(400).select(F.col("id").alias("trade_id"), F.lit("S").alias("symbol"), (F.col("id") * 8_640_000).alias("trade_time_ms"))
    paths = []
    monkeypatch.setattr(queries, "shared_path", lambda s, n: paths.append(shared_path(s, n)) or paths[-1])
    ends = queries._ends(rows)
    queries._arriving(spark, rows, "trade_time_ms", F.lit(0), ends)
    held = next(p for p in paths if "arrivals" in p)
    turns = spark.read.parquet(held).groupBy("_turn", F.input_file_name().alias("file")).count().collect()
    assert all(f"_turn={r['_turn']}/" in r["file"] for r in turns) and {r["_turn"] for r in turns} == set(range(11))
    stream = next(p for p in paths if "stream-in" in p)
    assert spark.read.parquet(stream).filter("symbol = 'S'").count() == 400
