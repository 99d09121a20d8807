"""The replaying source and the transactional sink: clocks, restarts, killed tasks, retries and counts."""

import logging
import os
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowgauge.config import FeedConfig, SinkConfig
from flowgauge.sources import brokers, replay
from flowgauge.sources.files import listed, read_json
from flowgauge.streaming import sinks, transactional

SCHEMA = "symbol string, trade_id long, trade_time_ms long"


def trades(spark, n=100):
    """Two symbols; their trades are 10 and 20 milliseconds apart, with one gap of an hour."""
    rows = [("AB"[k % 2], k, 1_000_000 + 10 * k + (3_600_000 if k >= 60 else 0)) for k in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def recorded(spark, tmp_path):
    replay.prepare_replay(trades(spark), f"file://{tmp_path}/rec", speed=2.0, files=3)
    return f"file://{tmp_path}/rec"


def test_due_times_and_index(spark, recorded):
    """A gap is divided by the speed and capped at two seconds; files follow the order in which trades are due."""
    spark.dataSource.register(replay.TradeReplay)
    rows = spark.read.format("trade_replay").option("path", recorded).load().collect()
    due = {r["trade_id"]: r["due_ms"] for r in rows}
    assert len(rows) == 100 and due[0] == due[1] == 0 and due[2] == 10 and due[59] == 290 and due[60] == 290 + 2000 and due[99] == 290 + 2000 + 190
    index = read_json(f"{recorded}/_index.json")
    assert index["total"] == 100 and [f["due_ms"] for f in index["files"]] == sorted(f["due_ms"] for f in index["files"])


def test_offsets_follow_the_clock_and_survive(recorded, tmp_path, monkeypatch):
    now = [50.0]
    monkeypatch.setattr(replay.time, "monotonic", lambda: now[0])
    make = lambda most=1000: replay.ReplayStream(recorded, replay.TradeReplay({"path": recorded}).schema(), f"{tmp_path}/at.json", most)
    s = make()
    assert s.initialOffset() == {"rows": 0} and s.latestOffset() == {"rows": 2}  # both symbols' first trades
    now[0] += 0.1
    assert s.latestOffset() == {"rows": 22}
    now[0] += 5000  # the query is stopped meanwhile: its clock stands, and no offset is given twice
    s = make()
    assert s.latestOffset() == {"rows": 22}
    now[0] += 0.195
    assert s.latestOffset() == {"rows": 60}
    now[0] += 1.9
    assert s.latestOffset() == {"rows": 60}
    s = make(most=15)  # a bound on a trigger
    assert s.latestOffset() == {"rows": 60}
    now[0] += 60
    assert [s.latestOffset()["rows"] for _ in range(4)] == [75, 90, 100, 100]
    pieces = s.partitions({"rows": 22}, {"rows": 90})
    assert sorted(i for p in pieces for b in s.read(p) for i in b.column(b.schema.get_field_index("trade_id")).to_pylist()) == list(range(22, 90))
    assert s.partitions({"rows": 90}, {"rows": 90}) == []


def test_stream_stopped_and_started_again(spark, recorded, tmp_path, monkeypatch):
    """Each row once, though the query ends and begins anew; the last run finds nothing more."""
    path = f"{tmp_path}/fast"
    replay.prepare_replay(trades(spark), path, speed=0.0)
    for _ in range(5):
        stream = brokers.open_feed(spark, FeedConfig(mode="replay"), path, f"{tmp_path}/fast.json") if _ == 4 else replay.replay_stream(spark, path, f"{tmp_path}/fast.json", 30)
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["trade_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(100))


class KilledOnce(transactional.EpochSink):
    """The task that writes trade 70 is killed the first time, after it wrote its file."""

    @classmethod
    def name(cls):
        return "killed_once"

    def streamWriter(self, schema, overwrite):
        marker = self.options["marker"]

        def send(file, batch):
            n = transactional.put(file, batch)
            if "/data/" in file and 70 in batch["trade_id"].to_pylist() and not os.path.exists(marker):
                Path(marker).touch()
                os._exit(1)
            return n

        return transactional.EpochWriter(self.options["path"], 0, 0, 0, send)


def test_a_killed_task(spark, tmp_path):
    trades(spark).repartitionByRange(4, "trade_id").write.parquet(f"{tmp_path}/in")
    spark.dataSource.register(KilledOnce)

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
        writer = stream.writeStream.format("killed_once").option("path", f"{tmp_path}/sink").option("marker", f"{tmp_path}/marker")
        writer.option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception):  # noqa: B017
        run()
    before = transactional.read_epochs(spark, f"{tmp_path}/sink", SCHEMA).count()
    run()
    got = transactional.read_epochs(spark, f"{tmp_path}/sink", SCHEMA)
    assert before in (0, 50) and sorted(r["trade_id"] for r in got.collect()) == list(range(100))
    found = transactional.epochs(spark, f"{tmp_path}/sink")
    assert found.agg(F.sum("published")).first()[0] == 100 and found.count() == 2
    # what the killed task left is in no manifest, and can be swept
    assert len(listed(f"{tmp_path}/sink/data")) > len(got.inputFiles())
    assert transactional.sweep(spark, f"{tmp_path}/sink", 3600) == 0 and transactional.sweep(spark, f"{tmp_path}/sink", 0) > 0
    assert transactional.read_epochs(spark, f"{tmp_path}/sink", SCHEMA).count() == 100


def batches(n=10, times=1):
    return iter([pa.RecordBatch.from_pydict({"trade_id": list(range(k * n, k * n + n))}) for k in range(times)])


def test_retries_dead_letters_and_drops(tmp_path, caplog, monkeypatch):
    monkeypatch.setattr(transactional, "FILE_ROWS", 10)
    calls = []

    def send(fails):
        def to(file, batch):
            calls.append(file)
            if fails(file, len(calls)):
                raise OSError("down")
            return transactional.put(file, batch)

        return to

    make = lambda fails: transactional.EpochWriter(str(tmp_path), 2, 0, 0, send(fails))
    with caplog.at_level(logging.ERROR):
        w = make(lambda file, n: n <= 2)
        said = w.write(batches(times=3))
    assert (said.counts["published"], said.counts["retries"], said.counts["batches"], said.counts["failed"]) == (30, 2, 3, 0)
    assert "attempt 1" in caplog.text and "down" in caplog.text
    dead = make(lambda file, n: "/data/" in file).write(batches(times=2))
    assert (dead.counts["dead_lettered"], dead.counts["failed"], dead.counts["dropped"], dead.files) == (20, 2, 0, [])
    lost = make(lambda file, n: True).write(batches())
    assert (lost.counts["dropped"], lost.counts["dead_lettered"], lost.counts["published"]) == (10, 0, 0) and "dropped" in caplog.text
    w.commit([said, dead, lost, None], 0)
    told = read_json(f"{tmp_path}/manifests/000000000000.json")
    assert (told["published"], told["dead_lettered"], told["dropped"], told["failed"]) == (30, 20, 10, 3) and len(told["files"]) == 3
    # the epoch again, after Spark missed that it was committed: the first one stands, the second leaves no file
    again = make(lambda file, n: False).write(batches(times=3))
    w.commit([again], 0)
    assert read_json(f"{tmp_path}/manifests/000000000000.json") == told and not set(again.files) & set(listed(f"{tmp_path}/data"))
    w.abort([None, make(lambda file, n: False).write(batches())], 1)
    assert sorted(listed(f"{tmp_path}/data")) == sorted(told["files"])


def test_empty_sink(spark, tmp_path):
    assert transactional.epochs(spark, str(tmp_path)).count() == transactional.read_epochs(spark, str(tmp_path), SCHEMA).count() == 0
    assert transactional.EpochWriter(str(tmp_path)).write(iter([])).counts["batches"] == 0


def test_open_sink_uses_all_settings(spark, tmp_path):
    """Files by topic, with retries; Kafka's options by topic; what isn't a sink of Spark's raises."""
    t = trades(spark)
    t.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    config = SinkConfig(kind="files", max_retries=1, retry_base_ms=1, retry_max_ms=2, topic="good", dlq_topic="bad", alerts_topic="loud")
    for output, folder in (("trades", "good"), ("dead_letters", "bad"), ("alerts", "loud")):
        sinks.open_sink(stream, config, str(tmp_path), f"{tmp_path}/ck-{folder}", output).trigger(availableNow=True).start().awaitTermination()
        assert transactional.read_epochs(spark, f"{tmp_path}/{folder}", SCHEMA).count() == 100
    options = {}

    class Writer:
        def options(self, **more):
            options.update(more)
            return self

    kafka = SinkConfig(kind="kafka", max_retries=7, retry_base_ms=11, retry_max_ms=99, dlq_topic="bad", sasl_mechanism="PLAIN", sasl_user="u", sasl_password="p")
    found = sinks.sink
    sinks.sink = lambda *a: Writer()
    try:
        sinks.open_sink(stream, kafka, output="dead_letters")
    finally:
        sinks.sink = found
    assert (options["topic"], options["kafka.retries"], options["kafka.retry.backoff.ms"], options["kafka.retry.backoff.max.ms"]) == ("bad", 7, 11, 99)
    assert options["kafka.sasl.mechanism"] == "PLAIN"
    with pytest.raises(ValueError):
        sinks.open_sink(stream, SinkConfig(kind="rabbitmq"))


def test_outcomes_of_batches_are_told(spark):
    told, calls = [], []

    def fails(batch, n):
        calls.append(n)
        raise RuntimeError("down")

    note = lambda *x: told.append(x)
    sinks.retrying(lambda b, n: None, fails, 2, 0.0, told=note)(spark.range(1), 1)
    sinks.retrying(fails, lambda b, n: None, 2, 0.0, told=note)(spark.range(1), 2)
    sinks.retrying(fails, fails, 1, 0.0, told=note)(spark.range(1), 3)
    assert told == [(1, "published", 1), (2, "dead_lettered", 3), (3, "dropped", 2)] and calls == [2, 2, 2, 3, 3, 3]
