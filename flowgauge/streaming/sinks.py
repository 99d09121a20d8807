"""Writers of streams, one micro-batch at a time."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener

from flowgauge.config import NormalizeConfig, SinkConfig
from flowgauge.operators import snapshots
from flowgauge.operators.audit import build_chain, chain_heads
from flowgauge.operators.metrics import outcome_counts
from flowgauge.operators.normalize import dead_letters, good_trades, normalize, validate_json
from flowgauge.sources.brokers import kafka_sink_options
from flowgauge.sources.files import write_json
from flowgauge.streaming.transactional import write_epochs

log = logging.getLogger(__name__)


def ndjson(rows: DataFrame, prefix: str = "") -> DataFrame:
    """JSON lines; dead letters take the prefix ``DLQ``."""
    return rows.select(F.concat(F.lit(prefix), F.to_json(F.struct("*"))).alias("value"))


def batch_folder(path: str, batch_id: int) -> str:
    """A batch writes its own folder: one that is written again after a failure replaces itself."""
    return f"{path}/batch={batch_id}"


def split_writer(good: str, bad: str, config: NormalizeConfig, counts: str = "") -> Callable[[DataFrame, int], None]:
    """Writes a batch of raw trades as trades and dead letters, and below ``counts``, if given, a row of its outcomes.

    The outcomes are counted as the rows pass by (``observe``): no second scan.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        found = normalize(batch, config, F.unix_millis(F.current_timestamp()))
        seen = Observation(f"outcomes-{batch_id}")
        found = found.observe(seen, *outcome_counts(F.octet_length("payload"))).persist()
        good_trades(found, config).write.mode("overwrite").parquet(batch_folder(good, batch_id))
        dead_letters(found, config).write.mode("overwrite").parquet(batch_folder(bad, batch_id))
        found.unpersist()
        if counts:
            write_json(f"{counts}/{batch_id:012d}.json", {"batch": batch_id, **seen.get})

    return write


class BatchRows(StreamingQueryListener):
    """Writes a row for each batch of a query: its rows, times, and what its observations counted."""

    def __init__(self, path: str):
        self.path = path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = {"name": p.name, "batch": p.batchId, "input_rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "duration_ms": p.batchDuration}
        for name, seen in p.observedMetrics.items():
            row |= {f"{name}.{k}": v for k, v in seen.asDict().items()}
        write_json(f"{self.path}/{p.runId}-{p.batchId:012d}.json", row)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def scores_writer(good: str, late: str, told: Callable[[int, dict[str, int]], None] | None = None) -> Callable[[DataFrame, int], None]:
    """Writes a batch of scores, and trades that came too late beside them; ``told`` is given the batch's counts of both.

    The counts are taken as the rows pass by, without another job.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = Observation(f"scores-{batch_id}")
        found = batch.observe(counts, F.count_if(~F.col("late")).alias("scored"), F.count_if("late").alias("late")).persist()
        found.filter(~F.col("late")).drop("late").write.mode("overwrite").parquet(batch_folder(good, batch_id))
        found.filter("late").drop("late").write.mode("overwrite").parquet(batch_folder(late, batch_id))
        found.unpersist()
        if told is not None:
            told(batch_id, counts.get)

    return write


def json_writer(good: str, bad: str) -> Callable[[DataFrame, int], None]:
    """Checks a batch of messages ``(key, value)``: what passes goes on as JSON in canonical form, the rest as it came, both with their keys."""
    fields = ("event_id", "exchange", "symbol", "trade_id", "side", "price", "quantity", "trade_time_ms")

    def write(batch: DataFrame, batch_id: int) -> None:
        messages = batch.select("key", F.col("value").cast("string").alias("value"))
        found = validate_json(messages).persist()
        passed = found.filter("reason is null").select("key", F.to_json(F.struct(*fields)).alias("value"))
        passed.write.mode("overwrite").parquet(batch_folder(good, batch_id))
        found.filter("reason is not null").select("key", "value").write.mode("overwrite").parquet(batch_folder(bad, batch_id))
        found.unpersist()

    return write


def state_writer(path: str, n_buckets: int = 64, keep: int = 2) -> Callable[[DataFrame, int], None]:
    """Keeps the last state of each symbol as snapshots, a version for each batch; buckets that a batch doesn't touch keep their files."""

    def write(batch: DataFrame, batch_id: int) -> None:
        last = F.max_by(F.struct("ewma", "ewma_var", "trade_count"), "trade_count").alias("s")
        snapshots.merge(path, batch.groupBy("symbol").agg(last).select("symbol", "s.*"), ["symbol"], n_buckets, batch_id)
        snapshots.expire(path, keep)

    return write


def alert_writer(
    alerts: str, log: str, hook: Callable[[DataFrame, int], None] | None = None, heads: str = ""
) -> Callable[[DataFrame, int], None]:
    """Stores a batch of alerts, then their audit entries (one chain for each batch and symbol), then calls ``hook``.

    ``heads`` may name a folder for the ends of the chains, by which a chain
    that is gone or was cut short is found (``verify_parts``).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_folder(alerts, batch_id))
        kept = batch.sparkSession.read.schema(batch.schema).parquet(batch_folder(alerts, batch_id))
        events = kept.select(
            F.col("trade_id").alias("id"),
            F.lit("ALERT").alias("event_type"),
            F.lit("system").alias("actor"),
            "symbol",
            F.col("trade_id").cast("string").alias("event_id"),
            F.to_json(F.struct(*sorted(c for c in kept.columns if c != "symbol"))).alias("details"),
            F.col("trade_time_ms").alias("created_at_ms"),
            F.concat_ws("/", F.lit(str(batch_id)), "symbol").alias("segment"),
        )
        build_chain(events).write.mode("overwrite").parquet(batch_folder(log, batch_id))
        if heads:
            chain_heads(batch.sparkSession.read.parquet(batch_folder(log, batch_id))).write.mode("overwrite").parquet(batch_folder(heads, batch_id))
        if hook is not None:
            hook(kept, batch_id)

    return write


def retrying(
    write: Callable[[DataFrame, int], None],
    dead_letter: Callable[[DataFrame, int], None],
    retries: int = 5,
    base_s: float = 0.1,
    most_s: float = 5.0,
    told: Callable[[int, str, int], None] | None = None,
) -> Callable[[DataFrame, int], None]:
    """Repeats a batch's write after growing pauses; when all attempts fail, the batch goes to ``dead_letter``.

    ``told`` is given each batch's number, its outcome (published, dead_lettered
    or dropped) and the attempts it took. Failures are logged; a batch that
    can't be dead-lettered either is dropped, and the stream goes on.
    """
    told = told or (lambda n, outcome, attempts: None)

    def run(batch: DataFrame, batch_id: int) -> None:
        for attempt in range(retries + 1):
            try:
                write(batch, batch_id)
                return told(batch_id, "published", attempt + 1)
            except Exception:
                log.exception("attempt %d to write batch %d failed", attempt + 1, batch_id)
                if attempt < retries:
                    time.sleep(min(base_s * 2**attempt, most_s))
        try:
            dead_letter(batch, batch_id)
            told(batch_id, "dead_lettered", retries + 1)
        except Exception:
            log.exception("batch %d dropped: its dead letters can't be written", batch_id)
            told(batch_id, "dropped", retries + 1)

    return run


#: The setting that names the topic of each kind of output.
TOPICS = {"trades": "topic", "dead_letters": "dlq_topic", "alerts": "alerts_topic"}


def open_sink(stream: DataFrame, config: SinkConfig, path: str = "", checkpoint: str = "", output: str = "trades") -> DataStreamWriter:
    """The writer that ``config.kind`` names, with all its settings, for ``output``: trades, dead_letters or alerts.

    Kafka retries by its own settings and takes the output's topic. Files are
    written as epochs (``write_epochs``) in a folder named like the topic, a
    batch's rows again after failures and then as dead letters. A message queue
    takes ``foreachBatch`` and routing keys instead.
    """
    topic = getattr(config, TOPICS[output])
    if config.kind == "files":
        return write_epochs(stream, f"{path}/{topic}", checkpoint, config)
    writer = sink(stream, config.kind, path, checkpoint)
    if config.kind == "kafka":
        login = (config.sasl_mechanism or None, config.sasl_user, config.sasl_password)
        more = {"kafka.retries": config.max_retries, "kafka.retry.backoff.ms": config.retry_base_ms, "kafka.retry.backoff.max.ms": config.retry_max_ms}
        writer = writer.options(**kafka_sink_options(config.brokers, topic, config.acks, config.compression, *login, config.tls), **more)
    return writer


def sink(stream: DataFrame, kind: str, path: str = "", checkpoint: str = "") -> DataStreamWriter:
    """A writer by name: ``stdout``, ``discard``, ``files`` or ``kafka`` (further options are the caller's)."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint) if checkpoint else stream.writeStream
    if kind == "stdout":
        return writer.format("console")
    if kind == "discard":
        return writer.format("noop")
    if kind == "files":
        return writer.format("parquet").option("path", path)
    if kind == "kafka":
        return writer.format("kafka")
    raise ValueError(f"unknown sink {kind!r}")
