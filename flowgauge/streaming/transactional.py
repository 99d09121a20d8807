"""A sink of files with a manifest for each epoch: a row is seen once its epoch is committed, and then once.

Tasks write files of their own and say which; the driver names them in the
epoch's manifest, which appears whole or not at all. An epoch that is run again
after its manifest was written changes nothing, files of tasks that failed are
in no manifest, and readers take their files from manifests alone.
"""

from __future__ import annotations

import logging
import random
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import DataStreamWriter

from flowgauge.config import SinkConfig
from flowgauge.sources.files import exists, listed, of, read_json, remove, write_json

log = logging.getLogger(__name__)
COUNTS = ("published", "dead_lettered", "dropped", "batches", "failed", "retries", "n_bytes")
#: Rows of a file at most: what is sent, retried and dead-lettered as one.
FILE_ROWS = 100_000


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its files and counts."""

    files: list[str] = field(default_factory=list)
    dead: list[str] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(COUNTS, 0))


def put(path: str, batch: pa.Table) -> int:
    """Writes a file; its bytes."""
    system, where = of(path)
    system.create_dir(where.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(where) as f:
        pq.write_table(batch, f)
    return system.get_file_info(where).size


class EpochWriter(DataSourceStreamArrowWriter):
    """Writes files, again after growing pauses where that fails; then to the dead letters, and counts as dropped what can't go there either."""

    def __init__(self, path: str, max_retries: int = 5, retry_base_ms: int = 100, retry_max_ms: int = 5_000, send: Callable[[str, pa.Table], int] = put):
        self.path, self.retries, self.base, self.most, self.send = path, max_retries, retry_base_ms, retry_max_ms, send

    def _manifest(self, epoch: int) -> str:
        return f"{self.path}/manifests/{epoch:012d}.json"

    def _deliver(self, folder: str, batch: pa.Table, counts: dict[str, int]) -> str | None:
        """The file that was written, or None after all attempts."""
        for attempt in range(self.retries + 1):
            file = f"{self.path}/{folder}/{uuid.uuid4().hex}.parquet"
            try:
                counts["n_bytes"] += self.send(file, batch)
                return file
            except Exception:
                log.exception("attempt %d to write %d rows to %s failed", attempt + 1, batch.num_rows, folder)
                if attempt < self.retries:
                    counts["retries"] += 1
                    time.sleep(min(self.base * 2**attempt, self.most) / 1000 * random.uniform(0.5, 1))
        return None

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        said, held, rows = Written(), [], 0

        def flush() -> None:
            batch = pa.Table.from_batches(held)
            said.counts["batches"] += 1
            file = self._deliver("data", batch, said.counts)
            if file:
                said.files.append(file)
                said.counts["published"] += batch.num_rows
                return
            said.counts["failed"] += 1
            file = self._deliver("dead", batch, said.counts)
            if file:
                said.dead.append(file)
            else:
                log.error("%d rows dropped: neither the sink nor its dead letters can be written", batch.num_rows)
            said.counts["dead_lettered" if file else "dropped"] += batch.num_rows

        for b in iterator:
            for k in range(0, b.num_rows, FILE_ROWS):
                some = b.slice(k, FILE_ROWS)
                held.append(some)
                rows += some.num_rows
                if rows >= FILE_ROWS:
                    flush()
                    held.clear()
                    rows = 0
        if held:
            flush()
        return said

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        done = [m for m in messages if m is not None]
        if exists(self._manifest(batchId)):  # committed before, but Spark didn't learn of it
            self.abort(messages, batchId)
            return
        counts = {c: sum(m.counts[c] for m in done) for c in COUNTS}
        write_json(self._manifest(batchId), {"epoch": batchId, "files": [f for m in done for f in m.files], "dead": [f for m in done for f in m.dead], **counts})

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        for m in messages:
            for f in (m.files + m.dead) if m is not None else ():
                remove(f)


class EpochSink(DataSource):
    """``format("trade_epochs")``: options ``path``, ``maxRetries``, ``retryBaseMs`` and ``retryMaxMs``."""

    @classmethod
    def name(cls) -> str:
        return "trade_epochs"

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> EpochWriter:
        number = lambda name, default: int(self.options.get(name, default))
        return EpochWriter(self.options["path"], number("maxRetries", 5), number("retryBaseMs", 100), number("retryMaxMs", 5_000))


def write_epochs(stream: DataFrame, path: str, checkpoint: str, config: SinkConfig | None = None) -> DataStreamWriter:
    """A writer of the stream's epochs below ``path``, with the retries of ``config``."""
    c = config or SinkConfig()
    stream.sparkSession.dataSource.register(EpochSink)
    writer = stream.writeStream.format("trade_epochs").option("path", path).option("checkpointLocation", checkpoint)
    return writer.options(maxRetries=c.max_retries, retryBaseMs=c.retry_base_ms, retryMaxMs=c.retry_max_ms)


def epochs(spark: SparkSession, path: str) -> DataFrame:
    """``(epoch, files, dead, ...)``: the committed epochs with their counts, read by Spark."""
    schema = "epoch long, files array<string>, dead array<string>, " + ", ".join(f"{c} long" for c in COUNTS)
    if not listed(f"{path}/manifests"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(f"{path}/manifests")


def read_epochs(spark: SparkSession, path: str, schema: T.StructType | str, dead: bool = False) -> DataFrame:
    """The rows of all committed epochs, or their dead letters; the names of files pass through the driver, as in any listing."""
    files = [r["file"] for r in epochs(spark, path).select(F.explode("dead" if dead else "files").alias("file")).collect()]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def sweep(spark: SparkSession, path: str, older_than_s: float = 3600) -> int:
    """Removes files that no manifest names and that are old enough to belong to no running epoch; their number."""
    known = {r["file"] for r in epochs(spark, path).select(F.explode(F.concat("files", "dead")).alias("file")).collect()}
    gone = 0
    for folder in ("data", "dead"):
        for f in listed(f"{path}/{folder}"):
            system, where = of(f)
            if f not in known and time.time() - system.get_file_info(where).mtime.timestamp() >= older_than_s:
                remove(f)
                gone += 1
    return gone
