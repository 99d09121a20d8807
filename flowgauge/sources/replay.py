"""A stream that replays recorded trades: each is admitted when it is due.

``prepare_replay`` works out when each trade is due, by the gaps between trades
and the speed, and writes the trades in that order; an index names the files
with their numbers of rows. The stream's offset is a number of rows. It advances
to what the clock has reached, by so many rows a trigger at most, and is noted
before Spark is told of it: a restarted stream goes on where it was.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

from flowgauge.operators.scoring import with_pacing
from flowgauge.operators.tables import running
from flowgauge.sources.files import exists, open_file, read_json, write_json
from flowgauge.tables import stored

INDEX = "_index.json"


def prepare_replay(trades: DataFrame, path: str, speed: float = 1.0, files: int = 16) -> None:
    """Writes ``trades`` with ``due_ms``, in the order in which they are due, as at most ``files`` Parquet files and an index.

    A symbol's trade is due after the one before it by the gap between their
    times, divided by ``speed`` and capped (``with_pacing``); at speed 0 all are
    due at once. Pacing and sums go by ranges, whatever a symbol's share.
    """
    spark = trades.sparkSession
    paced = with_pacing(trades, speed)
    due = running(paced, {"due_ms": F.col("delay_ms").cast("long")}, ["trade_time_ms", "trade_id"], "symbol").drop("delay_ms")
    order = ("due_ms", "trade_time_ms", "symbol", "trade_id")
    stored(due, "due").repartitionByRange(files, *order).sortWithinPartitions(*order).write.parquet(path)
    name = F.col("_metadata.file_path")
    found = spark.read.parquet(path).groupBy(name.alias("file")).agg(F.count("*").alias("rows"), F.min("due_ms").alias("due_ms"))
    # a row for each file; their names follow their order
    index = [r.asDict() for r in found.orderBy("file").collect()]
    write_json(f"{path}/{INDEX}", {"files": index, "total": sum(f["rows"] for f in index)})


class Piece(InputPartition):
    """Rows ``start`` to ``end`` of a file."""

    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


def _pieces(index: dict, start: int, end: int) -> list[Piece]:
    out, before = [], 0
    for f in index["files"]:
        a, b = max(start, before), min(end, before + f["rows"])
        if a < b:
            out.append(Piece(f["file"], a - before, b - before))
        before += f["rows"]
    return out


def _read(piece: Piece, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Only the row groups that hold the piece are read, a batch at a time."""
    with open_file(piece.file) as f:
        file, at = pq.ParquetFile(f), 0
        for group in range(file.num_row_groups):
            n = file.metadata.row_group(group).num_rows
            if at + n > piece.start and at < piece.end:
                here = at
                for b in file.iter_batches(row_groups=[group], columns=names):
                    some = b.slice(max(0, piece.start - here), max(0, min(piece.end, here + b.num_rows) - max(piece.start, here)))
                    here += b.num_rows
                    if some.num_rows:
                        yield some
            at += n


class ReplayReader(DataSourceReader):
    """All recorded trades at once."""

    def __init__(self, path: str, schema: T.StructType):
        self.path, self.names = path, schema.fieldNames()

    def partitions(self) -> list[Piece]:
        index = read_json(f"{self.path}/{INDEX}")
        return _pieces(index, 0, index["total"])

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return _read(partition, self.names)


class ReplayStream(DataSourceStreamReader):
    """Offsets are ``{"rows": n}``: so many trades have been admitted.

    ``progress`` is a file of the query's own: the last offset that Spark was
    told of, and the replay's clock at that moment.
    """

    def __init__(self, path: str, schema: T.StructType, progress: str, most_rows: int):
        self.path, self.names, self.progress, self.most_rows = path, schema.fieldNames(), progress, most_rows
        self.since = None

    def initialOffset(self) -> dict:
        return {"rows": 0}

    def _due(self, index: dict, start: int, end: int, clock: float) -> int:
        """How many of the rows from ``start`` to ``end`` are due: whole files by the index, and one of them by its column."""
        n = start
        for piece in _pieces(index, start, end):
            for b in _read(piece, ["due_ms"]):
                due = sum(t <= clock for t in b.column(0).to_pylist())
                n += due
                if due < b.num_rows:
                    return n
        return n

    def latestOffset(self) -> dict:
        index = read_json(f"{self.path}/{INDEX}")
        noted = read_json(self.progress) if exists(self.progress) else {"rows": 0, "clock_ms": 0.0}
        if self.since is None:  # the clock stands while the query does
            self.since = time.monotonic() - noted["clock_ms"] / 1000
        clock = (time.monotonic() - self.since) * 1000
        end = min(index["total"], noted["rows"] + self.most_rows)
        rows = self._due(index, noted["rows"], end, clock)
        write_json(self.progress, {"rows": rows, "clock_ms": clock})
        return {"rows": rows}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return _pieces(read_json(f"{self.path}/{INDEX}"), start["rows"], end["rows"])

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return _read(partition, self.names)


class TradeReplay(DataSource):
    """``format("trade_replay")``: options ``path``, and of a stream ``progress`` (a file) and ``mostRows`` a trigger."""

    @classmethod
    def name(cls) -> str:
        return "trade_replay"

    def schema(self) -> T.StructType:
        file = read_json(f"{self.options['path']}/{INDEX}")["files"][0]["file"]
        with open_file(file) as f:
            return from_arrow_schema(pq.read_schema(f))

    def reader(self, schema: T.StructType) -> ReplayReader:
        return ReplayReader(self.options["path"], schema)

    def streamReader(self, schema: T.StructType) -> ReplayStream:
        return ReplayStream(self.options["path"], schema, self.options["progress"], int(self.options.get("mostRows", 1_000_000)))


def replay_stream(spark: SparkSession, path: str, progress: str, most_rows: int = 1_000_000) -> DataFrame:
    """The recorded trades below ``path`` as a stream."""
    spark.dataSource.register(TradeReplay)
    return spark.readStream.format("trade_replay").option("path", path).option("progress", progress).option("mostRows", most_rows).load()
