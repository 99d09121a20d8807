"""Upserts, seeds and numbering of tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowgauge.tables import stored


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with the rows of ``changes`` in place of those with their keys."""
    return table.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes)


def configure(table: DataFrame, changes: DataFrame, actor: str, at_ms: Column, first_id: int = 1) -> tuple[DataFrame, DataFrame]:
    """``table`` (schema SYMBOL_CONFIG) with ``changes`` put in, and their audit entries (schema AUDIT).

    Symbols are upper-cased. Of several changes to one symbol, that with the
    largest values counts. Entries are numbered from ``first_id`` by symbol; a
    change without a symbol is none.
    """
    values = ("z_threshold", "ewma_alpha", "min_trades")
    named = changes.withColumn("symbol", F.upper("symbol")).filter("symbol is not null")
    last = named.groupBy("symbol").agg(F.max(F.struct(*values)).alias("v")).select("symbol", "v.*")
    numbers = numbered(last, ["symbol"], "number")
    entries = numbers.select(
        (F.col("number") + first_id - 1).cast("long").alias("id"),
        F.lit("CONFIG_CHANGE").alias("event_type"),
        F.lit(actor).alias("actor"),
        "symbol",
        F.lit(None).cast("string").alias("event_id"),
        F.to_json(F.struct(*values)).alias("details"),
        at_ms.cast("long").alias("created_at_ms"),
    )
    return upsert(table, last.select(*table.columns), ["symbol"]), entries


def write_archive(trades: DataFrame, path: str, files: int, time_ms: str = "ingested_at_ms") -> None:
    """Trades as Parquet in a folder for each ``ingest_date`` (UTC), sorted by symbol and time within files.

    Rows are dealt by ranges of (date, symbol, time), so that a hot day or symbol
    spreads over files, and a filter by date reads its folders, one by symbol
    just the row groups whose bounds hold it.
    """
    dated = trades.withColumn("ingest_date", F.to_date(F.timestamp_millis(F.col(time_ms))))
    order = ("ingest_date", "symbol", "trade_time_ms")
    dated.repartitionByRange(files, *order).sortWithinPartitions(*order).write.partitionBy("ingest_date").parquet(path)


def seed(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` and those of ``rows`` whose keys it lacks."""
    return table.unionByName(rows.join(table.select(*keys).distinct(), keys, "left_anti"))


def _unused(rows: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``rows`` has it."""
    while name in rows.columns:
        name += "_"
    return name


def _dealt(rows: DataFrame, order: list[str | Column], part_rows: int) -> DataFrame | None:
    """``rows`` in ranges of ``order`` with the range's number ``_part``, written; None if ``part_rows`` hold them all.

    There are never more ranges than the session has shuffle partitions: a range
    grows with the data and is sorted by Spark, which spills. With ``part_rows``
    of 0 rows are dealt without a count.
    """
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(most, math.ceil(rows.count() / part_rows)) if part_rows else most
    if part_rows and parts <= 1:
        return None
    return stored(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def running(
    rows: DataFrame, values: dict[str, Column], order: list[str | Column], key: str | None = None, part_rows: int = 1_000_000
) -> DataFrame:
    """``rows`` with running sums by ``order`` (within ``key``), the row's own value included; ``values`` names them.

    Neither a key nor the table is gathered in one task: rows are dealt by
    ranges of (key, order), each range is summed up by itself and moved by the
    sums before it. A range takes up one key at most from the range before, so
    what moves them is a row for each range.
    """
    keys = [] if key is None else [key]
    dealt = _dealt(rows, [*keys, *order], part_rows)
    if dealt is None:
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({n: F.sum(v).over(upto) for n, v in values.items()})
    sums = dealt.groupBy(*keys, "_part").agg(*[F.sum(v).alias(f"_{n}") for n, v in values.items()])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    at, of = (_unused(rows, c) for c in ("_at", "_of"))
    moved = sums.select(F.col("_part").alias(at), *[F.col(k).alias(of) for k in keys], *[F.sum(f"_{n}").over(earlier).alias(f"_{n}") for n in values], F.row_number().over(Window.partitionBy(*keys).orderBy("_part")).alias("_nth"))
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumns({n: F.sum(v).over(inside) for n, v in values.items()})
    # a row for each range at most, of which there are as many as shuffle partitions
    edges = F.broadcast(moved.filter("_nth > 1").drop("_nth"))
    same = F.col("_part") == F.col(at)
    if keys:
        same = same & F.col(key).eqNullSafe(F.col(of))
    joined = summed.join(edges, same, "left")
    return joined.select(*rows.columns, *[(F.col(n) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in values])


def numbered(rows: DataFrame, order: list[str | Column], name: str = "sequence", part_rows: int = 1_000_000, key: str | None = None) -> DataFrame:
    """``rows`` with their number from 1 by ``order`` (within ``key``), without gathering them in one task."""
    return running(rows, {name: F.lit(1).cast("long")}, order, key, part_rows)


def previous(rows: DataFrame, column: str, key: str, order: tuple[str, ...], name: str, part_rows: int = 1_000_000) -> DataFrame:
    """``rows`` with ``name``: ``column`` of the row before by ``order`` within ``key``, null for a key's first row.

    A key may hold any share of the rows: these are dealt by ranges of
    (key, order), and a range's first key takes up where the range before
    ended, a row for each range at most.
    """
    dealt = _dealt(rows, [key, *order], part_rows)
    if dealt is None:
        return rows.withColumn(name, F.lag(column).over(Window.partitionBy(key).orderBy(*order)))
    ends = dealt.groupBy(key, "_part").agg(F.max_by(column, F.struct(*order)).alias("_end"))
    before = F.lag("_end").over(Window.partitionBy(key).orderBy("_part"))
    # only a key that goes on from the range before has one
    at, of = (_unused(rows, c) for c in ("_at", "_of"))
    edges = ends.select(F.col(key).alias(of), F.col("_part").alias(at), before.alias("_edge")).filter("_edge is not null")
    inside = Window.partitionBy(key, "_part").orderBy(*order)
    lagged = dealt.withColumn(name, F.lag(column).over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    joined = lagged.join(F.broadcast(edges), F.col(key).eqNullSafe(F.col(of)) & (F.col("_part") == F.col(at)), "left")
    return joined.withColumn(name, F.when(F.col("_first"), F.col("_edge")).otherwise(F.col(name))).drop("_part", "_first", of, at, "_edge")


def filled(rows: DataFrame, columns: tuple[str, ...], order: list[str | Column], key: str, part_rows: int = 1_000_000) -> DataFrame:
    """``rows`` with nulls of ``columns`` replaced by the last value before them by ``order`` within ``key``.

    As in ``running``, a key may hold any share of the rows: a range carries its
    last values along, and takes up what the ranges before it knew.
    """
    upto = lambda *by: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    dealt = _dealt(rows, [key, *order], part_rows)
    if dealt is None:
        return rows.withColumns({c: last(c, upto(key)) for c in columns})
    ends = dealt.groupBy(key, "_part").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_{c}") for c in columns])
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    nth = F.row_number().over(Window.partitionBy(key).orderBy("_part")).alias("_nth")
    at, of = (_unused(rows, c) for c in ("_at", "_of"))
    known = ends.select(F.col(key).alias(of), F.col("_part").alias(at), *[last(f"_{c}", earlier).alias(f"_{c}") for c in columns], nth)
    inside = dealt.withColumns({c: last(c, upto("_part", key)) for c in columns})
    # only a key that goes on from the range before: a row for each range at most
    edges = F.broadcast(known.filter("_nth > 1").drop("_nth"))
    joined = inside.join(edges, F.col(key).eqNullSafe(F.col(of)) & (F.col("_part") == F.col(at)), "left")
    return joined.select(*[F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(f"`{c}`") for c in rows.columns])


def replay(rows: DataFrame, number: str, start_row: int = 0, max_rows: int = 0, passes: int = 1) -> DataFrame:
    """``passes`` runs over the rows from ``start_row`` on, with ``pass`` from 0; ``max_rows`` over all passes if positive."""
    if start_row > 0:
        rows = rows.filter(F.col(number) >= start_row)
    n = rows.count() if max_rows > 0 else 0
    out = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    if max_rows > 0:
        first = max(start_row, 1)
        out = out.filter(F.col("pass") * n + F.col(number) - first < max_rows)
    return out
