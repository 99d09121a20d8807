"""Tables laid out for their readers: sorted files that know their places, and files clustered in several dimensions.

A sorted table has an index of the rows before each file: any page, however
deep, is read from the files that hold it. A clustered table follows a
space-filling curve and has a zone map, the least and largest values of each
file: filters on any of the dimensions leave files out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowgauge.tables import stored

#: Bits of each dimension of the curve, and of a text's code.
BITS, CODE_BITS = 6, 10


def _files(spark: SparkSession, path: str, *columns: Column) -> DataFrame:
    """A row for each file of the table: its name, rows, and aggregates."""
    return spark.read.parquet(f"{path}/data").groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n_rows"), *columns)


def write_sorted(rows: DataFrame, path: str, order: list[Column], files: int) -> None:
    """Writes ``rows`` by ``order`` as at most ``files`` files, and their index ``(file, n_rows, before)``.

    Rows are dealt by ranges; names of files follow their order.
    """
    spark = rows.sparkSession
    rows.repartitionByRange(files, *order).sortWithinPartitions(*order).write.parquet(f"{path}/data")
    before = F.coalesce(F.sum("n_rows").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each file
    _files(spark, path).withColumn("before", before).coalesce(1).write.parquet(f"{path}/index")


def sorted_page(spark: SparkSession, path: str, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """``limit`` rows after ``offset``, read from the files that hold them alone."""
    index = spark.read.parquet(f"{path}/index")
    some = index.filter((F.col("before") < offset + limit) & (F.col("before") + F.col("n_rows") > offset)).orderBy("before").collect()
    if not some:
        return spark.read.parquet(f"{path}/data").limit(0)
    rows = spark.read.parquet(*[r["file"] for r in some])
    return rows.orderBy(*order).offset(offset - some[0]["before"]).limit(limit)


def sorted_total(spark: SparkSession, path: str) -> int:
    """The number of rows, by the index."""
    return spark.read.parquet(f"{path}/index").agg(F.sum("n_rows")).first()[0] or 0


def next_page(spark: SparkSession, path: str, order: list[Column], limit: int, after: Column) -> DataFrame:
    """``limit`` rows for which ``after`` holds, the first by ``order``: seeking by the last row's key, where Parquet's statistics leave files out."""
    return spark.read.parquet(f"{path}/data").filter(after).orderBy(*order).limit(limit)


def _morton(dimensions: list[Column]) -> Column:
    """The bits of several numbers of ``BITS`` bits, interleaved."""
    n, out = len(dimensions), F.lit(0).cast("long")
    for bit in range(BITS):
        for d, c in enumerate(dimensions):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c, bit).bitwiseAND(F.lit(1).cast("long")), bit * n + d))
    return out


def _place(value: Column, cuts: list[float]) -> Column:
    """A value's place among equally filled parts: the middle of those that it fills, if there are many such values."""
    if not cuts:
        return F.lit(0).cast("long")
    below = lambda test: F.size(F.filter(F.array(*map(F.lit, cuts)), test))
    return F.floor((below(lambda c: c <= value) + below(lambda c: c < value)) / 2).cast("long")


def code(value: Column) -> Column:
    """A text as a number that an equality keeps."""
    return F.pmod(F.xxhash64(value), F.lit(1 << CODE_BITS))


def write_curve(rows: DataFrame, path: str, files: int, names: list[str], ranges: dict[str, Column]) -> None:
    """Writes ``rows`` along a curve over the text columns ``names`` and the numbers ``ranges``, as at most ``files`` files, with a zone map.

    Each dimension is cut at 63 quantiles, so that dense stretches are told apart
    as finely as sparse ones. Zones hold the codes of each name, 1,024 at most,
    and the least and largest value of each range.
    """
    spark = rows.sparkSession
    values = {n: code(F.col(n)) for n in names} | ranges
    marks = [k / 64 for k in range(1, 64)]
    cuts = rows.agg(*[F.percentile_approx(v, marks).alias(n) for n, v in values.items()]).first()
    dimensions = [_place(v, cuts[n] or []) for n, v in values.items()]
    # written, so that places are worked out once and not again for the bounds of ranges
    placed = stored(rows.withColumn("_curve", _morton(dimensions)), "curve")
    placed.repartitionByRange(files, "_curve").sortWithinPartitions("_curve").drop("_curve").write.parquet(f"{path}/data")
    codes = [F.collect_set(code(F.col(n))).alias(f"codes_{n}") for n in names]
    bounds = [f(v).alias(f"{side}_{n}") for n, v in ranges.items() for side, f in (("low", F.min), ("high", F.max))]
    _files(spark, path, *codes, *bounds).coalesce(1).write.parquet(f"{path}/zones")


def curve_files(spark: SparkSession, path: str, equal: dict[str, str], between: dict[str, tuple[Column | None, Column | None]]) -> list[str]:
    """The files that may hold rows with these texts, and numbers from the first to the second bound (None: no bound), by the zone map."""
    zones = spark.read.parquet(f"{path}/zones")
    for name, text in equal.items():
        zones = zones.filter(F.array_contains(f"codes_{name}", code(F.lit(text))))
    for name, (low, high) in between.items():
        if low is not None:
            zones = zones.filter(F.col(f"high_{name}") >= low)
        if high is not None:
            zones = zones.filter(F.col(f"low_{name}") <= high)
    return [r["file"] for r in zones.select("file").collect()]


def curve_rows(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    """The rows of those files; what the bounds leave out within them is the caller's to filter."""
    return spark.read.parquet(*files) if files else spark.read.parquet(f"{path}/data").limit(0)


def write_alerts(alerts: DataFrame, path: str, files: int) -> None:
    """Alerts along a curve over (symbol, time, |z|)."""
    write_curve(alerts, path, files, ["symbol"], {"time": F.unix_micros("alerted_at"), "z": F.abs("z_score")})


def alert_files(
    spark: SparkSession, path: str, symbol: str | None = None, from_time: str | None = None, to_time: str | None = None, min_z: float | None = None, max_z: float | None = None
) -> list[str]:
    """The files that may hold alerts of these bounds, which are those of ``alert_history``."""
    moment = lambda t: None if t is None else F.unix_micros(F.lit(t).cast("timestamp"))
    number = lambda z: None if z is None else F.lit(float(z))
    equal = {"symbol": symbol.strip().upper()} if symbol and symbol.strip() else {}
    return curve_files(spark, path, equal, {"time": (moment(from_time), moment(to_time)), "z": (number(min_z), number(max_z))})


def write_audit(entries: DataFrame, path: str, files: int) -> None:
    """Audit entries along a curve over (event type, symbol, time)."""
    write_curve(entries, path, files, ["event_type", "symbol"], {"time": F.col("created_at_ms")})


def audit_history(spark: SparkSession, path: str, event_type: str | None = None, symbol: str | None = None, from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    """Entries of a type, a symbol and a time, any of them, from the files that may hold them; bounds are inclusive."""
    number = lambda ms: None if ms is None else F.lit(ms)
    equal = {n: v for n, v in (("event_type", event_type), ("symbol", symbol)) if v is not None}
    rows = curve_rows(spark, path, curve_files(spark, path, equal, {"time": (number(from_ms), number(to_ms))}))
    for name, text in equal.items():
        rows = rows.filter(F.col(name) == text)
    if from_ms is not None:
        rows = rows.filter(F.col("created_at_ms") >= from_ms)
    return rows if to_ms is None else rows.filter(F.col("created_at_ms") <= to_ms)
