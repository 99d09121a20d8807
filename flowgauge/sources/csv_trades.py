"""Trade dumps in CSV: layouts, aliases and lenient parsing.

Files are read as text, so that a broken line never fails a job: a row that
can't be read has a null trade_id or time, and is filtered and counted. Fields
may be quoted. Each file has a layout of its own, found from its first line.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.config import FeedConfig
from flowgauge.functions import scalars as S
from flowgauge.operators.tables import numbered, replay
from flowgauge.tables import stored

#: Spellings of each column, without case, ``_``, ``-``, ``.`` and spaces; and the columns by place.
ALIASES = {
    "trade_id": ("id", "tradeid", "aggtradeid", "a"),
    "price": ("price", "p"),
    "quantity": ("qty", "quantity", "q", "size"),
    "quote_quantity": ("quoteqty", "quotequantity", "quote"),
    "time": ("time", "timestamp", "transacttime", "tradetime", "t"),
    "maker": ("isbuyermaker", "buyermaker", "maker", "m"),
}
POSITIONS = {
    "trades6": {"trade_id": 0, "price": 1, "quantity": 2, "time": 3, "maker": 4},
    "trades7": {"trade_id": 0, "price": 1, "quantity": 2, "quote_quantity": 3, "time": 4, "maker": 5},
    "aggTrades": {"trade_id": 0, "price": 1, "quantity": 2, "time": 5, "maker": 6},
}


def plain(name: str) -> str:
    """A column name without case and separators."""
    return name.strip().lower().translate(str.maketrans("", "", "_-. "))


def layout_of(header: str | None, setting: str = "auto") -> str:
    """``aggTrades`` if the header names an aggregate id, else ``trades``."""
    if setting != "auto":
        return "aggTrades" if setting.lower() == "aggtrades" else "trades"
    return "aggTrades" if header and "aggtradeid" in map(plain, next(csv.reader([header]))) else "trades"


def column_positions(header: str | None, width: int, layout: str) -> dict[str, int]:
    """Which field holds which column: by the header's names, else by layout and the first line's width."""
    if header is None:
        return POSITIONS["aggTrades" if layout == "aggTrades" else "trades7" if width >= 7 else "trades6"]
    names = [plain(x) for x in next(csv.reader([header]))]
    found = {c: next((names.index(a) for a in spelled if a in names), None) for c, spelled in ALIASES.items()}
    missing = [c for c in ("trade_id", "price", "quantity", "time") if found[c] is None]
    if missing:
        raise ValueError(f"the header lacks {', '.join(missing)}")
    return {c: k for c, k in found.items() if k is not None}


def _with_fields(lines: DataFrame, value: str, width: int) -> DataFrame:
    """``lines`` with their first ``width`` fields ``_f0``, ...; quotes around a field may hold commas, a stray quote is a character.

    A generator, so that Catalyst reads each line once and not for every use of a field.
    """
    schema = ", ".join(f"_f{k} string" for k in range(width))
    read = F.from_csv(F.col(value), schema, {"mode": "PERMISSIVE", "quote": '"', "escape": '"', "nullValue": "\u0000"})
    return lines.select("*", F.inline(F.array(read)))


def parse_lines(
    lines: DataFrame, value: str, positions: dict[str, int | Column], symbol: Column, exchange: str, width: int = 16, plain_time: bool | Column = False
) -> DataFrame:
    """Lines as raw trades (schema RAW_TRADE); unreadable ids and times are null.

    A position is a field's number, or a column of it (null: the file has no
    such field). With ``plain_time`` times are whole numbers taken as they stand,
    as in dumps without a header.
    """
    lines = _with_fields(lines, value, width)
    fields = F.array(*[F.trim(f"_f{k}", F.lit(' "\r')) for k in range(width)])
    at = lambda c: positions[c] if isinstance(positions[c], Column) else F.lit(positions[c])
    fixed = lambda c: isinstance(positions[c], int) and positions[c] < width
    one = lambda c: F.trim(f"_f{positions[c]}", F.lit(' "\r')) if fixed(c) else F.try_element_at(fields, at(c) + 1)
    get = lambda c: one(c) if c in positions else F.lit(None).cast("string")
    whole = get("time").try_cast("long")
    as_is = plain_time if isinstance(plain_time, Column) else F.lit(plain_time)
    time = F.when(as_is, whole).otherwise(S.parse_time_ms(get("time")))
    return lines.select(
        F.lit(exchange).alias("exchange"),
        symbol.alias("symbol"),
        F.lit("csv").alias("source"),
        get("trade_id").try_cast("long").alias("trade_id"),
        get("price").alias("price"),
        get("quantity").alias("quantity"),
        get("quote_quantity").alias("quote_quantity"),
        S.parse_flag(get("maker")).alias("is_buyer_maker"),
        time.alias("trade_time_ms"),
        time.alias("event_time_ms"),
        F.col(value).alias("payload"),
    )


def readable(raw: DataFrame) -> DataFrame:
    """Rows whose id and time could be read; the others are skipped, not dead-lettered."""
    return raw.filter("trade_id is not null and trade_time_ms is not null")


def skipped(raw: DataFrame) -> DataFrame:
    """``(symbol, n_rows, n_skipped)``: rows of each symbol, and those that ``readable`` leaves out."""
    bad = F.col("trade_id").isNull() | F.col("trade_time_ms").isNull()
    return raw.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("n_skipped"))


#: Headers and widths that one read may meet: dumps have few, and a folder of other files is an error.
MOST_LAYOUTS = 100


def _layouts(lines: DataFrame, config: FeedConfig) -> tuple[DataFrame, list[dict]]:
    """Each file's first line and layout ``(file, header, width)``, and the distinct layouts with their positions."""
    numbered_lines = lines.filter("start = 0").withColumn("n", F.monotonically_increasing_id())
    heads = numbered_lines.groupBy("file").agg(F.min_by("value", "n").alias("first"))
    lead = F.trim(F.substring_index("first", ",", 1), F.lit(' "\r'))
    named = {"auto": ~F.coalesce(lead.rlike(S.NUMBER), F.lit(False)), "true": F.lit(True), "false": F.lit(False)}[config.header]
    # commas between quotes part no fields
    width = F.regexp_count(F.regexp_replace("first", '"(?:[^"]|"")*"', ""), F.lit(",")) + 1
    each = heads.select("file", F.when(named, F.col("first")).alias("header"), F.when(~named, F.when(width >= 7, 7).otherwise(6)).alias("width"))
    kinds = [r.asDict() for r in each.select("header", "width").distinct().limit(MOST_LAYOUTS + 1).collect()]
    if len(kinds) > MOST_LAYOUTS:
        raise ValueError(f"more than {MOST_LAYOUTS} different headers: not a folder of trade dumps")
    for k in kinds:
        k["positions"] = column_positions(k["header"], k["width"] or 0, layout_of(k["header"], config.layout))
    return each, kinds


def parse_files(spark: SparkSession, path: str, config: FeedConfig) -> DataFrame:
    """All rows of the files but their headers as raw trades, unreadable ones included."""
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = spark.read.text(path).select("value", *meta)
    each, kinds = _layouts(lines, config)
    symbol = S.symbol_of_path(F.col("file"), list(config.symbols))
    if not kinds:
        return parse_lines(lines, "value", POSITIONS["trades7"], symbol, config.exchange)
    columns = list(ALIASES)
    width = 1 + max(max(k["positions"].values()) for k in kinds)
    if len(kinds) == 1:  # nothing to join
        header, positions = kinds[0]["header"], kinds[0]["positions"]
        rows = lines if header is None else lines.filter(F.col("value") != header)
        return parse_lines(rows, "value", positions, symbol, config.exchange, width, header is None)
    table = spark.createDataFrame(
        [(k["header"], k["width"], *(k["positions"].get(c) for c in columns)) for k in kinds],
        "_header string, _width int, " + ", ".join(f"_{c} int" for c in columns),
    )
    same = F.col("header").eqNullSafe(F.col("_header")) & F.col("width").eqNullSafe(F.col("_width"))
    # written, so that its size is known: Spark sends it to all tasks if it is small, else a file of very many lines is split
    of_file = stored(each.join(F.broadcast(table), same).drop("header", "width"), "layouts")  # at most MOST_LAYOUTS rows
    rows = lines.join(of_file, "file").filter(~F.col("value").eqNullSafe(F.col("_header")))
    return parse_lines(rows, "value", {c: F.col(f"_{c}") for c in columns}, symbol, config.exchange, width, F.col("_header").isNull())


def read_csv_trades(spark: SparkSession, path: str, config: FeedConfig | None = None) -> DataFrame:
    """Raw trades of a dump's files; each file's layout comes from its first line, its symbol from its name.

    ``start_row``, ``max_rows`` and ``passes`` replay a part of it by (time, id);
    they number readable rows.
    """
    config = config or FeedConfig()
    raw = readable(parse_files(spark, path, config))
    if config.start_row or config.max_rows or config.passes > 1:
        order = ["trade_time_ms", "trade_id"]
        raw = replay(numbered(raw, order, "number"), "number", config.start_row, config.max_rows, config.passes).drop("number", "pass")
    return raw
