"""Alerts: building, history queries, pages and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.functions import scalars as S

#: Columns of the export and their headings.
EXPORT = {
    "id": "ID", "event_id": "Event ID", "symbol": "Symbol", "exchange": "Exchange", "z_score": "Z-Score", "ewma": "EWMA",
    "signed_ofi": "Signed OFI", "side": "Side", "quantity": "Quantity", "price": "Price", "alerted_at": "Alerted At",
}


def build_alerts(scored: DataFrame, alerted_at_ms: Column) -> DataFrame:
    """Toxic scores as alerts, rounded as they are published (z to 6 places, states to 8; ties to even)."""
    rounded = {c: S.round_half_even(F.col(c), 8) for c in ("ewma", "ewma_var", "signed_ofi")} | {"z_score": S.round_half_even(F.col("z_score"), 6)}
    return scored.filter("is_toxic").withColumns(rounded | {"alert_type": F.lit("toxicity"), "alerted_at_ms": alerted_at_ms})


def alert_json(alerts: DataFrame) -> DataFrame:
    """Key (the symbol) and JSON value of each alert."""
    return alerts.select(F.col("symbol").alias("key"), F.to_json(F.struct("*")).alias("value"))


def toxicity_only(alerts: DataFrame) -> DataFrame:
    """Alerts of the type that readers are told of; other and missing types are passed over."""
    return alerts.filter("alert_type = 'toxicity'")


def display(alerts: DataFrame) -> DataFrame:
    """Alerts as a reader sees them: z to 2 places, flow and quantity to 6, and the best time there is."""
    fixed = lambda c, places: F.coalesce(F.format_string(f"%.{places}f", F.col(c)), F.lit(""))
    at = F.coalesce(F.col("alerted_at"), F.timestamp_millis("trade_time_ms"))
    return alerts.select(
        "symbol",
        "side",
        fixed("z_score", 2).alias("z_score"),
        fixed("signed_ofi", 6).alias("signed_ofi"),
        fixed("quantity", 6).alias("quantity"),
        F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("time"),
    )


def alert_history(
    alerts: DataFrame,
    symbol: str | None = None,
    from_time: str | None = None,
    to_time: str | None = None,
    min_z: float | None = None,
    max_z: float | None = None,
) -> DataFrame:
    """Alerts by symbol, time and absolute z-score, any of them; all bounds are inclusive."""
    if symbol and symbol.strip():
        alerts = alerts.filter(F.col("symbol") == symbol.strip().upper())
    for bound, test in ((from_time, F.col("alerted_at").__ge__), (to_time, F.col("alerted_at").__le__)):
        if bound is not None:
            alerts = alerts.filter(test(F.lit(bound).cast("timestamp")))
    for bound, test in ((min_z, F.abs("z_score").__ge__), (max_z, F.abs("z_score").__le__)):
        if bound is not None:
            alerts = alerts.filter(test(F.lit(float(bound))))
    return alerts


def page(rows: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """``limit`` rows (1 to 500) after ``offset`` by ``order``."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must lie in 1..500 and offset must not be negative")
    return rows.orderBy(*order).offset(offset).limit(limit)


def newest_first() -> list[Column]:
    """Newest alerts first; later ids break ties."""
    return [F.desc("alerted_at"), F.desc("id")]


def export_alerts(alerts: DataFrame, symbol: str | None = None, limit: int = 5000) -> DataFrame:
    """The newest alerts (of a symbol) with headings for a reader, ready for ``write.csv(header=True)``; the limit is part of the export."""
    if symbol:
        alerts = alerts.filter(F.col("symbol") == symbol.upper())
    iso = F.date_format("alerted_at", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    top = alerts.orderBy(*newest_first()).limit(limit).withColumn("alerted_at", iso)
    return top.select(*[F.col(c).alias(h) for c, h in EXPORT.items()])
