"""The column helpers as functions of SQL: temporary functions whose bodies are the helpers' own expressions.

A query in SQL text gets what DataFrame code gets, inlined by the optimizer:
no UDF, no Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from flowgauge.functions import scalars as S

#: Names, parameters and the helpers that take them in this order.
FUNCTIONS: dict[str, tuple[dict[str, str], Callable[..., Column]]] = {
    "normalize_symbol": ({"symbol": "string"}, S.normalize_symbol),
    "upper_symbol": ({"symbol": "string"}, S.upper_symbol),
    "normalize_exchange": ({"exchange": "string"}, S.normalize_exchange),
    "side_of_maker": ({"is_buyer_maker": "boolean"}, S.side_of_maker),
    "is_finite": ({"x": "double"}, S.is_finite),
    "signed_ofi": ({"side": "string", "quantity": "double", "price": "double"}, S.signed_ofi),
    "parse_number": ({"number": "string"}, S.parse_number),
    "parse_time_ms": ({"time": "string"}, S.parse_time_ms),
    "parse_flag": ({"flag": "string"}, S.parse_flag),
    "quote_quantity": ({"given": "double", "price": "double", "quantity": "double"}, S.quote_quantity),
    "partition_key": ({"exchange": "string", "symbol": "string"}, S.partition_key),
    "routing_key": ({"exchange": "string", "symbol": "string", "key": "string"}, S.routing_key),
    "lag_ms": ({"ingested_ms": "bigint", "traded_ms": "bigint"}, S.lag_ms),
    "uuid5_dns": ({"name": "string"}, S.uuid5_dns),
    "notification": ({"side": "string", "z": "double", "price": "double"}, S.notification),
    "looks_like_symbol": ({"token": "string"}, S.looks_like_symbol),
    "round_alert": ({"x": "double"}, lambda x: S.round_half_even(x, 8)),
    "round_z": ({"z": "double"}, lambda z: S.round_half_even(z, 6)),
    "alert_time": ({"stated": "string", "alerted_at_ms": "bigint"}, S.alert_time),
}


def sql_text(spark: SparkSession, parameters: dict[str, str], helper: Callable[..., Column]) -> str:
    """The SQL text of a helper's expression over its parameters."""
    row = spark.sql("select " + ", ".join(f"cast(null as {t}) as {n}" for n, t in parameters.items()))
    made = row.select(helper(*map(F.col, parameters)).alias("made"))
    return made._jdf.queryExecution().analyzed().expressions().head().child().sql()


def register_functions(spark: SparkSession, prefix: str = "flow_") -> list[str]:
    """Creates the functions in the session; their names."""
    for name, (parameters, helper) in FUNCTIONS.items():
        said = ", ".join(f"{n} {t}" for n, t in parameters.items())
        spark.sql(f"create or replace temporary function {prefix}{name}({said}) return {sql_text(spark, parameters, helper)}")
    return [prefix + name for name in FUNCTIONS]
