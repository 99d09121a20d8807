"""Option maps for Kafka, and the factory of feeds. The connectors are the cluster's; none is bundled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.config import FeedConfig
from flowgauge.functions import scalars as S
from flowgauge.sources.csv_trades import read_csv_trades
from flowgauge.sources.frames import decode_frames
from flowgauge.sources.replay import replay_stream

ACKS = {"none": "0", "one": "1", "all": "all"}
CODECS = ("none", "gzip", "snappy", "lz4", "zstd")


def kafka_source_options(servers: str, topic: str, starting: str = "earliest", most_offsets: int | None = None) -> dict[str, str]:
    """Options of ``readStream.format("kafka")``; ``most_offsets`` a trigger is the backpressure."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting, "failOnDataLoss": "true"}
    return options | ({"maxOffsetsPerTrigger": str(most_offsets)} if most_offsets else {})


def kafka_sink_options(
    servers: str, topic: str, acks: str = "all", compression: str = "snappy", sasl: str | None = None, user: str = "", password: str = "", tls: bool = False
) -> dict[str, str]:
    """Options of ``writeStream.format("kafka")``. ``sasl``: PLAIN, SCRAM-SHA-256 or SCRAM-SHA-512."""
    if acks not in ACKS or compression not in CODECS:
        raise ValueError("unknown acks or compression")
    options = {
        "kafka.bootstrap.servers": servers,
        "topic": topic,
        "includeHeaders": "true",
        "kafka.acks": ACKS[acks],
        "kafka.compression.type": compression,
    }
    if sasl:
        module = "plain.PlainLoginModule" if sasl == "PLAIN" else "scram.ScramLoginModule"
        options["kafka.sasl.mechanism"] = sasl
        options["kafka.sasl.jaas.config"] = f'org.apache.kafka.common.security.{module} required username="{user}" password="{password}";'
    protocol = ("SASL_" if sasl else "") + ("SSL" if tls else "PLAINTEXT")
    return options | {"kafka.security.protocol": protocol} | ({"kafka.ssl.enabled.protocols": "TLSv1.2,TLSv1.3"} if tls else {})


def kafka_rows(trades: DataFrame) -> DataFrame:
    """Trades (schema TRADE) as rows of a Kafka sink: ``key``, ``value`` in JSON, ``headers`` sorted by name."""
    sent = F.transform(S.sorted_headers(S.trade_headers()), lambda h: F.struct(h["key"].alias("key"), h["value"].cast("binary").alias("value")))
    return trades.select(
        S.partition_key(F.col("exchange"), F.col("symbol")).alias("key"), F.to_json(F.struct("*")).alias("value"), sent.alias("headers")
    )


def open_feed(spark: SparkSession, config: FeedConfig, path: str = "", progress: str = "") -> DataFrame:
    """The feed that ``config.mode`` names: a CSV dump, a replay of recorded trades (a stream), or a live topic of frames."""
    if config.mode == "csv":
        return read_csv_trades(spark, path, config)
    if config.mode == "replay":
        return replay_stream(spark, path, progress)
    live = spark.readStream.format("kafka").options(**kafka_source_options(path, "trades.raw", "latest")).load()
    return decode_frames(live.select(F.col("value").cast("string").alias("value")))
