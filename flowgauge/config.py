"""Settings of the pipeline, with their defaults; bad values raise at once."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class ScorerConfig:
    """EWMA scoring: smoothing, floor of the variance, warm-up and thresholds by symbol."""

    alpha: float = 0.1
    epsilon: float = 1e-12
    min_trades: int = 10
    threshold: float = 3.0
    thresholds: Mapping[str, float] = field(default_factory=lambda: {"BTCUSDT": 3.0, "ETHUSDT": 3.0, "DOGEUSDT": 2.5})

    def __post_init__(self) -> None:
        if not 0 < self.alpha <= 1:
            raise ValueError("alpha must lie in (0, 1]")
        if self.threshold <= 0 or any(t <= 0 for t in self.thresholds.values()):
            raise ValueError("thresholds must be positive")
        if self.min_trades < 0:
            raise ValueError("min_trades must not be negative")

    def with_overrides(self, env: Mapping[str, str]) -> ScorerConfig:
        """Thresholds from settings SCORER_THRESHOLD_<SYMBOL> over these."""
        prefix = "SCORER_THRESHOLD_"
        more = {k.removeprefix(prefix).upper(): float(v) for k, v in env.items() if k.startswith(prefix)}
        return ScorerConfig(self.alpha, self.epsilon, self.min_trades, self.threshold, {**self.thresholds, **more})


@dataclass(frozen=True)
class NormalizeConfig:
    """Rejection limits; 0 disables one. Times are milliseconds."""

    compute_quote_quantity: bool = True
    max_price: float = 0.0
    max_quantity: float = 0.0
    max_age_ms: int = 0
    schema_version: str = "1.0.0"
    host: str = ""


@dataclass(frozen=True)
class FeedConfig:
    """Replay of trade files."""

    mode: str = "csv"
    exchange: str = "binance"
    symbols: tuple[str, ...] = ("BTCUSDT",)
    layout: str = "auto"
    header: str = "auto"
    start_row: int = 0
    max_rows: int = 0
    passes: int = 1
    speed: float = 1.0

    def __post_init__(self) -> None:
        if self.mode not in ("live", "csv", "replay"):
            raise ValueError(f"unknown feed mode {self.mode!r}")
        if self.layout.lower() not in ("auto", "trades", "aggtrades"):
            raise ValueError(f"unknown layout {self.layout!r}")
        if self.header not in ("auto", "true", "false"):
            raise ValueError(f"unknown header setting {self.header!r}")
        if self.start_row < 0 or self.max_rows < 0 or self.passes < 1 or self.speed < 0:
            raise ValueError("start_row, max_rows and speed must not be negative, passes at least 1")


@dataclass(frozen=True)
class DedupConfig:
    """Suppression of repeats; keys live in the state store, which bounds memory by itself."""

    enabled: bool = True
    ttl_ms: int = 600_000


@dataclass(frozen=True)
class SinkConfig:
    """Where trades go, and how often a failed batch is written again."""

    kind: str = "stdout"
    max_retries: int = 5
    retry_base_ms: int = 100
    retry_max_ms: int = 5_000
    brokers: str = "localhost:9092"
    topic: str = "trades.normalized"
    dlq_topic: str = "trades.normalized.dlq"
    alerts_topic: str = "trades.alerts"
    compression: str = "snappy"
    acks: str = "all"
    tls: bool = False
    sasl_mechanism: str = ""
    sasl_user: str = ""
    sasl_password: str = ""

    def __post_init__(self) -> None:
        if self.kind not in ("kafka", "rabbitmq", "stdout", "discard", "files"):
            raise ValueError(f"unknown sink {self.kind!r}")
        if self.max_retries < 0 or self.retry_base_ms < 0 or self.retry_max_ms < self.retry_base_ms:
            raise ValueError("retries must not be negative, retry_max_ms not below retry_base_ms")


#: Names of the settings.
NAMES = {
    FeedConfig: {
        "FEED_MODE": "mode", "EXCHANGE": "exchange", "FEED_SYMBOLS": "symbols", "CSV_FORMAT": "layout", "CSV_HAS_HEADER": "header",
        "CSV_START_ROW": "start_row", "CSV_MAX_ROWS": "max_rows", "CSV_SPEED": "speed",
    },
    DedupConfig: {"DEDUP_ENABLED": "enabled", "DEDUP_TTL": "ttl_ms"},
    NormalizeConfig: {
        "SCHEMA_VERSION": "schema_version", "NORMALIZE_COMPUTE_QUOTE_QTY": "compute_quote_quantity", "NORMALIZE_MAX_PRICE": "max_price",
        "NORMALIZE_MAX_QUANTITY": "max_quantity", "NORMALIZE_MAX_AGE": "max_age_ms",
    },
    SinkConfig: {
        "BROKER": "kind", "PRODUCER_MAX_RETRIES": "max_retries", "PRODUCER_RETRY_BASE": "retry_base_ms", "PRODUCER_RETRY_MAX": "retry_max_ms",
        "KAFKA_BROKERS": "brokers", "KAFKA_TOPIC": "topic", "KAFKA_DLQ_TOPIC": "dlq_topic", "KAFKA_ALERTS_TOPIC": "alerts_topic",
        "KAFKA_COMPRESSION": "compression", "KAFKA_REQUIRED_ACKS": "acks", "KAFKA_TLS_ENABLED": "tls", "KAFKA_SASL_MECHANISM": "sasl_mechanism",
        "KAFKA_SASL_USER": "sasl_user", "KAFKA_SASL_PASSWORD": "sasl_password",
    },
    ScorerConfig: {
        "SCORER_EWMA_ALPHA": "alpha", "SCORER_MIN_TRADES": "min_trades", "SCORER_VARIANCE_EPSILON": "epsilon",
        "SCORER_DEFAULT_THRESHOLD": "threshold",
    },
}
UNITS_MS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000}


def _value(text: str, default: object, name: str) -> object:
    text = text.strip()
    if isinstance(default, bool):
        if text.lower() not in ("1", "t", "true", "yes", "0", "f", "false", "no"):
            raise ValueError(f"{name}: {text!r} is not true or false")
        return text.lower() in ("1", "t", "true", "yes")
    if name.endswith("_ms") and not text.isdigit():
        parts = re.fullmatch(r"(?:\d+(?:\.\d+)?(?:ms|[smh]))+", text)
        if not parts:
            raise ValueError(f"{name}: {text!r} is not a duration")
        return int(sum(float(n) * UNITS_MS[u] for n, u in re.findall(r"(\d+(?:\.\d+)?)(ms|[smh])", text)))
    if isinstance(default, tuple):
        return tuple(dict.fromkeys(x.strip().upper() for x in text.split(",") if x.strip()))
    return type(default)(text)


def load_config(kind: type, env: Mapping[str, str]):
    """A config of ``kind`` from named settings; blank ones keep the default, and all bad ones are reported together."""
    values, bad = {}, []
    defaults = kind()
    for name, place in NAMES[kind].items():
        if env.get(name, "").strip():
            try:
                values[place] = _value(env[name], getattr(defaults, place), place)
            except ValueError as e:
                bad.append(f"{name} ({e})")
    if bad:
        raise ValueError("bad settings: " + "; ".join(bad))
    made = kind(**values)
    return made.with_overrides(env) if isinstance(made, ScorerConfig) else made


SECRETS = ("password", "secret", "token")


def read_env_file(text: str) -> dict[str, str]:
    """NAME=value lines: comments, blank lines and an ``export`` before the name are allowed, quotes are stripped."""
    out = {}
    for number, line in enumerate(text.splitlines(), 1):
        line = line.strip().removeprefix("export ").strip()
        if not line or line.startswith("#"):
            continue
        name, sep, value = line.partition("=")
        if not sep or not name.strip():
            raise ValueError(f"line {number} is not NAME=value")
        value = value.strip()
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "'\"":
            value = value[1:-1]
        out[name.strip()] = value
    return out


def redacted(config: object) -> dict[str, object]:
    """The settings of a config, with secrets hidden."""
    return {k: "***" if v and any(s in k.lower() for s in SECRETS) else v for k, v in asdict(config).items()}
