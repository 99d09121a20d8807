"""Table schemas."""

from __future__ import annotations

RAW_TRADE = (
    "exchange string, symbol string, source string, trade_id long, price string, quantity string, "
    "quote_quantity string, is_buyer_maker boolean, trade_time_ms long, event_time_ms long, payload string"
)
TRADE = (
    "event_id string, schema_version string, source string, exchange string, symbol string, trade_id long, "
    "price double, quantity double, size double, quote_quantity double, side string, is_buyer_maker boolean, "
    "trade_time_ms long, timestamp long, event_time_ms long, ingested_at_ms long, sequence long, ingestion_host string"
)
SCORE = (
    "symbol string, trade_id long, z_score double, ewma double, ewma_var double, trade_count long, signed_ofi double, "
    "side string, quantity double, price double, trade_time_ms long"
)
SCORER_STATE = "symbol string, ewma double, ewma_var double, trade_count long"
DLQ = (
    "failed_at_ms long, reason string, detail string, exchange string, symbol string, trade_id long, raw_payload string, "
    "host string"
)
SYMBOL_CONFIG = "symbol string, z_threshold double, ewma_alpha double, min_trades int"
AUDIT = "id long, event_type string, actor string, symbol string, event_id string, details string, created_at_ms long"

#: The version stamped on each trade, and the seeded configuration of symbols.
SCHEMA_VERSION = "1.0.0"
SEED_CONFIGS = [("BTCUSDT", 3.0, 0.1, 10), ("ETHUSDT", 3.0, 0.1, 10), ("DOGEUSDT", 2.5, 0.1, 10)]
