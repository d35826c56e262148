"""Schemas of the canonical frames. Readers declare them; nothing is inferred."""

from __future__ import annotations

TRADES = "symbol STRING, seq BIGINT, ts DOUBLE, side STRING, price DOUBLE, qty DOUBLE, qty_text STRING, quote_qty DOUBLE"
BOOK = "symbol STRING, seq BIGINT, ts DOUBLE, bid DOUBLE, bid_qty DOUBLE, ask DOUBLE, ask_qty DOUBLE"
DEPTH = "symbol STRING, seq BIGINT, ts DOUBLE, first_id BIGINT, final_id BIGINT, bids ARRAY<STRUCT<price: DOUBLE, qty: DOUBLE>>, asks ARRAY<STRUCT<price: DOUBLE, qty: DOUBLE>>"
CANDLES = "symbol STRING, open_time BIGINT, close_time BIGINT, quote_volume DOUBLE, trade_count BIGINT, is_closed BOOLEAN"
RAW_TRADES = "symbol STRING, seq BIGINT, T BIGINT, p STRING, q STRING, m BOOLEAN"
ITEMS = (
    "pos BIGINT, id STRING, topic STRING, source STRING, author STRING, text STRING, url STRING, external_url STRING, "
    "score DOUBLE, community STRING, captured_at BIGINT, created_ts BIGINT"
)
