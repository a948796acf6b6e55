"""Fixed schemas of events, alerts and labels. Times are nanoseconds in a BIGINT: TIMESTAMP would lose three digits."""

TICK = "ts_ns bigint, symbol string, price double"
EVENT_STREAM = "symbol string, ts_ns bigint, seq bigint, etype string, price double, size double, bid double, ask double, bid_size double, ask_size double"
ALERT = "symbol string, ts_ns bigint, seq bigint, ord int, kind string, price double, score double, details string"
ALERT_ROW = "ts_ns bigint, symbol string, kind string, price double, score double"
CATALOG = "ts_ns bigint, symbol string, event_type string, description string, polarity string, duration_sec double"
