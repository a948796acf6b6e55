"""SQL for DuckDB that gives what the queries give, over the same tables."""

from __future__ import annotations

VIEWS = """
ticks AS (SELECT event_type AS symbol, epoch_us(ts) * 1000 AS ts_ns, event_id AS seq, value AS price, (1 + user_id % 50)::DOUBLE AS size FROM events WHERE value > 0),
quotes AS (SELECT symbol, ts_ns, seq,
  CASE WHEN seq % 97 = 0 THEN price + price * (1 + seq % 7) / 10000 ELSE price - price * (1 + seq % 7) / 10000 END AS bid,
  CASE WHEN seq % 97 = 0 THEN price - price * (1 + seq % 7) / 10000 ELSE price + price * (1 + seq % 7) / 10000 END AS ask,
  (1 + (seq * 7919) % 100)::DOUBLE AS bid_size, (1 + (seq * 104729) % 100)::DOUBLE AS ask_size FROM ticks),
alerts AS (SELECT ts_ns, symbol, seq, CASE WHEN (price - 50) / 10 >= 8 THEN 'burst' WHEN price > 50 THEN 'robust_z' ELSE 'cusum' END AS kind, price, (price - 50) / 10 AS score
  FROM ticks WHERE price BETWEEN 1 AND 20 OR (price >= 80 AND price < 200)),
catalog AS (SELECT seq AS event_no, ts_ns, symbol, CASE WHEN price < 1 THEN 'calm' WHEN price >= 250 THEN 'outage' WHEN price >= 220 THEN 'halt' ELSE 'news' END AS event_type,
  CASE WHEN price < 1 THEN 'quiet' ELSE 'positive' END AS polarity, CASE WHEN price < 1 THEN 7200.0::DOUBLE ELSE 0.0::DOUBLE END AS duration_sec FROM ticks WHERE price < 1 OR price >= 200),
pairs AS (SELECT c.event_no, c.polarity, c.event_type, c.ts_ns AS event_ts, a.ts_ns, a.seq, a.symbol, a.kind FROM catalog c JOIN alerts a ON a.symbol = c.symbol
  AND a.ts_ns BETWEEN CASE WHEN c.duration_sec > 0 THEN c.ts_ns ELSE c.ts_ns - 1800000000000 END AND CASE WHEN c.duration_sec > 0 THEN c.ts_ns + (c.duration_sec * 1000000000)::BIGINT ELSE c.ts_ns + 1800000000000 END),
prices AS (SELECT l_shipdate::DATE AS d, (l_suppkey % 8)::INTEGER AS asset, avg(l_extendedprice) AS px FROM lineitem GROUP BY ALL),
wide AS (SELECT d, {pivot} FROM prices GROUP BY d),
filled AS (SELECT d, {fill} FROM wide WINDOW w AS (ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
complete AS (SELECT * FROM filled WHERE {whole}),
returns AS (SELECT * FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS t, {ret} FROM complete) WHERE t > 0),
long_returns AS ({long})
""".format(
    pivot=", ".join(f"max(px) FILTER (asset = {k}) AS p{k}" for k in range(8)),
    fill=", ".join(f"last_value(p{k} IGNORE NULLS) OVER w AS p{k}" for k in range(8)),
    whole=" AND ".join(f"p{k} IS NOT NULL" for k in range(8)),
    ret=", ".join(f"ln(p{k} / lag(p{k}) OVER (ORDER BY d)) AS r{k}" for k in range(8)),
    long=" UNION ALL ".join(f"SELECT t, {k} AS asset, r{k} AS ret FROM returns" for k in range(8)),
)
MID = "CASE WHEN ask > 0 THEN 0.5 * (bid + ask) ELSE 0 END"
SPREAD = "CASE WHEN bid > 0 AND ask > 0 AND ask > bid THEN (ask - bid) / (0.5 * (ask + bid)) * 1e4 ELSE 0 END"
OBI = "CASE WHEN bid_size > 0 AND ask_size > 0 THEN (bid_size - ask_size) / (bid_size + ask_size) END"
DRIFT = "CASE WHEN bid > 0 AND ask > bid AND bid_size > 0 AND ask_size > 0 THEN ((bid * ask_size + ask * bid_size) / (bid_size + ask_size) - 0.5 * (bid + ask)) / (ask - bid) END"
SEVERITY = "CASE kind WHEN 'crossed_book' THEN 'ANOMALY' WHEN 'burst' THEN 'WARNING' WHEN 'obi_extreme' THEN 'ALERT' ELSE CASE WHEN abs(score) >= 8 THEN 'ANOMALY' WHEN abs(score) >= 5 THEN 'WARNING' WHEN abs(score) >= 3 THEN 'ALERT' ELSE 'INFO' END END"
ORDERED = "(PARTITION BY symbol ORDER BY ts_ns, seq)"


def _price_fold(h: str = "5.0", grid: str = "", source: str = "ticks") -> str:
    """The price detector step by step. grid: a further relation of values h, each with a fold of its own."""
    extra, column, on = (", h", f", {grid}", " AND f.h = n.h") if grid else ("", "", "")
    start = f"numbered AS (SELECT symbol, ts_ns, seq, price{extra}, row_number() OVER (PARTITION BY symbol{extra} ORDER BY ts_ns, seq) AS i FROM {source}{column})"
    return f"""{start},
fold AS (
  SELECT symbol, ts_ns, seq, price{extra}, i, 5 AS warm, 0::DOUBLE AS mean, 0::DOUBLE AS mad, NULL::DOUBLE AS r, NULL::DOUBLE AS z, 0::DOUBLE AS up, 0::DOUBLE AS down, 0::DOUBLE AS hit FROM numbered WHERE i = 1
  UNION ALL
  SELECT symbol, ts_ns, seq, price{extra}, i, warm, mean, mad, r, z, CASE WHEN u > {h} THEN 0 ELSE u END, CASE WHEN u <= {h} AND -w > {h} THEN 0 ELSE w END,
    CASE WHEN u > {h} THEN u WHEN -w > {h} THEN w ELSE 0 END
  FROM (SELECT *, CASE WHEN gap THEN 0 WHEN z IS NULL THEN up0 ELSE greatest(0, up0 + z - 0.5) END AS u, CASE WHEN gap THEN 0 WHEN z IS NULL THEN down0 ELSE least(0, down0 + z + 0.5) END AS w
  FROM (SELECT *, CASE WHEN gap OR warm > 0 THEN NULL WHEN mad <= 1e-12 THEN 0 ELSE (r - mean) / (1.2533141373155003 * mad) END AS z
  FROM (SELECT *, CASE WHEN gap THEN mad0 ELSE 0.98::DOUBLE * mad0 + 0.02::DOUBLE * abs(r - mean) END AS mad
  FROM (SELECT *, CASE WHEN gap THEN mean0 ELSE 0.98::DOUBLE * mean0 + 0.02::DOUBLE * r END AS mean
  FROM (SELECT n.symbol, n.ts_ns, n.seq, n.price{", n.h" if grid else ""}, n.i, n.ts_ns - f.ts_ns > 604800000000000 AS gap, ln(n.price / f.price) AS r,
    CASE WHEN n.ts_ns - f.ts_ns > 604800000000000 THEN 5 ELSE greatest(0, f.warm - 1) END AS warm, f.mean AS mean0, f.mad AS mad0, f.up AS up0, f.down AS down0
    FROM fold f JOIN numbered n ON n.symbol = f.symbol AND n.i = f.i + 1{on})))))
)"""


def _p2_fold(name: str, source: str) -> str:
    """Quartiles by five moving markers, step by step, over a relation of (symbol, ts_ns, seq, x); name_z has each value's z."""
    step = f"""SELECT symbol, p, i, least(x, h0) AS h0, h1, h2, h3, greatest(x, h4) AS h4, a1 + (cell < 1)::BIGINT AS a1, a2 + (cell < 2)::BIGINT AS a2, a3 + (cell < 3)::BIGINT AS a3
    FROM (SELECT *, CASE WHEN x < h0 THEN 0 WHEN x < h1 THEN 0 WHEN x < h2 THEN 1 WHEN x < h3 THEN 2 ELSE 3 END AS cell
    FROM (SELECT f.*  EXCLUDE (i), n.i, n.x FROM {name} f JOIN {name}_n n ON n.symbol = f.symbol AND n.i = f.i + 1))"""
    at = ["1", "a1", "a2", "a3", "i"]
    for m, share in ((1, "p / 2"), (2, "p"), (3, "(1 + p) / 2")):
        low, here, high = f"h{m - 1}", f"h{m}", f"h{m + 1}"
        moved = f"{here} + st / (rgt + lft) * ((lft + st) * (({high} - {here}) / rgt) + (rgt - st) * (({here} - {low}) / lft))"
        step = f"""SELECT * EXCLUDE (lag, rgt, lft, st, moved) REPLACE (a{m} + st AS a{m},
      CASE WHEN st = 0 THEN {here} WHEN {low} < moved AND moved < {high} THEN moved WHEN st > 0 THEN {here} + ({high} - {here}) / rgt ELSE {here} + ({here} - {low}) / lft END AS {here})
    FROM (SELECT *, {moved} AS moved FROM (SELECT *, CASE WHEN lag >= 1 AND rgt > 1 THEN 1 WHEN lag <= -1 AND lft > 1 THEN -1 ELSE 0 END AS st
    FROM (SELECT *, 1 + (i - 1) * ({share}) - a{m} AS lag, {at[m + 1]} - a{m} AS rgt, a{m} - {at[m - 1]} AS lft FROM ({step}))))"""
    return f"""{name}_n AS (SELECT *, row_number() OVER {ORDERED} AS i FROM ({source})),
{name}_five AS (SELECT symbol, p, list_sort(list(x)) AS h FROM {name}_n, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) AS v(p) WHERE i <= 5 GROUP BY symbol, p HAVING count(*) = 5),
{name} AS (
  SELECT symbol, p, 5::BIGINT AS i, h[1] AS h0, h[2] AS h1, h[3] AS h2, h[4] AS h3, h[5] AS h4, 2::BIGINT AS a1, 3::BIGINT AS a2, 4::BIGINT AS a3 FROM {name}_five
  UNION ALL SELECT symbol, p, i, h0, h1, h2, h3, h4, a1, a2, a3 FROM ({step})
),
{name}_z AS (SELECT symbol, ts_ns, seq, x, i, CASE WHEN high - low > 1e-12 THEN (x - middle) * 1.34898 / (high - low) ELSE 0 END AS z FROM {name}_n JOIN
  (SELECT symbol, i, max(h2) FILTER (p = 0.25) AS low, max(h2) FILTER (p = 0.5) AS middle, max(h2) FILTER (p = 0.75) AS high FROM {name} GROUP BY symbol, i) USING (symbol, i))"""


def _cooled(name: str, source: str, seconds: float) -> str:
    """Rows of a relation of (symbol, ts_ns, seq, score) that come after the last kept one has cooled down."""
    ns = int(seconds * 1e9)
    return f"""{name}_n AS (SELECT *, row_number() OVER {ORDERED} AS i FROM ({source})),
{name}_f AS (SELECT symbol, ts_ns, seq, score, i, true AS fired, ts_ns + {ns} AS until FROM {name}_n WHERE i = 1
  UNION ALL SELECT n.symbol, n.ts_ns, n.seq, n.score, n.i, n.ts_ns > f.until, CASE WHEN n.ts_ns > f.until THEN n.ts_ns + {ns} ELSE f.until END FROM {name}_f f JOIN {name}_n n ON n.symbol = f.symbol AND n.i = f.i + 1),
{name} AS (SELECT symbol, ts_ns, seq, score FROM {name}_f WHERE fired)"""


def _regimes(ks: float, cooldown: float) -> str:
    """Shifts of scored returns: the last 50 against the last 100 of every fifth, looked at from the 500th on, every 50."""
    return f"""sc AS (SELECT symbol, ts_ns, seq, r, row_number() OVER {ORDERED} AS k FROM fold WHERE z IS NOT NULL),
checks AS (SELECT * FROM sc WHERE k >= 500 AND (k - 500) % 50 = 0),
both_sides AS (SELECT c.symbol, c.k, s.r AS v, true AS short FROM checks c JOIN sc s ON s.symbol = c.symbol AND s.k <= c.k AND s.k > c.k - 50
  UNION ALL SELECT c.symbol, c.k, s.r, false FROM checks c JOIN sc s ON s.symbol = c.symbol AND s.k <= c.k AND s.k % 5 = 0 AND s.k > (c.k // 5 - 100) * 5),
shifts AS (SELECT symbol, k, max(abs(a / 50 - b / 100)) AS score FROM (SELECT symbol, k, count(*) FILTER (short) OVER o AS a, count(*) FILTER (NOT short) OVER o AS b
  FROM both_sides WINDOW o AS (PARTITION BY symbol, k ORDER BY v)) GROUP BY symbol, k HAVING max(abs(a / 50 - b / 100)) > {ks}),
{_cooled("regimes", "SELECT symbol, ts_ns, seq, score FROM shifts JOIN checks USING (symbol, k)", cooldown)}"""


def _bursts(source: str, window: float, k: float, cooldown: float) -> str:
    """Bursts among the alerts of a relation of (symbol, ts_ns, seq): counts in the window by event, and their slow mean."""
    w, c = int(window * 1e9), int(cooldown * 1e9)
    return f"""b_events AS (SELECT symbol, ts_ns, seq, count(*) AS m FROM ({source}) GROUP BY ALL),
b_n AS (SELECT symbol, ts_ns, seq, row_number() OVER {ORDERED} AS i, sum(m) OVER (PARTITION BY symbol ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING)
  - coalesce(sum(m) OVER (PARTITION BY symbol ORDER BY ts_ns RANGE BETWEEN UNBOUNDED PRECEDING AND {w + 1} PRECEDING), 0) AS n FROM b_events),
b_fold AS (SELECT symbol, ts_ns, seq, i, n::DOUBLE AS n, 0.001::DOUBLE * n AS usual, n > {k} * greatest(0.001::DOUBLE * n, 1) AS fired, CASE WHEN n > {k} * greatest(0.001::DOUBLE * n, 1) THEN ts_ns + {c} ELSE 0 END AS until FROM b_n WHERE i = 1
  UNION ALL SELECT symbol, ts_ns, seq, i, n, usual, fired, CASE WHEN fired THEN ts_ns + {c} ELSE until END FROM (
    SELECT *, n > {k} * greatest(usual, 1) AND ts_ns > until AS fired FROM (
    SELECT b.symbol, b.ts_ns, b.seq, b.i, b.n::DOUBLE AS n, 0.999::DOUBLE * f.usual + 0.001::DOUBLE * b.n AS usual, f.until FROM b_fold f JOIN b_n b ON b.symbol = f.symbol AND b.i = f.i + 1))),
bursts AS (SELECT symbol, ts_ns, seq, n / greatest(usual, 1) AS score FROM b_fold WHERE fired)"""


def _ewma_fold(source: str, name: str = "scored") -> str:
    """EWMA of x over a relation of (symbol, ts_ns, seq, x), from the first value on."""
    return f"""{name}_n AS (SELECT *, row_number() OVER {ORDERED} AS i FROM ({source})),
{name}_f AS (
  SELECT symbol, ts_ns, seq, i, x, x AS mean, 0::DOUBLE AS mad FROM {name}_n WHERE i = 1
  UNION ALL
  SELECT symbol, ts_ns, seq, i, x, mean, 0.98::DOUBLE * mad0 + 0.02::DOUBLE * abs(x - mean) FROM (SELECT n.symbol, n.ts_ns, n.seq, n.i, n.x, 0.98::DOUBLE * f.mean + 0.02::DOUBLE * n.x AS mean, f.mad AS mad0 FROM {name}_f f JOIN {name}_n n ON n.symbol = f.symbol AND n.i = f.i + 1)
),
{name} AS (SELECT symbol, ts_ns, seq, CASE WHEN mad > 1e-12 THEN (x - mean) / (1.2533141373155003 * mad) ELSE 0 END AS z FROM {name}_f)"""


def _sql(body: str, more: str = "") -> str:
    return f"WITH RECURSIVE {VIEWS.strip()}{', ' + more if more else ''} {body}"


LATCH = f"SELECT * FROM (SELECT *, last_value(CASE WHEN abs(obi) > 0.9 THEN 1 WHEN abs(obi) < 0.5 THEN 0 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT *, {OBI} AS obi FROM quotes)) WHERE abs(obi) > 0.9 AND coalesce(before, 0) = 0"
WIDTHS = "SELECT symbol, ts_ns, seq, (ask - bid) / (0.5 * (bid + ask)) * 1e4 AS x FROM quotes WHERE ask > bid AND bid > 0"
RATES = f"SELECT symbol, ts_ns, seq, 20 / ((ts_ns - before) / 1e9) AS x FROM (SELECT *, lag(ts_ns, 19) OVER {ORDERED} AS before FROM quotes) WHERE ts_ns > before"
_ROLLED = lambda name: f"(SELECT t, (s - avg(s) OVER ()) / greatest(stddev_samp(s) OVER (), 1e-12) AS z FROM (SELECT t, sum({name}) OVER (ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS s FROM returns) WHERE t >= 5)"
#: Days with two scores and a volatility, and the first three quiet windows among them.
GATE = f"""days AS (SELECT t, a.z AS z0, b.z AS z1, vol FROM {_ROLLED("r0")} a JOIN {_ROLLED("r1")} b USING (t)
  JOIN (SELECT t, CASE WHEN count(r2) OVER w = 20 THEN stddev_samp(r2) OVER w END AS vol FROM returns WINDOW w AS (ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) USING (t)),
fits AS (SELECT t FROM (SELECT t, count(*) OVER w AS n, max(abs(z0)) OVER w AS most, quantile_cont(vol, 0.5) OVER w AS here FROM days WINDOW w AS (ORDER BY t ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING))
  WHERE n = 30 AND most < 2.5 AND here < (SELECT quantile_cont(vol, 0.5) FROM days)),
one AS (SELECT min(t) AS s1 FROM fits), two AS (SELECT s1, (SELECT min(t) FROM fits WHERE t >= s1 + 30) AS s2 FROM one), picked AS (SELECT s1, s2, (SELECT min(t) FROM fits WHERE t >= s2 + 30) AS s3 FROM two)"""
RUNS = GATE + """, onsets AS (SELECT concat('crisis ', onset) AS event, 'crisis' AS type, onset FROM (SELECT arg_min(t, (round(z0, 9), t)) AS onset FROM days WHERE t BETWEEN 300 AND 2099 GROUP BY (t - 300) // 600)
  UNION ALL SELECT concat('quiet ', onset), 'quiet', onset FROM (SELECT unnest([s1, s2, s3]) AS onset FROM picked) WHERE onset IS NOT NULL),
spans AS (SELECT *, greatest(1, onset - 282) AS first FROM onsets WHERE onset - 30 - greatest(1, onset - 282) >= 232),
around AS (SELECT event, type, asset, ret, CASE WHEN t < onset - 30 THEN 'ref' ELSE 'eval' END AS part, CASE WHEN t < onset - 30 THEN t - first ELSE t - onset END AS day
  FROM long_returns JOIN spans ON (t >= first AND t < onset - 30) OR (t >= onset AND t < onset + 20)),
zs AS (SELECT *, (ret - avg(ret) FILTER (part = 'ref') OVER w) / greatest(stddev_samp(ret) FILTER (part = 'ref') OVER w, 1e-12) AS z FROM around WINDOW w AS (PARTITION BY event, asset)),
binned AS (SELECT *, (z > 0)::INTEGER AS b2, (z > -1)::INTEGER + (z > 0)::INTEGER + (z > 1)::INTEGER AS b4 FROM zs),
logs AS (SELECT *, -0.5 * z * z AS gaussian, -3 * ln(1 + z * z / 5) AS t,
  ln((count(*) FILTER (part = 'ref') OVER (PARTITION BY event, asset, b2) + 1) / (count(*) FILTER (part = 'ref') OVER (PARTITION BY event, asset) + 2)) AS mps_2,
  ln((count(*) FILTER (part = 'ref') OVER (PARTITION BY event, asset, b4) + 1) / (count(*) FILTER (part = 'ref') OVER (PARTITION BY event, asset) + 4)) AS mps_4 FROM binned),
lls AS (UNPIVOT (SELECT event, type, part, day, sum(gaussian) AS gaussian, sum(t) AS t, sum(mps_2) AS mps_2, sum(mps_4) AS mps_4 FROM logs GROUP BY ALL) ON gaussian, t, mps_2, mps_4 INTO NAME method VALUE ll),
rolls AS (SELECT event, type, method, part, day - 4 AS day, s FROM (SELECT *, sum(ll) OVER w AS s, count(*) OVER w AS n FROM lls WINDOW w AS (PARTITION BY event, method, part ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE n = 5),
nulls AS (SELECT event, method, avg(s) AS m, stddev_samp(s) AS sd FROM rolls WHERE part = 'ref' GROUP BY ALL),
runs AS (SELECT event, type, method, round(min(z), 9) AS peak_z, arg_min(day, (z, day))::INTEGER AS peak_day FROM (SELECT r.*, (s - m) / sd AS z FROM rolls r JOIN nulls USING (event, method) WHERE part = 'eval') GROUP BY ALL),
best AS (SELECT event, type, arg_max(method, (abs(peak_z), method)) AS best, arg_max(peak_z, (abs(peak_z), method)) AS best_z, arg_max(peak_day, (abs(peak_z), method)) AS best_day FROM runs WHERE starts_with(method, 'mps_') GROUP BY event, type)"""

_BODIES: dict[str, str | tuple[str, str]] = {
    "scan_symbol_filter": "SELECT ts_ns, symbol, price FROM ticks WHERE symbol = 'click'",
    "unpivot_bars": "SELECT (d - DATE '1970-01-01')::BIGINT * 86400000000000 AS ts_ns, asset::VARCHAR AS symbol, round(px, 6) AS close FROM prices",
    "catalog_validate": """SELECT polarity, count(*) AS n, count(*) FILTER (polarity NOT IN ('positive', 'quiet') OR duration_sec < 0 OR ts_ns IS NULL) AS n_bad, sum(duration_sec) AS quiet_sec
      FROM (SELECT CASE WHEN event_no % 5 = 0 THEN symbol ELSE polarity END AS polarity, CASE WHEN event_no % 7 = 0 THEN -1 ELSE duration_sec END AS duration_sec, CASE WHEN event_no % 11 <> 0 THEN ts_ns END AS ts_ns FROM catalog) GROUP BY polarity""",
    "alert_export_format": "SELECT ts_ns, symbol, kind, printf('%.6f', price) AS price, printf('%.4f', score) AS score FROM alerts",
    "webhook_payload": """SELECT w, n, to_json({'source': 'driftwatch', 'feed': 'crypto', 'asset_class': 'crypto', 'alerts': a})::VARCHAR AS body FROM (
        SELECT ts_ns // 3600000000000 AS w, count(*) AS n, list({'ts_ns': ts_ns, 'symbol': symbol, 'kind': kind, 'price': round(price * 100)::BIGINT, 'score': round(score * 1000)::BIGINT} ORDER BY ts_ns, symbol, kind, price, score) AS a
        FROM alerts WHERE round(score * 1000) >= 12000 GROUP BY 1)""",
    "health_status": """SELECT user_id, CASE WHEN last = 'error' THEN 'down' WHEN last = 'signup' THEN 'reconnecting' WHEN tick IS NULL THEN CASE WHEN epoch_us(now - start) / 1e6 < 86400 THEN 'starting' ELSE 'degraded' END
        WHEN epoch_us(now - tick) / 1e6 > 30 THEN 'degraded' ELSE 'ok' END AS status
        FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last, max(ts) FILTER (value > 20) AS tick, min(ts) AS start FROM events GROUP BY user_id), (SELECT max(ts) AS now FROM events)""",
    "raw_ticks_dedup": "SELECT symbol, count(DISTINCT price) AS n_prices FROM ticks GROUP BY symbol",
    "log_return": f"SELECT symbol, seq, round(r, 9) AS log_return FROM (SELECT symbol, seq, ln(price / lag(price) OVER {ORDERED}) AS r FROM ticks) WHERE r IS NOT NULL",
    "spread_bps": f"SELECT seq, round({SPREAD}, 6) AS spread_bps, round({MID}, 6) AS mid FROM quotes",
    "obi": f"SELECT seq, round({OBI}, 9) AS obi FROM quotes",
    "microprice_drift_value": f"SELECT seq, round({DRIFT}, 6) + 0::DOUBLE AS drift FROM quotes",
    "quote_rate": f"SELECT symbol, seq, round(CASE WHEN ts_ns - before > 0 THEN 20 / ((ts_ns - before) / 1e9) ELSE 0 END, 9) AS rate FROM (SELECT *, lag(ts_ns, 19) OVER {ORDERED} AS before FROM quotes)",
    "severity": f"SELECT kind, {SEVERITY} AS severity, count(*) AS n FROM alerts GROUP BY ALL",
    "narrative": f"""SELECT seq, {SEVERITY} || ': ' || CASE kind WHEN 'robust_z' THEN 'Price deviation ' || printf('%+.2f', score) || 'σ from baseline on ' || symbol || ' (threshold ±4.0)'
        WHEN 'cusum' THEN 'Cumulative drift ' || printf('%+.2f', score) || ' on ' || symbol || ' (CUSUM threshold ±5.0)' ELSE 'Alert clustering on ' || symbol || ' - 7 alerts in 10s (3.5× baseline)' END AS narrative FROM alerts""",
    "symbol_feed_mismatch": """SELECT symbol, feed, contains(symbol, '/') <> (feed = 'crypto') AS mismatch, count(*) AS n FROM (SELECT upper(trim(' ' || c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN '/usd ' ELSE ' ' END)) AS symbol, CASE WHEN c_custkey % 2 = 0 THEN 'crypto' ELSE 'iex' END AS feed FROM customer) GROUP BY ALL""",
    "parse_rfc3339_ns": "SELECT event_id, epoch_us(ts) * 1000 + event_id % 1000 AS ts_ns FROM events",
    "event_alert_interval_join": "SELECT event_no, seq, symbol, polarity, kind FROM pairs",
    "detected_events": "SELECT event_no, polarity FROM catalog WHERE event_no IN (SELECT event_no FROM pairs)",
    "missed_events": "SELECT event_no FROM catalog WHERE polarity = 'positive' AND event_no NOT IN (SELECT event_no FROM pairs)",
    "unattributed_alerts": "SELECT seq, kind FROM alerts a WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.ts_ns = a.ts_ns AND p.symbol = a.symbol AND p.kind = a.kind)",
    "time_to_detect": "SELECT event_no, round((ts_ns - event_ts) / 1e6, 3) AS ttd_ms FROM (SELECT *, row_number() OVER (PARTITION BY event_no ORDER BY ts_ns < event_ts, abs(ts_ns - event_ts), ts_ns) AS k FROM pairs WHERE polarity = 'positive') WHERE k = 1",
    "latest_quote": f"SELECT symbol, round(bid, 6) AS bid, round(ask, 6) AS ask, bid_size, ask_size, round({MID}, 6) AS mid, round({SPREAD}, 6) AS spread_bps FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns DESC, seq DESC) AS k FROM quotes) WHERE k = 1 AND ask > bid AND bid > 0",
    "threshold_override": "SELECT symbol, count(*) AS n, max(z) AS z_thresh FROM (SELECT *, CASE symbol WHEN 'click' THEN 2.0::DOUBLE WHEN 'error' THEN 9.0::DOUBLE ELSE 4.0::DOUBLE END AS z FROM alerts) WHERE abs(score) > z GROUP BY symbol",
    "alert_counts": "SELECT coalesce(kind, '*') AS kind, coalesce(symbol, '*') AS symbol, count(*) AS n FROM alerts GROUP BY GROUPING SETS ((kind), (symbol), (kind, symbol))",
    "score_stats": "SELECT kind, round(avg(abs(score)), 6) AS mean_abs, round(max(abs(score)), 6) AS max_abs FROM alerts GROUP BY kind",
    "percentiles_linear": "SELECT symbol, " + ", ".join(f"round(quantile_cont(price, {q}), 6) AS p{k}" for k, q in enumerate((0.5, 0.95, 0.99, 0.999))) + ", round(avg(price), 6) AS mean, max(price) AS max FROM ticks GROUP BY symbol",
    "percentiles_rank": "SELECT symbol, " + ", ".join(f"list_sort(list(price))[least(count(*) - 1, count(*) * {p} // 100) + 1] AS p{p}" for p in (50, 90, 99)) + " FROM ticks GROUP BY symbol",
    "alert_rates": "SELECT symbol, count(*) AS n, round(greatest((max(ts_ns) - min(ts_ns)) / 6e10, 1e-6), 6) AS span_min, round(count(*) / greatest((max(ts_ns) - min(ts_ns)) / 6e10, 1e-6), 9) AS per_min FROM alerts GROUP BY symbol",
    "throughput": "SELECT symbol, round(count(*) / ((max(ts_ns) - min(ts_ns)) / 1e9), 12) AS per_sec FROM ticks GROUP BY symbol",
    "evaluate_summary": (
        "SELECT detected, positives, quiet_hit, quiet_windows, quiet_alerts, unattributed, alerts, round(quiet_days, 6) AS quiet_days, round(p, 6) AS recall, round(greatest(0, centre - half), 6) AS recall_low, round(least(1, centre + half), 6) AS recall_high, round(quiet_hit / quiet_windows, 6) AS quiet_rate, round(quiet_alerts / quiet_days, 6) AS fp_per_day FROM (SELECT *, (p + 1.96 * 1.96 / (2 * positives)) / (1 + 1.96 * 1.96 / positives) AS centre, 1.96 * sqrt(p * (1 - p) / positives + 1.96 * 1.96 / (4 * positives * positives)) / (1 + 1.96 * 1.96 / positives) AS half FROM counted)",
        """counted AS (SELECT *, detected / positives AS p FROM (SELECT (SELECT count(DISTINCT event_no) FROM pairs WHERE polarity = 'positive') AS detected, (SELECT count(*) FROM catalog WHERE polarity = 'positive') AS positives,
        (SELECT count(DISTINCT event_no) FROM pairs WHERE polarity = 'quiet') AS quiet_hit, (SELECT count(*) FROM catalog WHERE polarity = 'quiet') AS quiet_windows, (SELECT sum(duration_sec) / 86400 FROM catalog WHERE polarity = 'quiet') AS quiet_days,
        (SELECT count(*) FROM pairs WHERE polarity = 'quiet') AS quiet_alerts, (SELECT count(*) FROM alerts a WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.ts_ns = a.ts_ns AND p.symbol = a.symbol AND p.kind = a.kind)) AS unattributed, (SELECT count(*) FROM alerts) AS alerts))""",
    ),
    "per_event_type": "SELECT event_type, count(*) FILTER (hit) AS detected, count(*) AS total, round(count(*) FILTER (hit) / count(*), 6) AS rate FROM (SELECT *, event_no IN (SELECT event_no FROM pairs) AS hit FROM catalog WHERE polarity = 'positive') GROUP BY event_type",
    "per_kind": "SELECT a.kind, (SELECT count(*) FROM (SELECT DISTINCT ts_ns, symbol FROM pairs p WHERE p.kind = a.kind AND polarity = 'positive')) AS attributed, (SELECT count(*) FROM pairs p WHERE p.kind = a.kind AND polarity = 'quiet') AS in_quiet, a.total FROM (SELECT kind, count(*) AS total FROM alerts GROUP BY kind) a",
    "outside_coverage": "SELECT event_no FROM catalog, (SELECT min(ts_ns) - 1800000000000 AS a, max(ts_ns) + 1800000000000 AS b FROM alerts WHERE score >= 14.5) WHERE polarity = 'positive' AND (ts_ns < a OR ts_ns > b)",
    "price_delta": "SELECT symbol, first_price, last_price, round((last_price - first_price) / first_price * 100, 6) AS delta_pct FROM (SELECT symbol, arg_min(price, (ts_ns, seq)) AS first_price, arg_max(price, (ts_ns, seq)) AS last_price FROM ticks GROUP BY symbol)",
    "wilson_ci": "SELECT symbol, round(greatest(0, centre - half), 9) AS low, round(least(1, centre + half), 9) AS high FROM (SELECT symbol, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) AS centre, 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n) AS half FROM (SELECT symbol, count(*)::DOUBLE AS n, count(*) FILTER (kind = 'cusum') / count(*) AS p FROM alerts GROUP BY symbol))",
    "joint_pmf": "SELECT " + ", ".join(f"(CASE WHEN r{k} > e{k}[1] THEN 1 ELSE 0 END + CASE WHEN r{k} > e{k}[2] THEN 1 ELSE 0 END + CASE WHEN r{k} > e{k}[3] THEN 1 ELSE 0 END)::INTEGER AS b_r{k}" for k in range(3)) + ", count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS p FROM returns, (SELECT " + ", ".join(f"quantile_cont(r{k}, [0.25, 0.5, 0.75]) AS e{k}" for k in range(3)) + " FROM returns) GROUP BY ALL",
    "rolling_sum5": "SELECT t, asset::INTEGER AS asset, round(s, 9) AS s FROM (SELECT t, asset, sum(ret) OVER (PARTITION BY asset ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS s FROM long_returns) WHERE t >= 5",
    "null_z": "SELECT t, asset::INTEGER AS asset, round((ret - avg(ret) OVER (PARTITION BY asset)) / greatest(stddev_samp(ret) OVER (PARTITION BY asset), 1e-12), 6) AS z FROM long_returns",
    "peak_drop": "SELECT asset::INTEGER AS asset, arg_min(t, (ret, t)) AS t, round(min(ret), 9) AS ret FROM long_returns GROUP BY asset",
    "burst_max_window": "SELECT symbol, max(n1) AS n1, max(n10) AS n10, max(n3600) AS n3600 FROM (SELECT symbol, " + ", ".join(f"count(*) OVER (PARTITION BY symbol ORDER BY ts_ns RANGE BETWEEN {n}000000000 PRECEDING AND CURRENT ROW) AS n{n}" for n in (1, 10, 3600)) + " FROM alerts) GROUP BY symbol",
    "rolling_alert_density": "SELECT seq, count(*) OVER (PARTITION BY symbol ORDER BY ts_ns RANGE BETWEEN 21600000000000 PRECEDING AND CURRENT ROW) AS n_within FROM alerts",
    "realized_vol": (
        "SELECT t, asset::INTEGER AS asset, round(vol, 9) AS vol, vol < quantile_cont(vol, 0.5) OVER (PARTITION BY asset) AS below_median FROM v",
        "v AS (SELECT * FROM (SELECT t, asset, CASE WHEN count(ret) OVER w = 20 THEN stddev_samp(ret) OVER w END AS vol FROM long_returns WINDOW w AS (PARTITION BY asset ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) WHERE vol IS NOT NULL)",
    ),
    "sessionize": f"SELECT symbol, session, count(*) AS n, min(ts_ns) AS first, max(ts_ns) AS last FROM (SELECT *, sum(fresh) OVER {ORDERED}::BIGINT AS session FROM (SELECT *, CASE WHEN ts_ns - lag(ts_ns) OVER {ORDERED} > 3600000000000 THEN 1 ELSE 0 END AS fresh FROM ticks)) GROUP BY ALL",
    "ref_eval_slice": "SELECT * FROM (SELECT t, CASE WHEN t BETWEEN 318 AND 569 THEN 'ref' WHEN t BETWEEN 600 AND 619 THEN 'eval' END AS part, round(r0, 9) AS r0 FROM returns) WHERE part IS NOT NULL",
    "alert_history": f"SELECT ts_ns, seq, price, round(score, 6) AS score, {SEVERITY} AS severity FROM alerts WHERE symbol = 'view' AND kind = 'cusum' AND ts_ns >= 1704672000000000000 ORDER BY ts_ns DESC, seq DESC LIMIT 50",
    "topk_score": "SELECT seq, symbol, round(score, 6) AS score FROM alerts ORDER BY abs(score) DESC, seq LIMIT 10",
    "recent_n": "SELECT ts_ns, seq, symbol, kind FROM alerts ORDER BY ts_ns DESC, seq DESC LIMIT 500",
    "watchlist_diff": "(SELECT DISTINCT c_nationkey AS k, 'add' AS change FROM customer WHERE c_nationkey < 20 AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey > 3)) UNION ALL (SELECT DISTINCT s_nationkey, 'remove' FROM supplier WHERE s_nationkey > 3 AND s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_nationkey < 20))",
    "digest_windows": (
        """SELECT w, count(*) AS n, array_to_string(list_sort(list(DISTINCT symbol))[1:3], ', ') AS names, count(DISTINCT symbol) AS n_symbols,
        CASE WHEN count(*) = 1 THEN '1 alert on ' || min(symbol) ELSE count(*) || ' alerts on ' || count(DISTINCT symbol) || ' symbols' END AS subject FROM told WHERE fired GROUP BY w""",
        """strong AS (SELECT symbol, ts_ns, ts_ns // 60000000000 AS w, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns) AS i FROM alerts WHERE abs(score) >= 6),
        told AS (SELECT symbol, i, w, true AS fired, w AS sent FROM strong WHERE i = 1
          UNION ALL SELECT symbol, i, w, fired, CASE WHEN fired THEN w ELSE sent END FROM (SELECT n.symbol, n.i, n.w, f.sent, n.w = f.sent OR n.ts_ns - (f.sent + 1) * 60000000000 >= 3600000000000 AS fired FROM told f JOIN strong n ON n.symbol = f.symbol AND n.i = f.i + 1))""",
    ),
    "trade_quote_asof": """SELECT t.symbol, t.seq, t.price, t.ts_ns - q.ts_ns AS age_ns, round(q.bid, 6) AS bid, round(q.ask, 6) AS ask
      FROM (SELECT symbol, ts_ns, seq * 2 AS seq, price, ts_ns::HUGEINT * 1000000000 + seq * 2 AS place FROM ticks) t
      ASOF LEFT JOIN (SELECT symbol, ts_ns, bid, ask, ts_ns::HUGEINT * 1000000000 + seq * 2 + 1 AS place FROM quotes) q ON t.symbol = q.symbol AND t.place >= q.place""",
    "context_snapshot": (
        f"""SELECT symbol, n, first_ns, last_ns, last_price, total, CASE WHEN fine THEN round(bid, 6) END AS bid, CASE WHEN fine THEN round(ask, 6) END AS ask, CASE WHEN fine THEN bid_size END AS bid_size,
          CASE WHEN fine THEN ask_size END AS ask_size, CASE WHEN fine THEN round({MID}, 6) END AS mid, CASE WHEN fine THEN round({SPREAD}, 6) END AS spread_bps
          FROM ring JOIN (SELECT *, ask > bid AND bid > 0 AS fine FROM book WHERE k = 1) USING (symbol)""",
        f"""stream AS (SELECT symbol, ts_ns, seq * 2 AS seq, price FROM ticks UNION ALL SELECT symbol, ts_ns, seq * 2 + 1, {MID} FROM quotes WHERE {MID} > 0),
        ring AS (SELECT symbol, count(*) AS n, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, round(arg_min(price, k), 6) AS last_price, round(sum(price), 3) AS total
          FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns DESC, seq DESC) AS k FROM stream) WHERE k <= 1000 GROUP BY symbol),
        book AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns DESC, seq DESC) AS k FROM quotes)""",
    ),
    "alert_rate_windows": """SELECT w * 7200000000000 AS w_ns, symbol, kind, count(*) AS n, round(max(abs(score)), 6) AS most, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns
      FROM (SELECT *, ts_ns // 7200000000000 - k AS w FROM alerts, range(3) AS r(k)) GROUP BY ALL""",
    "alert_sessions": """SELECT symbol, count(*) AS n, round(max(abs(score)), 6) AS most, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns FROM (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY ts_ns, seq) AS run
      FROM (SELECT *, CASE WHEN ts_ns - lag(ts_ns) OVER (PARTITION BY symbol ORDER BY ts_ns, seq) < 14400000000000 THEN 0 ELSE 1 END AS fresh FROM alerts)) GROUP BY symbol, run""",
    "ffill_limit2": "SELECT d, " + ", ".join(f"round(p{k}, 6) AS p{k}" for k in range(8)) + " FROM complete",
    "log_returns": "SELECT t, " + ", ".join(f"round(r{k}, 9) AS r{k}" for k in range(8)) + " FROM returns",
    "rank_uniform": "SELECT t, asset, round(greatest(1e-6, least(1 - 1e-6, (k + (same - 1) / 2) / (n + 1))), 9) AS u FROM (SELECT t, asset, rank() OVER (PARTITION BY asset ORDER BY ret) AS k, count(*) OVER (PARTITION BY asset, ret) AS same, count(*) OVER (PARTITION BY asset) AS n FROM long_returns)",
    "ecdf_transform": "SELECT t, asset, round(greatest(1e-6, least(1 - 1e-6, k / (n + 1))), 9) AS u FROM (SELECT t, asset, count(*) FILTER (t <= 252) OVER (PARTITION BY asset ORDER BY ret) AS k, count(*) FILTER (t <= 252) OVER (PARTITION BY asset) AS n FROM long_returns)",
    "kendall_tau": " UNION ALL ".join(f"SELECT a.block, 'r{i}' AS x, 'r{j}' AS y, round(sum(sign(a.r{i} - b.r{i}) * sign(a.r{j} - b.r{j})) / sqrt(sum(abs(sign(a.r{i} - b.r{i}))) * sum(abs(sign(a.r{j} - b.r{j})))), 9) AS tau FROM (SELECT *, (t - 1) // 252 AS block FROM returns) a JOIN (SELECT *, (t - 1) // 252 AS block FROM returns) b ON a.block = b.block AND a.t < b.t GROUP BY a.block" for i in range(4) for j in range(i + 1, 4)),
    "ks_two_sample": "SELECT asset, round(max(abs(k / n - l / m)), 9) AS ks FROM (SELECT asset, count(*) FILTER (t <= 252) OVER o AS k, count(*) FILTER (t <= 252) OVER p AS n, count(*) FILTER (t > 252) OVER o AS l, count(*) FILTER (t > 252) OVER p AS m FROM long_returns WINDOW o AS (PARTITION BY asset ORDER BY ret), p AS (PARTITION BY asset)) GROUP BY asset",
    "obi_hysteresis": f"SELECT symbol, seq, round(obi, 9) AS obi FROM ({LATCH})",
    "crossed_book": "SELECT symbol, seq, round(bid - ask, 9) AS score FROM quotes WHERE bid > ask AND ask > 0",
    "ewma_mad": ("SELECT symbol, count(z) AS n_scored, round(arg_max(mean, i), 9) AS mean, round(arg_max(mad, i), 9) AS mad FROM fold GROUP BY symbol", _price_fold()),
    "robust_z_alerts": ("SELECT symbol, seq, round(z, 6) AS score FROM fold WHERE abs(z) > 4", _price_fold()),
    "cusum_alerts": ("SELECT symbol, seq, round(hit, 6) AS score FROM fold WHERE hit <> 0", _price_fold()),
    "volume_spike": ("SELECT symbol, seq, round(z, 6) AS z FROM scored WHERE z > 1.2", _ewma_fold("SELECT symbol, ts_ns, seq, ln(size) AS x FROM ticks")),
    "microprice_drift": ("SELECT symbol, seq, round(z, 6) AS z FROM scored WHERE abs(z) > 1.6", _ewma_fold(f"SELECT * FROM (SELECT symbol, ts_ns, seq, {DRIFT} AS x FROM quotes) WHERE x IS NOT NULL")),
    "sweep_grid": (
        """SELECT z_thresh::DOUBLE AS z_thresh, h AS cusum_h, z_alerts, cusum_alerts, round((z_alerts + cusum_alerts) / (SELECT count(*) FROM ticks) * 100, 6) AS pct_ticks, round(coalesce(greatest(mz, mh), 0), 6) AS max_abs_score FROM
        (SELECT z_thresh, count(*) FILTER (abs(z) > z_thresh) AS z_alerts, max(abs(z)) FILTER (abs(z) > z_thresh) AS mz FROM fold, (VALUES (2), (3), (4)) AS g(z_thresh) WHERE h = 3 GROUP BY z_thresh),
        (SELECT h, count(*) FILTER (hit <> 0) AS cusum_alerts, max(abs(hit)) AS mh FROM fold GROUP BY h)""",
        _price_fold("h", "(VALUES (3.0::DOUBLE), (5.0::DOUBLE), (8.0::DOUBLE)) AS g(h)"),
    ),
    "ts_resolution": (
        "SELECT times, list_reduce(list(DISTINCT t - least_t), lambda a, x: gcd(a, x))::BIGINT AS resolution_ns FROM (SELECT *, min(t) OVER (PARTITION BY times) AS least_t FROM stamps) GROUP BY times",
        """stamps AS (SELECT 'alerts' AS times, ts_ns AS t FROM alerts UNION SELECT 'alerts', ts_ns FROM catalog UNION SELECT 'days', (d - DATE '1970-01-01')::BIGINT * 86400000000000 FROM prices
        UNION SELECT 'grid', ts_ns // 180000000000 * 180000000000 + 7 FROM ticks)""",
    ),
    "tick_export_format": "SELECT ts_ns, symbol, printf('%.6f', price) AS price FROM ticks",
    "wide_to_replay": "SELECT (d - DATE '1970-01-01')::BIGINT * 86400000000000 AS ts_ns, 'p3' AS symbol, round(p3, 6) AS price FROM complete",
    "config_overlay": """SELECT name, coalesce(v2, v1, '0') AS value, coalesce(v2, v1, '0') <> '0' AS overridden FROM (SELECT p_brand AS name, max(p_size) FILTER (p_retailprice > 1500)::VARCHAR AS v1,
        CASE WHEN max(p_size) >= 50 THEN 'large' END AS v2 FROM part GROUP BY p_brand)""",
    "pause_resume": (
        "SELECT t.seq, t.symbol FROM ticks t ASOF LEFT JOIN switches s ON t.ts_ns >= s.ts_ns WHERE coalesce(s.active, true)",
        "switches AS (SELECT ts_ns, min(price) < 0.5 AS active FROM ticks WHERE price >= 300 OR price < 0.5 GROUP BY ts_ns)",
    ),
    "watchlist_guard": (
        """SELECT symbol, 'add' AS change, 'some' AS "case" FROM (SELECT symbol FROM seg WHERE symbol > 'B' EXCEPT SELECT symbol FROM have)
        UNION ALL SELECT symbol, 'remove', 'some' FROM (SELECT symbol FROM have EXCEPT SELECT symbol FROM seg WHERE symbol > 'B') UNION ALL SELECT symbol, 'remove', 'cleared' FROM have""",
        "seg AS (SELECT DISTINCT upper(trim(c_mktsegment)) AS symbol FROM customer), have AS (SELECT DISTINCT upper(trim(c_mktsegment)) AS symbol FROM customer WHERE c_acctbal < 5000 AND c_mktsegment < 'F')",
    ),
    "drain_limit": "SELECT symbol, count(*) AS n, max(ts_ns) AS last FROM (SELECT * FROM ticks ORDER BY ts_ns, seq LIMIT 2000) GROUP BY symbol",
    "inspection_report": (
        """SELECT section, key, n, round(CASE WHEN section IN ('all', 'kind', 'symbol') THEN n / greatest((SELECT (max(ts_ns) - min(ts_ns)) / 6e10 FROM ring), 1e-6) END, 6) AS per_min,
        round(s[least(n - 1, n * 50 // 100) + 1], 6) AS p50, round(s[least(n - 1, n * 95 // 100) + 1], 6) AS p95, round(coalesce(s[n], most), 6) AS most FROM (
        SELECT 'all' AS section, '*' AS key, count(*) AS n, list_sort(list(abs(score))) AS s, NULL::DOUBLE AS most FROM ring
        UNION ALL SELECT 'kind', kind, count(*), list_sort(list(abs(score))), NULL FROM ring GROUP BY kind UNION ALL SELECT 'symbol', symbol, count(*), list_sort(list(abs(score))), NULL FROM ring GROUP BY symbol
        UNION ALL SELECT 'symbol x kind', symbol || ' x ' || kind, count(*), list_sort(list(abs(score))), NULL FROM ring GROUP BY symbol, kind
        UNION ALL SELECT 'top', lpad(k::VARCHAR, 2, '0') || ' ' || symbol || ' ' || kind, 1, NULL, abs(score) FROM (SELECT *, row_number() OVER (ORDER BY abs(score) DESC, ts_ns, seq) AS k FROM ring) WHERE k <= 10
        UNION ALL SELECT 'within', s || ' s', max(n), NULL, NULL FROM (SELECT s, (SELECT count(*) FROM ring b WHERE b.ts_ns BETWEEN a.ts_ns - s::BIGINT * 1000000000 AND a.ts_ns) AS n FROM ring a, (VALUES (1), (10), (60)) AS v(s)) GROUP BY s)""",
        "ring AS (SELECT * FROM alerts ORDER BY ts_ns DESC, seq DESC LIMIT 500)",
    ),
    "ttd_summary": (
        """SELECT n, early, g AS resolution_ns, unit, round(mean / 1e6, 3) AS mean_ms, round(middle / 1e6, 3) AS median_ms, round(least(earliest, 0) / 1e6, 3) AS earliest_ms, round(middle / size, 3) AS median_units, round(g / size, 3) AS resolution_units
        FROM (SELECT *, CASE WHEN g < 1000000000 THEN 'ms' WHEN g >= 86400000000000 THEN 'day' ELSE 's' END AS unit, CASE WHEN g < 1000000000 THEN 1000000 WHEN g >= 86400000000000 THEN 86400000000000 ELSE 1000000000 END AS size
        FROM (SELECT count(*) AS n, count(*) FILTER (ttd < 0) AS early, avg(ttd) AS mean, list_sort(list(ttd))[count(*) // 2 + 1] AS middle, min(ttd) AS earliest FROM best), resolution)""",
        """best AS (SELECT ts_ns - event_ts AS ttd FROM (SELECT *, row_number() OVER (PARTITION BY event_no ORDER BY ts_ns < event_ts, abs(ts_ns - event_ts), ts_ns) AS k FROM pairs WHERE polarity = 'positive') WHERE k = 1),
        stamps AS (SELECT ts_ns FROM alerts UNION SELECT ts_ns FROM catalog),
        resolution AS (SELECT list_reduce(list(DISTINCT ts_ns - (SELECT min(ts_ns) FROM stamps)), lambda a, x: gcd(a, x)) AS g FROM stamps)""",
    ),
    "quiet_windows": ("SELECT unnest([s1, s2, s3]) AS start FROM picked", GATE),
    "gate_corroboration": (
        """SELECT n_reference, n_new, n_both, n_new_alone, round(n_both / n_reference, 6) AS corroborated, round(n_new_alone / n_new, 6) AS lift FROM (
        SELECT count(*) FILTER (abs(z0) >= 2) AS n_reference, count(*) FILTER (abs(z1) >= 1.5) AS n_new, count(*) FILTER (abs(z0) >= 2 AND abs(z1) >= 1.5) AS n_both, count(*) FILTER (abs(z0) < 2 AND abs(z1) >= 1.5) AS n_new_alone FROM days)""",
        GATE,
    ),
    "gate_quiet_firings": (
        """SELECT start, firings, round(firings / 30, 6) AS per_day, firings / 30 <= 0.1 AS passed FROM (
        SELECT start, (SELECT count(*) FROM days WHERE t >= start AND t < start + 30 AND abs(z1) >= 1) AS firings FROM (SELECT unnest([s1, s2, s3]) AS start FROM picked))""",
        GATE,
    ),
    "gate_merge": (
        "SELECT event, best, best_day, g.peak_day AS gauss_day, t.peak_day AS t_day, round(best_z, 6) AS best_z, round(g.peak_z, 6) AS gauss_z, round(t.peak_z, 6) AS t_z FROM best JOIN runs g USING (event) JOIN runs t USING (event) WHERE g.method = 'gaussian' AND t.method = 't' AND g.type = 'crisis'",
        RUNS,
    ),
    "gate_best": ("SELECT event, best, round(best_z, 6) AS best_z FROM best", RUNS),
    "gate_peaks": ("SELECT event, type, method, round(peak_z, 6) AS peak_z, peak_day FROM runs", RUNS),
    "gate_verdict": (
        """SELECT *, CASE WHEN c1 AND c2 AND c3 AND c4 AND c5 THEN 'full' WHEN c1 AND c4 AND c5 THEN 'partial' ELSE 'fail' END AS decision FROM (
        SELECT n_far, n_timely, n_beyond_t, n_spurious, n_spurious_t, round(threshold, 6) AS threshold, n_far >= 2 AS c1, n_timely >= 2 AS c2, n_beyond_t >= 1 AS c3, n_spurious <= 1 AS c4, n_spurious <= n_spurious_t AS c5 FROM (
        SELECT threshold, (SELECT count(*) FROM crisis WHERE far) AS n_far, (SELECT count(*) FROM crisis WHERE far AND best_day <= g_day + 2) AS n_timely, (SELECT count(*) FROM crisis WHERE abs(best_z) > abs(t_z)) AS n_beyond_t,
          (SELECT count(*) FROM best WHERE type = 'quiet' AND abs(best_z) >= threshold) AS n_spurious, (SELECT count(*) FROM runs WHERE type = 'quiet' AND method = 't' AND abs(peak_z) >= threshold) AS n_spurious_t
        FROM (SELECT quantile_cont(abs(best_z), 0.5) AS threshold FROM best WHERE type = 'crisis')))""",
        RUNS + """, crisis AS (SELECT best.*, g.peak_day AS g_day, t.peak_z AS t_z, abs(best_z) >= 1.5 * abs(g.peak_z) AS far FROM best JOIN runs g USING (event) JOIN runs t USING (event)
        WHERE g.method = 'gaussian' AND t.method = 't' AND best.type = 'crisis')""",
    ),
    "p2_quantile": ("SELECT symbol, max(i) AS n, round(arg_max(h2, i) FILTER (p = 0.25), 6) AS q25, round(arg_max(h2, i) FILTER (p = 0.5), 6) AS q50, round(arg_max(h2, i) FILTER (p = 0.75), 6) AS q75 FROM q GROUP BY symbol", _p2_fold("q", "SELECT symbol, ts_ns, seq, price AS x FROM ticks")),
    "spread_widen": ("SELECT symbol, seq, round(z, 6) AS score FROM spreads_z WHERE abs(z) > 0.9", _p2_fold("spreads", WIDTHS)),
    "quote_rate_spike": ("SELECT symbol, seq, round(score, 6) AS score FROM spikes", _p2_fold("rates", RATES) + ", " + _cooled("spikes", "SELECT symbol, ts_ns, seq, z AS score FROM rates_z WHERE z > 5", 1)),
    "regime_shift": ("SELECT symbol, seq, round(score, 6) AS score FROM regimes", _price_fold() + ", " + _regimes(0.17, 86_400)),
    "burst": (
        "SELECT symbol, seq, round(score, 6) AS score FROM bursts",
        _price_fold("3.0") + ", " + _bursts("SELECT symbol, ts_ns, seq FROM fold WHERE hit <> 0 UNION ALL SELECT symbol, ts_ns, seq FROM fold WHERE abs(z) > 2", 86_400, 2, 86_400),
    ),
    "full_detector": (
        "SELECT symbol, seq, (row_number() OVER (PARTITION BY symbol, seq ORDER BY k) - 1)::INTEGER AS ord, kind, round(price, 6) AS price, round(score, 6) AS score FROM (SELECT * FROM told UNION ALL SELECT b.symbol, b.ts_ns, b.seq, 9, 'burst', value, score FROM bursts b JOIN mixed USING (symbol, seq))",
        f"""mixed AS (SELECT symbol, ts_ns, seq * 2 AS seq, price AS value FROM ticks UNION ALL SELECT symbol, ts_ns, seq * 2 + 1, {MID} FROM quotes),
        prices_seen AS (SELECT symbol, ts_ns, seq, value AS price FROM mixed),
        {_price_fold(source="prices_seen")}, {_regimes(0.25, 60)},
        {_ewma_fold("SELECT symbol, ts_ns, seq * 2 AS seq, ln(size) AS x FROM ticks", "volumes")},
        {_ewma_fold(f"SELECT * FROM (SELECT symbol, ts_ns, seq * 2 + 1 AS seq, {DRIFT} AS x FROM quotes) WHERE x IS NOT NULL", "drifts")},
        {_p2_fold("spreads", WIDTHS)}, {_p2_fold("rates", RATES)}, {_cooled("spikes", "SELECT symbol, ts_ns, seq, z AS score FROM rates_z WHERE z > 5", 1)},
        found AS (SELECT symbol, seq, 0 AS k, 'cusum' AS kind, hit AS score FROM fold WHERE hit <> 0 UNION ALL SELECT symbol, seq, 1, 'robust_z', z FROM fold WHERE abs(z) > 4
          UNION ALL SELECT symbol, seq, 2, 'regime_shift', score FROM regimes UNION ALL SELECT symbol, seq, 3, 'volume_spike', z FROM volumes WHERE z > 4
          UNION ALL SELECT symbol, seq * 2 + 1, 4, 'crossed_book', bid - ask FROM quotes WHERE bid > ask AND ask > 0 UNION ALL SELECT symbol, seq * 2 + 1, 5, 'spread_widen', z FROM spreads_z WHERE abs(z) > 5
          UNION ALL SELECT symbol, seq * 2 + 1, 6, 'obi_extreme', obi FROM ({LATCH}) UNION ALL SELECT symbol, seq * 2 + 1, 7, 'quote_rate_spike', score FROM spikes
          UNION ALL SELECT symbol, seq, 8, 'microprice_drift', z FROM drifts WHERE abs(z) > 4),
        told AS (SELECT symbol, ts_ns, seq, k, kind, value AS price, score FROM found JOIN mixed USING (symbol, seq)),
        {_bursts("SELECT symbol, ts_ns, seq FROM told", 10, 3, 10)}""",
    ),
}

_BODIES["detector_sql"] = _BODIES["full_detector"]
_BODIES["detected_alerts_evaluation"] = (
    """SELECT alerts, detected, positives, quiet_windows, quiet_hit, quiet_alerts, unattributed, CASE WHEN positives > 0 THEN round(detected / positives, 6) ELSE 0 END AS recall,
      CASE WHEN quiet_days > 0 THEN round(quiet_alerts / quiet_days, 6) ELSE 0 END AS fp_per_day FROM (SELECT (SELECT count(*) FROM found) AS alerts,
      (SELECT count(DISTINCT event_no) FROM hits WHERE polarity = 'positive') AS detected, (SELECT count(*) FROM catalog WHERE polarity = 'positive') AS positives, (SELECT count(*) FROM catalog WHERE polarity = 'quiet') AS quiet_windows,
      (SELECT count(DISTINCT event_no) FROM hits WHERE polarity = 'quiet') AS quiet_hit, (SELECT count(*) FROM hits WHERE polarity = 'quiet') AS quiet_alerts,
      (SELECT count(*) FROM found f WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.ts_ns = f.ts_ns AND h.symbol = f.symbol)) AS unattributed, (SELECT sum(duration_sec) / 86400 FROM catalog WHERE polarity = 'quiet') AS quiet_days)""",
    _price_fold() + """, found AS (SELECT symbol, ts_ns, seq FROM fold WHERE abs(z) > 4),
    hits AS (SELECT c.event_no, c.polarity, f.ts_ns, f.symbol FROM catalog c JOIN found f ON f.symbol = c.symbol
      AND f.ts_ns BETWEEN CASE WHEN c.duration_sec > 0 THEN c.ts_ns ELSE c.ts_ns - 1800000000000 END AND CASE WHEN c.duration_sec > 0 THEN c.ts_ns + (c.duration_sec * 1000000000)::BIGINT ELSE c.ts_ns + 1800000000000 END)""",
)

SQL: dict[str, str] = {name: _sql(*body) if isinstance(body, tuple) else _sql(body) for name, body in _BODIES.items()}
