"""Column expressions over ticks, quotes and alerts."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean absolute deviation to sigma, interquartile range to sigma.
MAD_TO_SIGMA, IQR_TO_SIGMA = 1.2533141373155003, 1.34898


def mid(bid="bid", ask="ask") -> Column:
    return F.when(F.col(ask) > 0, 0.5 * (F.col(bid) + F.col(ask))).otherwise(0.0)


def spread_bps(bid="bid", ask="ask") -> Column:
    b, a = F.col(bid), F.col(ask)
    return F.when((b > 0) & (a > 0) & (a > b), (a - b) / (0.5 * (a + b)) * 1e4).otherwise(0.0)


def imbalance(bid_size="bid_size", ask_size="ask_size") -> Column:
    b, a = F.col(bid_size), F.col(ask_size)
    return F.when((b > 0) & (a > 0), (b - a) / (b + a))


def microprice_drift(bid="bid", ask="ask", bid_size="bid_size", ask_size="ask_size") -> Column:
    """How far the size-weighted price lies from the mid, in spreads; null for an invalid book."""
    b, a, bs, az = (F.col(c) for c in (bid, ask, bid_size, ask_size))
    weighted = (b * az + a * bs) / (bs + az)
    return F.when((b > 0) & (a > b) & (bs > 0) & (az > 0), (weighted - 0.5 * (b + a)) / (a - b))


def severity(kind="kind", score="score") -> Column:
    # Kinds with a severity of their own, and the ladder of the others.
    size, k = F.abs(score), F.col(kind)
    return (
        F.when(k == "crossed_book", "ANOMALY").when(k == "burst", "WARNING").when(k == "obi_extreme", "ALERT")
        .when(size >= 8, "ANOMALY").when(size >= 5, "WARNING").when(size >= 3, "ALERT").otherwise("INFO")
    )


def text_of(value: Column, spec: str) -> Column:
    """A number as text by the exact value, as format() gives it; the JVM's formats round the shortest decimals half up."""

    @F.arrow_udf("string")
    def run(numbers: pa.Array) -> pa.Array:
        return pa.array([None if x is None or x != x else format(x, spec) for x in numbers.to_pylist()], pa.string())

    return run(value.cast("double"))


def _written(x: float, spec: str) -> str | None:
    """A number by format()'s spec; ``~2`` is for people: two places, or two significant digits of very large and small ones."""
    if x != x:
        return None
    if spec.startswith("~"):
        spec = f".{spec[1:]}{'g' if abs(x) >= 1e6 or 0 < abs(x) < 1e-3 else 'f'}"
    return format(x, spec)


def sentence(parts: Column) -> Column:
    """An array of (text, number, spec) as one text, numbers by spec and texts where there is no number. A single pass
    writes the chosen parts, whatever their number. Null where a part has neither text nor number, or a number that is none."""

    @F.arrow_udf("string")
    def run(rows: pa.Array) -> pa.Array:
        texts, numbers, specs = (c.to_pylist() for c in rows.flatten().flatten())
        said = [t if x is None else _written(x, s) for t, x, s in zip(texts, numbers, specs)]
        ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(rows), 0).to_pylist()]).tolist()
        return pa.array([None if a == b or None in said[a:b] else "".join(said[a:b]) for a, b in zip(ends, ends[1:])], pa.string())

    return run(parts)


def _part(text: Column, number: Column, spec: str) -> Column:
    return F.struct(text.cast("string").alias("text"), number.cast("double").alias("number"), F.lit(spec).alias("spec"))


def fmt(value: Column, digits: int = 2) -> Column:
    """A number for people: ``-`` for null, few significant digits for very large and small ones, else fixed places."""
    return sentence(F.array(_part(F.lit("-"), value, f"~{digits}")))


# The sentences by kind, and in braces what they tell: a column, a key of the details, or the first of both
# that is there; how a number is written; what stands where there is none.
SENTENCES = {
    "robust_z": "Price deviation {score|+.2f}σ from baseline on {symbol} (threshold ±{z_threshold|~1|?})",
    "cusum": "Cumulative drift {score|+.2f} on {symbol} (CUSUM threshold ±{cusum_h|~1|?})",
    "spread_widen": "Spread {spread_bps|~1|0}bps on {symbol}, {score|+.2f}σ from baseline {baseline_bps|~1|0}bps",
    "obi_extreme": "Order book {share|.0f}% {side||?}-dominant on {symbol}",
    "quote_rate_spike": "Quote rate {rate_qps|~1|?}/s on {symbol}, {score|+.2f}σ from baseline {baseline_qps|~1|?}/s",
    "regime_shift": "Return distribution shifted on {symbol} (KS={ks_statistic,score|~3|-}, threshold {ks_threshold|~2|?})",
    "burst": "Alert clustering on {symbol} - {alerts_in_window||?} alerts in {window_sec|~0|?}s ({intensity_ratio,score|~1|-}× baseline)",
    "dependence_shift": "Cross-asset dependence shifted {score|+.2f}σ across the basket",
    "volume_spike": "Volume spike on {symbol}, trade size {size|~4|?} ({ratio_to_baseline|~1|?}× rolling mean)",
    "microprice_drift": "Microprice drift {score|+.2f}σ toward {side||?} on {symbol} (informational asymmetry)",
    "crossed_book": "Crossed book on {symbol} - bid {bid|~4|0} > ask {ask|~4|0} (data error or extreme stress)",
    None: "{kind} on {symbol} (score {score|+.2f})",
}


def narrative(kind="kind", symbol="symbol", score="score", details="details") -> Column:
    """One sentence on an alert; details is JSON. The JVM picks the sentence of the alert's kind, its numbers are written in one pass."""
    columns = {"kind": f"`{kind}`", "symbol": f"`{symbol}`", "score": f"`{score}`", "share": f"100 * abs(`{score}`)"}

    def told(piece: str, braced: bool) -> str:
        name, spec, absent = (piece.split("|") + ["", ""])[:3] if braced else ("", "", "")
        found = [columns.get(n, f"get_json_object(`{details}`, '$.{n}')") for n in name.split(",")] if braced else [f"'{piece}'"]
        other = f"'{absent}'" if absent else "cast(null as string)"
        text, number = (other, f"coalesce({', '.join(f'try_cast({x} as double)' for x in found)})") if spec else (f"coalesce({', '.join(found)}, {other})", "cast(null as double)")
        return f"named_struct('text', {text}, 'number', {number}, 'spec', '{spec}')"

    def parts(template: str) -> str:
        pieces = re.split(r"[{}]", template)  # those at odd places were in braces
        return f"array({', '.join(told(p, k % 2 == 1) for k, p in enumerate(pieces) if p)})"

    whens = " ".join(f"when '{k}' then {parts(t)}" for k, t in SENTENCES.items() if k)
    chosen = F.expr(f"case `{kind}` {whens} else {parts(SENTENCES[None])} end")
    return sentence(F.concat(F.array(_part(F.concat(severity(kind, score), F.lit(": ")), F.lit(None), "")), chosen))


def rfc3339_ns(text: Column) -> Column:
    """Nanoseconds since 1970 of a UTC time with up to nine digits of fraction, without going through floating point."""
    seconds = F.unix_seconds(F.to_timestamp(F.substring(text, 1, 19), "yyyy-MM-dd'T'HH:mm:ss"))
    fraction = F.regexp_extract(text, r"\.(\d{1,9})", 1)
    return seconds * F.lit(1_000_000_000).cast("bigint") + F.rpad(fraction, 9, "0").cast("bigint")


def normal_symbol(text: Column) -> Column:
    return F.upper(F.trim(text))


def asset_class(feed: Column) -> Column:
    """crypto for that feed, equities for the exchange feeds, else unknown."""
    return F.when(feed == "crypto", "crypto").when(feed.isin("iex", "sip"), "equities").otherwise("unknown")


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Interval of a share k of n; (0, 0) if n is 0."""
    p, zz = k / n, z * z
    centre, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    zero = F.lit(0.0)
    return F.when(n > 0, F.greatest(zero, centre - half)).otherwise(zero), F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(zero)
