"""What one symbol's detectors remember, and how a run of its events changes that: a small state per symbol, whatever its events.

Events come in arrays. Windows, gaps, sessions and comparisons are worked out for a whole array; tight loops go over
numbers alone for what depends on the order: means, resets, markers.
"""

from __future__ import annotations

import json
import math
from collections import deque
from dataclasses import dataclass, replace

import numpy as np

from driftwatch.functions.scalar import IQR_TO_SIGMA, MAD_TO_SIGMA

TINY, NS = 1e-12, 1_000_000_000


@dataclass(frozen=True)
class Params:
    """Thresholds and windows of the detectors. Times are in seconds."""

    alpha: float = 0.02
    z_thresh: float = 4.0
    cusum_k: float = 0.5
    cusum_h: float = 5.0
    session_gap: float = 600.0
    warmup: int = 5
    min_obs: int = 0
    spread_z: float = 5.0
    obi_extreme: float = 0.9
    obi_rearm: float = 0.5
    qrate_window: int = 20
    qrate_z: float = 5.0
    qrate_cooldown: float = 1.0
    vol_z: float = 4.0
    micro_z: float = 4.0
    burst_window: float = 10.0
    burst_k: float = 3.0
    burst_alpha: float = 0.001
    burst_cooldown: float = 10.0
    regime_short: int = 100
    regime_ref: int = 500
    regime_stride: int = 50
    regime_check: int = 50
    regime_ks: float = 0.25
    regime_cooldown: float = 60.0
    use_quote_mid: bool = True
    #: "parity" moves a marker up where the published method moves it down; see P2.
    p2_fallback: str = "parity"


LIBRARY = Params()
LIVE = replace(LIBRARY, warmup=50, min_obs=100)


#: The kinds of alerts in the order in which one event gives them.
KINDS = ("cusum", "robust_z", "regime_shift", "volume_spike", "crossed_book", "spread_widen", "obi_extreme", "quote_rate_spike", "microprice_drift", "burst")
_ORDER = {k: i for i, k in enumerate(KINDS)}
_PRICE_KINDS = frozenset(KINDS[:3])
#: Kinds whose quantiles' markers remember all of a symbol's events.
MARKED = frozenset({"spread_widen", "quote_rate_spike"})

#: An alert of an event of an array: its place, the order of its kind, kind, price, score, details. The keys of details are
#: fixed values by kind.
Alert = tuple[int, int, str, float, float, dict]


def smoothed(alpha: float, start: float, x: np.ndarray) -> np.ndarray:
    """The exponentially weighted mean after each value, from a mean before them. In order, so that results are the same
    to the last digit wherever arrays are cut."""
    keep, out = 1 - alpha, []
    for v in x.tolist():
        start = keep * start + alpha * v
        out.append(start)
    return np.array(out, float)


class Ewma:
    """Exponentially weighted mean, and mean absolute deviation from it. ``primed``: the first value is the mean."""

    def __init__(self, alpha: float, primed: bool):
        self.alpha, self.primed, self.mean, self.mad, self.n = alpha, primed, 0.0, 0.0, 0

    def add(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and deviation after each value."""
        mean, mad = np.empty(len(x)), np.empty(len(x))
        first = int(self.primed and self.n == 0 and len(x) > 0)
        if first:
            self.mean = mean[0] = x[0]
            mad[0] = self.mad
        mean[first:] = smoothed(self.alpha, self.mean, x[first:])
        mad[first:] = smoothed(self.alpha, self.mad, np.abs(x[first:] - mean[first:]))
        if len(x):
            self.mean, self.mad, self.n = float(mean[-1]), float(mad[-1]), self.n + len(x)
        return mean, mad


def robust_z(x: np.ndarray, mean: np.ndarray, mad: np.ndarray) -> np.ndarray:
    return np.where(mad > TINY, (x - mean) / (MAD_TO_SIGMA * np.maximum(mad, TINY)), 0.0)


class P2:
    """A quantile by five moving markers (Jain and Chlamtac, 1985)."""

    def __init__(self, p: float, fallback: str = "parity"):
        self.p, self.fallback, self.n = p, fallback, 0
        self.heights: list[float] = []
        self.places = [1, 2, 3, 4, 5]

    @property
    def value(self) -> float:
        return self.heights[2] if self.n >= 5 else 0.0

    def add(self, values: list[float]) -> list[float]:
        """The estimate after each value; 0 before the fifth."""
        out, h, at, n = [], self.heights, self.places, self.n
        shares = (self.p / 2, self.p, (1 + self.p) / 2)
        sign = 1.0 if self.fallback == "parity" else -1.0
        for x in values:
            n += 1
            if n <= 5:
                h.append(x)
                if n == 5:
                    h.sort()
                out.append(h[2] if n == 5 else 0.0)
                continue
            if x < h[0]:
                h[0], cell = x, 0
            elif x < h[1]:
                cell = 0
            elif x < h[2]:
                cell = 1
            elif x < h[3]:
                cell = 2
            else:
                cell = 3
                if x > h[4]:
                    h[4] = x
            at[4] += 1
            if cell < 3:
                at[3] += 1
                if cell < 2:
                    at[2] += 1
                    if cell < 1:
                        at[1] += 1
            for i in (1, 2, 3):
                lag = 1 + (n - 1) * shares[i - 1] - at[i]
                if -1 < lag < 1:
                    continue
                right, left = at[i + 1] - at[i], at[i] - at[i - 1]
                if lag >= 1 and right > 1:
                    step = 1
                elif lag <= -1 and left > 1:
                    step = -1
                else:
                    continue
                low, here, high = h[i - 1], h[i], h[i + 1]
                up, down = (high - here) / right, (here - low) / left
                moved = here + step / (right + left) * ((left + step) * up + (right - step) * down)
                if not low < moved < high:
                    moved = here + (up if step > 0 else sign * down)
                h[i] = moved
                at[i] += step
            out.append(h[2])
        self.n = n
        return out


class Quartiles:
    """Robust z by three P2 quantiles."""

    def __init__(self, fallback: str):
        self.parts = [P2(p, fallback) for p in (0.25, 0.5, 0.75)]

    def add(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """z of each value against the quartiles that include it, and the median; 0 before the fifth value or without spread."""
        values = x.tolist()
        low, middle, high = (np.array(q.add(values), float) for q in self.parts)
        spread = high - low
        return np.where(spread > TINY, (x - middle) * IQR_TO_SIGMA / np.maximum(spread, TINY), 0.0), middle


def ks_distance(a, b) -> float:
    """Largest distance between two empirical distributions; 0 if one is empty."""
    a, b = np.sort(np.asarray(a, float)), np.sort(np.asarray(b, float))
    if not len(a) or not len(b):
        return 0.0
    at = np.concatenate([a, b])
    return float(np.abs(np.searchsorted(a, at, "right") / len(a) - np.searchsorted(b, at, "right") / len(b)).max())


class Cusum:
    """Two sums that drift back towards zero; the one that passes h fires and starts anew."""

    def __init__(self, k: float, h: float):
        self.k, self.h, self.up, self.down = k, h, 0.0, 0.0

    def add(self, scores: list[float]) -> list[tuple[int, float]]:
        """Where it fires and how far the sum had come. A score that isn't a number starts both sums anew."""
        k, h, up, down, out = self.k, self.h, self.up, self.down, []
        for i, z in enumerate(scores):
            if z != z:
                up = down = 0.0
                continue
            up = max(0.0, up + z - k)
            down = min(0.0, down + z + k)
            if up > h:
                out.append((i, up))
                up = 0.0
            elif -down > h:
                out.append((i, down))
                down = 0.0
        self.up, self.down = up, down
        return out


class Returns:
    """A price's log returns against their own history, by session."""

    def __init__(self, params: Params):
        self.p, self.price, self.at, self.warm = params, math.nan, 0, 0
        self.base = Ewma(params.alpha, False)

    def add(self, price: np.ndarray, ts: np.ndarray) -> dict[str, np.ndarray]:
        """For each price: r, mean, mad and z of its return, whether it is scored, and whether a session broke before it.

        The first price, one after a gap and one after a price that isn't positive start a session: they have no
        return. A price that isn't positive has the return 0. The first returns of a session warm up unscored.
        """
        p, n = self.p, len(price)
        before, last = np.r_[self.price, price[:-1]], np.r_[self.at, ts[:-1]]
        known = ~np.isnan(before)
        fresh = ~known | (before <= 0) | (ts - last > int(p.session_gap * NS))
        good = ~fresh & (price > 0)
        r = np.zeros(n)
        r[good] = np.log(price[good] / before[good])
        rows = np.flatnonzero(~fresh)
        start, count = (self.base.mean, self.base.mad), self.base.n
        means, mads = self.base.add(r[rows])
        done = np.cumsum(~fresh)  # returns up to each price
        mean, mad = np.r_[start[0], means][done], np.r_[start[1], mads][done]
        began = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
        inside = began >= 0
        left = np.maximum(0, np.where(inside, p.warmup, self.warm) - (done - np.where(inside, done[began], 0)))
        if n:
            self.price, self.at, self.warm = float(price[-1]), int(ts[-1]), int(left[-1])
        return {"r": r, "mean": mean, "mad": mad, "z": robust_z(r, mean, mad), "scored": ~fresh & (left == 0) & (count + done >= p.min_obs), "broke": fresh & known}


    def mark(self) -> bytes:
        base = self.base
        return np.array([base.mean, base.mad, min(base.n, self.p.min_obs), self.price, self.warm]).tobytes() + np.int64(self.at).tobytes()


class Symbol:
    """One symbol's detectors, or those of some kinds alone."""

    def __init__(self, params: Params = LIBRARY, kinds: frozenset[str] | None = None):
        p = self.p = params
        self.kinds = frozenset(KINDS) if kinds is None or "burst" in kinds else frozenset(kinds)
        self.wanted = frozenset(KINDS if kinds is None else kinds)
        self.returns, self.cusum = Returns(p), Cusum(p.cusum_k, p.cusum_h)
        self.sizes, self.micro = Ewma(p.alpha, True), Ewma(p.alpha, True)
        self.short, self.ref, self.scored = np.zeros(0), deque(maxlen=p.regime_ref), 0
        self.regime_until = self.rate_until = 0
        self.spreads, self.rates = Quartiles(p.p2_fallback), Quartiles(p.p2_fallback)
        self.n_spreads = self.n_rates = 0
        self.extreme = False
        self.stamps = np.zeros(0, np.int64)
        self.bursts = Bursts(p)
        self.last = 0

    def run(self, is_quote: np.ndarray, ts: np.ndarray, price: np.ndarray, size: np.ndarray, bid: np.ndarray, ask: np.ndarray, bid_size: np.ndarray, ask_size: np.ndarray) -> list[Alert]:
        """Alerts of events in order. What isn't known is NaN: a trade without price and a quote without bid or ask are
        passed over, a missing size is no size."""
        if len(ts):
            self.last = int(ts[-1])
        known, value, priced = self._seen(is_quote, price, bid, ask)
        out: list[Alert] = []
        if self.kinds & _PRICE_KINDS:
            out += self._on_prices(priced, value, ts)
        if "volume_spike" in self.kinds:
            out += self._on_sizes(np.flatnonzero(known & ~is_quote & (size > 0)), price, size)
        quotes = np.flatnonzero(known & is_quote)
        if len(quotes):
            out += self._on_quotes(quotes, value[quotes], ts[quotes], bid[quotes], ask[quotes], bid_size[quotes], ask_size[quotes])
        out.sort(key=lambda a: a[:2])
        if "burst" in self.kinds:
            out = self._with_bursts(out, value, ts)
        return out if self.wanted == self.kinds else [a for a in out if a[2] in self.wanted]

    def _seen(self, is_quote, price, bid, ask) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which events aren't passed over, each one's price or middle, and the rows whose prices have returns."""
        known = ~np.where(is_quote, np.isnan(bid) | np.isnan(ask), np.isnan(price))
        value = np.where(is_quote, np.where(ask > 0, 0.5 * (bid + ask), 0.0), price)
        return known, value, np.flatnonzero(known & (~is_quote | (self.p.use_quote_mid & (value > 0))))

    def count_scored(self, is_quote: np.ndarray, ts: np.ndarray, price: np.ndarray, size: np.ndarray, bid: np.ndarray, ask: np.ndarray, *_: np.ndarray) -> int:
        """How many of the events' returns are scored."""
        _, value, rows = self._seen(is_quote, price, bid, ask)
        return int(self.returns.add(value[rows], ts[rows])["scored"].sum())

    def _on_prices(self, rows: np.ndarray, value: np.ndarray, ts: np.ndarray) -> list[Alert]:
        p, out = self.p, []
        x = self.returns.add(value[rows], ts[rows])
        price, r, z, scored = value[rows], x["r"], x["z"], x["scored"]
        if "cusum" in self.kinds:
            seen = np.flatnonzero(scored | x["broke"])
            for i, hit in self.cusum.add(np.where(x["broke"], math.nan, z)[seen].tolist()):
                k = seen[i]
                out.append((rows[k], 0, "cusum", price[k], hit, {"cusum_h": p.cusum_h, "cusum_k": p.cusum_k, "log_return": r[k], "z_in": z[k]}))
        if "robust_z" in self.kinds:
            for k in np.flatnonzero(scored & (np.abs(z) > p.z_thresh)):
                out.append((rows[k], 1, "robust_z", price[k], z[k], {"log_return": r[k], "baseline_mean": x["mean"][k], "baseline_mad": x["mad"][k], "z_threshold": p.z_thresh}))
        if "regime_shift" in self.kinds:
            at = np.flatnonzero(scored)
            for i, d in self._regimes(r[at], ts[rows[at]]):
                out.append((rows[at[i]], 2, "regime_shift", price[at[i]], d, {"ks_statistic": d, "ks_threshold": p.regime_ks, "short_window": p.regime_short, "ref_window": p.regime_ref}))
        return out

    def _regimes(self, r: np.ndarray, ts: np.ndarray) -> list[tuple[int, float]]:
        """Scored returns whose latest regime_short differ from every regime_stride-th before: looked at once both
        windows are full and every regime_check returns from then on, except while the last shift cools down."""
        p, out = self.p, []
        first = max(p.regime_check, p.regime_short, p.regime_stride * p.regime_ref)
        done, before = self.scored, len(self.short)
        both = np.concatenate([self.short, r])
        taken = done
        for n in range(done + 1 + (first - done - 1) % p.regime_check if done >= first else first, done + len(r) + 1, p.regime_check):
            new = range(-(-(taken + 1) // p.regime_stride) * p.regime_stride, n + 1, p.regime_stride)
            self.ref.extend(r[k - done - 1] for k in new)
            taken = n
            i = n - done - 1
            # where a symbol is taken up in the middle, only once both windows are full
            if ts[i] > self.regime_until and before + i + 1 >= p.regime_short and len(self.ref) == p.regime_ref:
                d = ks_distance(both[before + i + 1 - p.regime_short : before + i + 1], self.ref)
                if d > p.regime_ks:
                    self.regime_until = int(ts[i]) + int(p.regime_cooldown * NS)
                    out.append((i, d))
        self.scored = done + len(r)
        self.ref.extend(r[k - done - 1] for k in range(-(-(taken + 1) // p.regime_stride) * p.regime_stride, self.scored + 1, p.regime_stride))
        self.short = both[max(0, len(both) - p.regime_short) :]
        return out

    def _on_sizes(self, rows: np.ndarray, price: np.ndarray, size: np.ndarray) -> list[Alert]:
        p, x, n = self.p, np.log(size[rows]), self.sizes.n
        mean, mad = self.sizes.add(x)
        z = robust_z(x, mean, mad)
        out = []
        for k in np.flatnonzero((z > p.vol_z) & (n + 1 + np.arange(len(x)) >= p.min_obs)):
            usual, own = math.exp(mean[k]), size[rows[k]]
            out.append((rows[k], 3, "volume_spike", price[rows[k]], z[k], {"size": own, "baseline_mean_size": usual, "ratio_to_baseline": own / max(usual, TINY), "z_threshold": p.vol_z}))
        return out

    def _on_quotes(self, rows, mid, ts, bid, ask, bid_size, ask_size) -> list[Alert]:
        p, out = self.p, []

        def tell(k: int, kind: str, score: float, details: dict) -> None:
            out.append((rows[k], _ORDER[kind], kind, mid[k], score, details))

        if "crossed_book" in self.kinds:
            for k in np.flatnonzero((bid > ask) & (ask > 0)):
                tell(k, "crossed_book", bid[k] - ask[k], {"bid": bid[k], "ask": ask[k], "cross_amount": bid[k] - ask[k]})
        valid, sized = (ask > bid) & (bid > 0), (bid_size > 0) & (ask_size > 0)
        if "spread_widen" in self.kinds:
            at = np.flatnonzero(valid)
            bps = (ask[at] - bid[at]) / mid[at] * 1e4
            z, middle = self.spreads.add(bps)
            for i in np.flatnonzero((np.abs(z) > p.spread_z) & (self.n_spreads + 1 + np.arange(len(at)) >= p.min_obs)):
                k = at[i]
                tell(k, "spread_widen", z[i], {"spread_bps": bps[i], "baseline_bps": middle[i], "z_threshold": p.spread_z, "bid": bid[k], "ask": ask[k]})
            self.n_spreads += len(at)
        if "obi_extreme" in self.kinds:
            at = np.flatnonzero(sized)
            obi = (bid_size[at] - ask_size[at]) / (bid_size[at] + ask_size[at])
            high, low = np.abs(obi) > p.obi_extreme, np.abs(obi) < p.obi_rearm
            marks = np.maximum.accumulate(np.where(high | low, np.arange(1, len(at) + 1), 0))  # the latest mark's number; 0: one before
            latched = np.r_[self.extreme, np.where(marks > 0, high[marks - 1], self.extreme)] if len(at) else np.array([self.extreme])
            self.extreme = bool(latched[-1])
            for i in np.flatnonzero(high & ~latched[:-1]):
                k = at[i]
                tell(k, "obi_extreme", obi[i], {"obi": obi[i], "side": "bid" if obi[i] > 0 else "ask", "bid_size": bid_size[k], "ask_size": ask_size[k], "fire_threshold": p.obi_extreme, "rearm_threshold": p.obi_rearm})
        if "quote_rate_spike" in self.kinds:
            stamps, back = np.r_[self.stamps, ts], p.qrate_window - 1
            end = np.arange(len(ts)) + len(self.stamps)
            span = np.where(end >= back, ts - stamps[np.maximum(end - back, 0)], 0)
            self.stamps = stamps[max(0, len(stamps) - back) :]
            at = np.flatnonzero(span > 0)
            rate = p.qrate_window / (span[at] / NS)
            z, middle = self.rates.add(rate)
            for i in np.flatnonzero((z > p.qrate_z) & (self.n_rates + 1 + np.arange(len(at)) >= p.min_obs)):
                k = at[i]
                if ts[k] > self.rate_until:
                    self.rate_until = int(ts[k]) + int(p.qrate_cooldown * NS)
                    tell(k, "quote_rate_spike", z[i], {"rate_qps": rate[i], "baseline_qps": middle[i], "z_threshold": p.qrate_z, "cooldown_sec": p.qrate_cooldown})
            self.n_rates += len(at)
        if "microprice_drift" in self.kinds:
            at = np.flatnonzero(valid & sized)
            b, a, bs, az = bid[at], ask[at], bid_size[at], ask_size[at]
            drift = ((b * az + a * bs) / (bs + az) - mid[at]) / (a - b)
            n = self.micro.n
            mean, mad = self.micro.add(drift)
            z = robust_z(drift, mean, mad)
            for i in np.flatnonzero((np.abs(z) > p.micro_z) & (n + 1 + np.arange(len(at)) >= p.min_obs)):
                tell(at[i], "microprice_drift", z[i], {"drift": drift[i], "side": "ask" if drift[i] > 0 else "bid", "baseline_drift": mean[i], "z_threshold": p.micro_z})
        return out

    def _with_bursts(self, alerts: list[Alert], value: np.ndarray, ts: np.ndarray) -> list[Alert]:
        """Alerts with bursts after those of the event that completes one."""
        out, k = [], 0
        while k < len(alerts):
            i, first = alerts[k][0], k
            while k < len(alerts) and alerts[k][0] == i:
                k += 1
            out += alerts[first:k]
            burst = self.bursts.add(int(ts[i]), k - first)
            if burst:
                out.append((i, _ORDER["burst"], "burst", value[i], *burst))
        return out

    def mark(self) -> bytes:
        """What later events can tell of the events before: the same bytes for states with the same future."""
        p, kinds = self.p, self.kinds
        parts: list = []

        def mean(e: Ewma) -> None:
            parts.extend((e.mean, e.mad, float(e.n > 0), float(min(e.n, p.min_obs))))

        if kinds & _PRICE_KINDS:
            parts.append(np.frombuffer(self.returns.mark(), np.uint8))
        if "cusum" in kinds:
            parts += [self.cusum.up, self.cusum.down]
        if "regime_shift" in kinds:
            parts += [self.short, np.array(self.ref), np.int64(self.scored), np.int64(self.regime_until if self.regime_until >= self.last else 0)]
        for kind, e in (("volume_spike", self.sizes), ("microprice_drift", self.micro)):
            if kind in kinds:
                mean(e)
        if "obi_extreme" in kinds:
            parts.append(float(self.extreme))
        if kinds & MARKED:
            parts += [np.array([*q.heights, *q.places, q.n], float) for z in (self.spreads, self.rates) for q in z.parts]
            parts += [self.stamps, np.int64(self.rate_until if self.rate_until >= self.last else 0), np.int64(self.n_spreads), np.int64(self.n_rates)]
        if "burst" in kinds:
            parts.append(np.frombuffer(self.bursts.mark(self.last), np.uint8))
        return b"|".join(np.asarray(x).tobytes() for x in parts)


class Bursts:
    """Alerts within a window against their usual number."""

    def __init__(self, params: Params):
        self.p, self.usual, self.until = params, 0.0, 0
        self.recent: deque[int] = deque()

    def add(self, now: int, n: int) -> tuple[float, dict] | None:
        """Score and details of the burst that n alerts of one event complete, if they do."""
        p = self.p
        self.recent.extend([now] * n)
        while self.recent[0] < now - int(p.burst_window * NS):
            self.recent.popleft()
        inside = len(self.recent)
        self.usual = (1 - p.burst_alpha) * self.usual + p.burst_alpha * inside
        floor = max(self.usual, 1.0)
        if inside <= p.burst_k * floor or now <= self.until:
            return None
        self.until = now + int(p.burst_cooldown * NS)
        return inside / floor, {"intensity_ratio": inside / floor, "k_threshold": p.burst_k, "window_sec": p.burst_window, "alerts_in_window": inside}

    def mark(self, now: int) -> bytes:
        return np.float64(self.usual).tobytes() + np.int64(self.until if self.until >= now else 0).tobytes() + np.array(self.recent, np.int64).tobytes()


def json_of(details: dict) -> str:
    return json.dumps({a: b.item() if isinstance(b, np.generic) else b for a, b in details.items()})


def as_rows(symbol: str, ts: np.ndarray, seq: np.ndarray, alerts: list[Alert]) -> list[tuple]:
    """Alerts as rows of the alert schema, numbered within their event."""
    out, last, k = [], -1, 0
    for i, _, kind, price, score, details in alerts:
        k = k + 1 if i == last else 0
        last = i
        out.append((symbol, int(ts[i]), int(seq[i]), k, kind, float(price), float(score), json_of(details)))
    return out
