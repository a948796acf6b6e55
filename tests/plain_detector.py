"""One symbol's detectors event by event, to test those that take arrays against."""

from __future__ import annotations

import math
from collections import deque

from driftwatch.functions.scalar import IQR_TO_SIGMA, MAD_TO_SIGMA
from driftwatch.operators.kernels import LIBRARY, Params, ks_distance

TINY, NS = 1e-12, 1_000_000_000


class Ewma:
    """Exponentially weighted mean, and mean absolute deviation from it. ``primed``: the first value is the mean."""

    __slots__ = ("alpha", "primed", "mean", "mad", "n")

    def __init__(self, alpha: float, primed: bool):
        self.alpha, self.primed, self.mean, self.mad, self.n = alpha, primed, 0.0, 0.0, 0

    def add(self, x: float) -> None:
        self.n += 1
        if self.primed and self.n == 1:
            self.mean = x
            return
        keep = 1 - self.alpha
        self.mean = keep * self.mean + self.alpha * x
        self.mad = keep * self.mad + self.alpha * abs(x - self.mean)

    def z(self, x: float) -> float:
        return (x - self.mean) / (MAD_TO_SIGMA * self.mad) if self.mad > TINY else 0.0


class P2:
    """A quantile by five moving markers (Jain and Chlamtac, 1985)."""

    __slots__ = ("p", "fallback", "heights", "places", "n")

    def __init__(self, p: float, fallback: str = "parity"):
        self.p, self.fallback, self.n = p, fallback, 0
        self.heights: list[float] = []
        self.places = [1, 2, 3, 4, 5]

    @property
    def ready(self) -> bool:
        return self.n >= 5

    @property
    def value(self) -> float:
        return self.heights[2] if self.ready else 0.0

    def add(self, x: float) -> None:
        self.n += 1
        h, at = self.heights, self.places
        if self.n <= 5:
            h.append(x)
            if self.n == 5:
                h.sort()
            return
        cell = next((c for c, m in enumerate(h[1:4]) if x < m), 3) if x >= h[0] else 0
        h[0], h[4] = min(h[0], x), max(h[4], x)
        for i in range(cell + 1, 5):
            at[i] += 1
        for i in (1, 2, 3):
            share = (self.p / 2, self.p, (1 + self.p) / 2)[i - 1]
            lag = 1 + (self.n - 1) * share - at[i]
            right, left = at[i + 1] - at[i], at[i] - at[i - 1]
            if lag >= 1 and right > 1:
                step = 1
            elif lag <= -1 and left > 1:
                step = -1
            else:
                continue
            up, down = (h[i + 1] - h[i]) / right, (h[i] - h[i - 1]) / left
            moved = h[i] + step / (right + left) * ((left + step) * up + (right - step) * down)
            if not h[i - 1] < moved < h[i + 1]:
                moved = h[i] + (up if step > 0 else down if self.fallback == "parity" else -down)
            h[i] = moved
            at[i] += step


class Quartiles:
    """Robust z by three P2 quantiles."""

    __slots__ = ("low", "middle", "high")

    def __init__(self, fallback: str):
        self.low, self.middle, self.high = (P2(p, fallback) for p in (0.25, 0.5, 0.75))

    def add(self, x: float) -> None:
        for q in (self.low, self.middle, self.high):
            q.add(x)

    @property
    def scale(self) -> float:
        return (self.high.value - self.low.value) / IQR_TO_SIGMA if self.middle.ready else 0.0

    def z(self, x: float) -> float:
        return (x - self.middle.value) / self.scale if self.scale * IQR_TO_SIGMA > TINY else 0.0


class Symbol:
    """One symbol's detectors. An event gives a list of (kind, price, score, details), in the order of the detectors."""

    def __init__(self, params: Params = LIBRARY):
        p = self.p = params
        self.price, self.at, self.warm = None, 0, 0
        self.base, self.sizes, self.micro = Ewma(p.alpha, False), Ewma(p.alpha, True), Ewma(p.alpha, True)
        self.up = self.down = 0.0
        self.short, self.ref = deque(maxlen=p.regime_short), deque(maxlen=p.regime_ref)
        self.stride = self.since = 0
        self.regime_until = self.rate_until = self.burst_until = 0
        self.spreads, self.rates = Quartiles(p.p2_fallback), Quartiles(p.p2_fallback)
        self.n_spreads = self.n_rates = 0
        self.extreme = False
        self.stamps: deque[int] = deque(maxlen=p.qrate_window)
        self.recent: deque[int] = deque()
        self.usual = 0.0

    def _score(self, price: float, ts: int) -> tuple[float, float] | None:
        """Return and z of a price, or None if it isn't scored: the first, after a gap, or while warming up."""
        p, before, gap = self.p, self.price, ts - self.at > int(self.p.session_gap * NS)
        self.price, self.at = price, ts
        if before is None or before <= 0 or gap:
            self.warm = p.warmup
            if before is not None:
                self.up = self.down = 0.0
            return None
        r = math.log(price / before) if price > 0 else 0.0
        self.base.add(r)
        self.warm = max(0, self.warm - 1)
        if self.warm or self.base.n < p.min_obs:
            return None
        return r, self.base.z(r)

    def _cusum(self, z: float) -> float:
        self.up, self.down = max(0.0, self.up + z - self.p.cusum_k), min(0.0, self.down + z + self.p.cusum_k)
        hit = 0.0
        if self.up > self.p.cusum_h:
            hit, self.up = self.up, 0.0
        elif -self.down > self.p.cusum_h:
            hit, self.down = self.down, 0.0
        return hit

    def _regime(self, r: float, ts: int) -> float | None:
        p = self.p
        self.short.append(r)
        self.stride = (self.stride + 1) % p.regime_stride
        if not self.stride:
            self.ref.append(r)
        self.since += 1
        if self.since < p.regime_check or len(self.short) < p.regime_short or len(self.ref) < p.regime_ref:
            return None
        self.since = 0
        if ts <= self.regime_until:
            return None
        d = ks_distance(self.short, self.ref)
        if d <= p.regime_ks:
            return None
        self.regime_until = ts + int(p.regime_cooldown * NS)
        return d

    def _on_price(self, price: float, ts: int) -> list[tuple]:
        p, out = self.p, []
        scored = self._score(price, ts)
        if scored is None:
            return out
        r, z = scored
        if hit := self._cusum(z):
            out.append(("cusum", price, hit, {"cusum_h": p.cusum_h, "cusum_k": p.cusum_k, "log_return": r, "z_in": z}))
        if abs(z) > p.z_thresh:
            out.append(("robust_z", price, z, {"log_return": r, "baseline_mean": self.base.mean, "baseline_mad": self.base.mad, "z_threshold": p.z_thresh}))
        if (d := self._regime(r, ts)) is not None:
            out.append(("regime_shift", price, d, {"ks_statistic": d, "ks_threshold": p.regime_ks, "short_window": p.regime_short, "ref_window": p.regime_ref}))
        return out

    def _burst(self, out: list[tuple], price: float, ts: int) -> list[tuple]:
        if not out:
            return out
        p = self.p
        self.recent.extend([ts] * len(out))
        while self.recent and self.recent[0] < ts - int(p.burst_window * NS):
            self.recent.popleft()
        n = len(self.recent)
        self.usual = (1 - p.burst_alpha) * self.usual + p.burst_alpha * n
        floor = max(self.usual, 1.0)
        if n > p.burst_k * floor and ts > self.burst_until:
            self.burst_until = ts + int(p.burst_cooldown * NS)
            out.append(("burst", price, n / floor, {"intensity_ratio": n / floor, "k_threshold": p.burst_k, "window_sec": p.burst_window, "alerts_in_window": n}))
        return out

    def on_tick(self, price: float, ts: int, size: float = 0.0) -> list[tuple]:
        p, out = self.p, self._on_price(price, ts)
        if size > 0:
            x = math.log(size)
            self.sizes.add(x)
            z = self.sizes.z(x)
            if self.sizes.n >= p.min_obs and z > p.vol_z:
                usual = math.exp(self.sizes.mean)
                out.append(("volume_spike", price, z, {"size": size, "baseline_mean_size": usual, "ratio_to_baseline": size / max(usual, TINY), "z_threshold": p.vol_z}))
        return self._burst(out, price, ts)

    def on_quote(self, bid: float, ask: float, bid_size: float, ask_size: float, ts: int) -> list[tuple]:
        p = self.p
        mid = 0.5 * (bid + ask) if ask > 0 else 0.0
        out = self._on_price(mid, ts) if p.use_quote_mid and mid > 0 else []
        if bid > ask > 0:
            out.append(("crossed_book", mid, bid - ask, {"bid": bid, "ask": ask, "cross_amount": bid - ask}))
        valid = ask > bid > 0
        if valid:
            bps = (ask - bid) / mid * 1e4
            self.spreads.add(bps)
            self.n_spreads += 1
            z = self.spreads.z(bps)
            if self.n_spreads >= p.min_obs and abs(z) > p.spread_z:
                out.append(("spread_widen", mid, z, {"spread_bps": bps, "baseline_bps": self.spreads.middle.value, "z_threshold": p.spread_z, "bid": bid, "ask": ask}))
        sized = bid_size > 0 and ask_size > 0
        if sized:
            obi = (bid_size - ask_size) / (bid_size + ask_size)
            if abs(obi) > p.obi_extreme and not self.extreme:
                self.extreme = True
                side = "bid" if obi > 0 else "ask"
                out.append(("obi_extreme", mid, obi, {"obi": obi, "side": side, "bid_size": bid_size, "ask_size": ask_size, "fire_threshold": p.obi_extreme, "rearm_threshold": p.obi_rearm}))
            elif abs(obi) < p.obi_rearm:
                self.extreme = False
        self.stamps.append(ts)
        span = ts - self.stamps[0]
        if len(self.stamps) == p.qrate_window and span > 0:
            rate = p.qrate_window / (span / NS)
            self.rates.add(rate)
            self.n_rates += 1
            z = self.rates.z(rate)
            if self.n_rates >= p.min_obs and ts > self.rate_until and z > p.qrate_z:
                self.rate_until = ts + int(p.qrate_cooldown * NS)
                out.append(("quote_rate_spike", mid, z, {"rate_qps": rate, "baseline_qps": self.rates.middle.value, "z_threshold": p.qrate_z, "cooldown_sec": p.qrate_cooldown}))
        if valid and sized:
            drift = ((bid * ask_size + ask * bid_size) / (bid_size + ask_size) - mid) / (ask - bid)
            self.micro.add(drift)
            z = self.micro.z(drift)
            if self.micro.n >= p.min_obs and abs(z) > p.micro_z:
                out.append(("microprice_drift", mid, z, {"drift": drift, "side": "ask" if drift > 0 else "bid", "baseline_drift": self.micro.mean, "z_threshold": p.micro_z}))
        return self._burst(out, mid, ts)

    def on_event(self, is_quote, ts, price, size, bid, ask, bid_size, ask_size) -> list[tuple]:
        """None and NaN are what isn't known."""
        number = lambda x: None if x is None or x != x else x
        if is_quote:
            ends = number(bid), number(ask)
            return [] if None in ends else self.on_quote(*ends, number(bid_size) or 0.0, number(ask_size) or 0.0, ts)
        return [] if number(price) is None else self.on_tick(price, ts, number(size) or 0.0)
