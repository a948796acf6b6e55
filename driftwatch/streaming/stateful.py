"""Detectors over a stream in the order of event time, with typed state, timers and recovery.

A symbol's events wait in state, by stretches of time, until the watermark has passed a stretch's end; a timer then hands
it to the detectors, sorted. So alerts don't depend on how events were dealt out into micro-batches, and equal those over a
table. A task holds one stretch of a symbol, however many of its events a micro-batch brings.

The state is columns, lists and a map with names and types of their own, kept by RocksDB in Avro, so that later versions
may add fields to it; what detectors remember is read and written once a stretch.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from driftwatch.operators.kernels import LIBRARY, Ewma, Params, Symbol, as_rows
from driftwatch.schemas import ALERT

VALUES = ("price", "size", "bid", "ask", "bid_size", "ask_size")
SCALARS = (
    "price double, at bigint, warm bigint, mean double, mad double, n bigint, up double, down double, size_mean double, size_mad double, size_n bigint, "
    "micro_mean double, micro_mad double, micro_n bigint, scored bigint, regime_until bigint, rate_until bigint, burst_until bigint, usual double, "
    "n_spreads bigint, n_rates bigint, extreme boolean, last bigint"
)
ROWS = "ts array<bigint>, seq array<bigint>, quote array<boolean>, " + ", ".join(f"{v} array<double>" for v in VALUES)


#: What transformWithState asks of the session while a query starts. Other stateful operators don't take Avro.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.encodingFormat": "avro",
}


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB for the queries that start within; the session's own settings are put back."""
    before = {key: spark.conf.get(key, None) for key in STATE_STORE}
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def scalars_of(s: Symbol) -> tuple:
    r = s.returns
    ewma = lambda e: (float(e.mean), float(e.mad), int(e.n))
    return (
        float(r.price), int(r.at), int(r.warm), *ewma(r.base), float(s.cusum.up), float(s.cusum.down), *ewma(s.sizes), *ewma(s.micro), int(s.scored),
        int(s.regime_until), int(s.rate_until), int(s.bursts.until), float(s.bursts.usual), int(s.n_spreads), int(s.n_rates), bool(s.extreme), int(s.last),
    )


def with_scalars(s: Symbol, x: tuple) -> None:
    def fill(e: Ewma, mean: float, mad: float, n: int) -> None:
        e.mean, e.mad, e.n = mean, mad, n

    s.returns.price, s.returns.at, s.returns.warm = x[0], x[1], x[2]
    fill(s.returns.base, *x[3:6])
    s.cusum.up, s.cusum.down = x[6], x[7]
    fill(s.sizes, *x[8:11])
    fill(s.micro, *x[11:14])
    s.scored, s.regime_until, s.rate_until, s.bursts.until, s.bursts.usual, s.n_spreads, s.n_rates, s.extreme, s.last = x[14:]


class Detectors(StatefulProcessor):
    """One symbol's events in, alerts out."""

    def __init__(self, params: Params, stretch_sec: int):
        self.params, self.size = params, stretch_sec * 1_000_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scalars = handle.getValueState("scalars", SCALARS)
        self.lists = {name: handle.getListState(name, f"x {kind}") for name, kind in (("short", "double"), ("reference", "double"), ("stamps", "bigint"), ("recent", "bigint"))}
        self.markers = handle.getMapState("markers", "name string", "heights array<double>, places array<bigint>, n bigint")
        self.waiting = handle.getMapState("waiting", "stretch bigint", ROWS)

    def _load(self) -> Symbol:
        s = Symbol(self.params)
        if self.scalars.exists():
            with_scalars(s, self.scalars.get())
            held = {name: [x[0] for x in state.get()] for name, state in self.lists.items()}
            s.short, s.stamps = np.array(held["short"], float), np.array(held["stamps"], np.int64)
            s.ref.extend(held["reference"])
            s.bursts.recent = deque(held["recent"])
            for name, q in self._quantiles(s):
                if self.markers.containsKey((name,)):
                    heights, places, n = self.markers.getValue((name,))
                    q.heights, q.places, q.n = list(heights), list(places), n
        return s

    def _store(self, s: Symbol) -> None:
        self.scalars.update(scalars_of(s))
        for name, values in (("short", s.short.tolist()), ("reference", map(float, s.ref)), ("stamps", s.stamps.tolist()), ("recent", s.bursts.recent)):
            rows = [(x,) for x in values]
            self.lists[name].put(rows) if rows else self.lists[name].clear()
        for name, q in self._quantiles(s):
            if q.n:
                self.markers.updateValue((name,), ([float(h) for h in q.heights], [int(p) for p in q.places], int(q.n)))

    @staticmethod
    def _quantiles(s: Symbol) -> Iterator[tuple[str, Any]]:
        for name, z in (("spread", s.spreads), ("rate", s.rates)):
            for q in z.parts:
                yield f"{name} {q.p}", q

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for stretch, own in frame.groupby(frame["ts_ns"] // self.size, sort=True):
                at = (int(stretch),)
                new = [own["ts_ns"].tolist(), own["seq"].tolist(), (own["etype"] == "q").tolist(), *(pd.to_numeric(own[v]).astype(float).tolist() for v in VALUES)]
                if self.waiting.containsKey(at):
                    new = [[*a, *b] for a, b in zip(self.waiting.getValue(at), new)]
                else:
                    self.handle.registerTimer((at[0] + 1) * self.size // 1_000_000)
                self.waiting.updateValue(at, tuple(new))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() * 1_000_000
        due = sorted(k[0] for k in self.waiting.keys() if (k[0] + 1) * self.size <= until)
        if due:
            symbol = self._load()
            for stretch in due:
                ts, seq, quote, *values = (np.array(c) for c in self.waiting.getValue((stretch,)))
                order = np.lexsort((seq, ts))
                ts, seq = ts[order].astype(np.int64), seq[order].astype(np.int64)
                found = symbol.run(quote[order].astype(bool), ts, *(np.array(v, float)[order] for v in values))
                self.waiting.removeKey((stretch,))
                names = [part.split()[0] for part in ALERT.split(", ")]
                yield pd.DataFrame(as_rows(key[0], ts, seq, found), columns=names).astype({"ts_ns": "int64", "seq": "int64", "ord": "int32", "price": "float64", "score": "float64"})
            self._store(symbol)

    def close(self) -> None:
        pass


def detect_in_event_time(events: DataFrame, params: Params = LIBRARY, delay_sec: int = 60, stretch_sec: int = 60) -> DataFrame:
    """Alerts of a stream of events, as detect gives them over a table of the same events.

    An event is waited for until another one came that is delay_sec later; what comes later still is left out and counted
    in the query's progress (numRowsDroppedByWatermark). Alerts come once the watermark has passed the end of their stretch
    of stretch_sec. Null symbols are left out. Start the query within rocksdb(spark).
    """
    timed = events.where("symbol is not null").withColumn("event_time", F.timestamp_micros(F.expr("ts_ns div 1000"))).withWatermark("event_time", f"{delay_sec} seconds")
    return timed.groupBy("symbol").transformWithStateInPandas(Detectors(params, stretch_sec), ALERT, "append", "eventTime")
