"""The detectors over tables: events dealt out by symbol, sorted, and fed to each symbol's small state in a stream.

A task never holds a symbol's events, only its state and a batch, so a symbol may have any number of rows. A hot symbol is
cut by time into pieces that run side by side and give what one run would, to the last digit (pieces.py). Only quantile
markers (spread_widen, quote_rate_spike, p2_quantiles) remember all events and take each symbol in one piece.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.functions.scalar import microprice_drift, mid
from driftwatch.operators.kernels import KINDS, LIBRARY, MARKED, P2, Bursts, Cusum, Ewma, Params, Returns, Symbol, as_rows, json_of, robust_z
from driftwatch.operators.pieces import ARROW, PIECE_ROWS, Fold, Pieces, cut, fold_pieces, kept, small
from driftwatch.schemas import ALERT

#: What a symbol's state makes of a run of its rows: columns of the output, or None.
Step = Callable[[str, list[np.ndarray]], list | None]


def in_order(rows: DataFrame, fresh: Callable[[str], Step], schema: str) -> DataFrame:
    """What a step makes of the rows of each symbol in the order of (ts_ns, seq), run by run. Each symbol has a step of
    its own, made by fresh. The columns after symbol come as arrays, nulls as NaN."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = [c for c in rows.columns if c != "symbol"]
    dealt = rows.repartition(parts, "symbol").sortWithinPartitions("symbol", "ts_ns", "seq").select("symbol", *values)
    fields = [tuple(f.split()) for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, own = object(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).to_pylist()
            arrays = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
            start = 0
            while start < len(names):
                end = start + 1
                while end < len(names) and names[end] == names[start]:
                    end += 1
                if names[start] != symbol or own is None:
                    symbol, own = names[start], fresh(names[start])
                columns = own(symbol, [c[start:end] for c in arrays])
                if columns is not None and len(columns[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, ARROW[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])
                start = end

    return dealt.mapInArrow(run, schema)


def folded(rows: DataFrame, fresh: Callable[[str, int], Fold], schema: str, lead_rows: int, piece_rows: int | None) -> DataFrame:
    """As in_order, but hot symbols are cut into pieces, each led by lead_rows rows at least."""
    pieces = cut(rows, piece_rows or PIECE_ROWS, lead_rows)
    return in_order(rows, lambda symbol: fresh(symbol, 0), schema) if pieces is None else fold_pieces(pieces, fresh, schema)


def remembered(params: Params) -> int:
    """Rows after which an EWMA mean and the deviation from it stand, as a rule, where any other start would have brought them."""
    return 4 * math.ceil(math.log(1e-18) / math.log(1 - params.alpha))


class Alerts:
    """A symbol's detectors as a fold."""

    def __init__(self, params: Params, kinds: frozenset[str] | None, scored: int = 0):
        self.state = Symbol(params, kinds)
        self.state.scored = scored

    def __call__(self, symbol: str, columns: list[np.ndarray]) -> list | None:
        ts, seq, etype, *values = columns
        found = as_rows(symbol, ts, seq, self.state.run(etype == "q", ts, *values))
        return list(zip(*found)) or None

    def mark(self) -> bytes:
        return self.state.mark()


class Scored:
    """How many returns of a run of rows are scored."""

    def __init__(self, params: Params):
        self.state = Symbol(params, frozenset())

    def __call__(self, symbol: str, columns: list[np.ndarray]) -> int:
        ts, _, etype, *values = columns
        return self.state.count_scored(etype == "q", ts, *values)


def _numbered(pieces: Pieces, params: Params) -> Pieces:
    """Gives each piece, as _number, how many of the symbol's returns are scored before its lead's first row."""
    columns = ["symbol", "_piece", "_own", "ts_ns", "seq", "etype", "price", "size", "bid", "ask", "bid_size", "ask_size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fold = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            names, piece, own = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            edges = [0, *(np.flatnonzero((names[1:] != names[:-1]) | (piece[1:] != piece[:-1]) | (own[1:] != own[:-1])) + 1).tolist(), len(names)]
            arrays = [c.to_numpy(zero_copy_only=False) for c in batch.columns[3:]]
            found = []
            for a, b in zip(edges, edges[1:]):
                if (names[a], piece[a]) != key:
                    key, fold = (names[a], piece[a]), Scored(params)
                found.append((names[a], int(piece[a]), bool(own[a]), fold(names[a], [c[a:b] for c in arrays])))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["symbol", "_piece", "_own", "n"])

    ordered = pieces.rows.select(*columns).repartition(pieces.tasks, "symbol", "_piece").sortWithinPartitions("symbol", "_piece", "ts_ns", "seq")
    inside = lambda where: F.sum(F.when(where, F.col("n")).otherwise(0))
    counts = ordered.mapInArrow(run, "symbol string, _piece bigint, _own boolean, n bigint").groupBy("symbol", "_piece").agg(inside(F.col("_own")).alias("own"), inside(~F.col("_own")).alias("lead"))
    before = Window.partitionBy("symbol").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # a row a piece
    numbers = kept(counts.select("symbol", "_piece", (F.coalesce(F.sum("own").over(before), F.lit(0)) - F.col("lead")).alias("_number")))
    return Pieces(pieces.rows.join(small(numbers), ["symbol", "_piece"]), pieces.tasks)


class AlertCounts:
    """Bursts of a symbol's alerts, events' alerts being counted."""

    def __init__(self, params: Params):
        self.state, self.last = Bursts(params), 0

    def __call__(self, symbol: str, columns: list[np.ndarray]) -> list | None:
        ts, seq, n, price = columns
        out = []
        for t, s, k, p in zip(ts.tolist(), seq.tolist(), n.tolist(), price.tolist()):
            burst = self.state.add(t, k)
            if burst:
                out.append((symbol, t, s, 0, "burst", p, burst[0], json_of(burst[1])))
        self.last = int(ts[-1])
        return list(zip(*out)) or None

    def mark(self) -> bytes:
        return self.state.mark(self.last)


def detect(events: DataFrame, params: Params = LIBRARY, overrides: dict[str, float] | None = None, kinds: Iterable[str] | None = None, piece_rows: int | None = None) -> DataFrame:
    """All alerts of a stream of trades and quotes, or those of some kinds, whose detectors alone then run.

    overrides: another z threshold for some symbols. A trade without a price, and a quote without bid or ask, are passed
    over; what follows a price that isn't positive is a session's first tick. (ts_ns, seq) tells a symbol's events apart.
    Where hot symbols are cut, their pieces run when this is called.
    """
    wanted = frozenset(KINDS if kinds is None else kinds)
    used = frozenset(KINDS) if "burst" in wanted else wanted
    own = lambda symbol: replace(params, z_thresh=(overrides or {}).get(symbol, params.z_thresh))
    rows = events.select("symbol", "ts_ns", "seq", "etype", "price", "size", "bid", "ask", "bid_size", "ask_size")
    forgetful = used - MARKED - {"burst"}
    regimes = "regime_shift" in forgetful
    lead = max(2 * remembered(params), int(1.4 * params.regime_stride * params.regime_ref) if regimes else 0)
    pieces = cut(rows, max(piece_rows or PIECE_ROWS, lead), lead) if forgetful else None
    if pieces is None:
        return in_order(rows, lambda symbol: Alerts(own(symbol), wanted), ALERT)
    found = fold_pieces(_numbered(pieces, params) if regimes else pieces, lambda symbol, scored: Alerts(own(symbol), forgetful, scored), ALERT)
    if used & MARKED:
        found = found.unionByName(in_order(rows, lambda symbol: Alerts(own(symbol), used & MARKED), ALERT))
    if "burst" in wanted:
        counts = found.groupBy("symbol", "ts_ns", "seq").agg(F.count("*").alias("n"), F.max("price").alias("price"))
        bursts = folded(counts, lambda symbol, _: AlertCounts(params), ALERT, math.ceil(50 / params.burst_alpha), piece_rows)
        found = found.unionByName(bursts)
    of_event = Window.partitionBy("symbol", "ts_ns", "seq").orderBy(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")))
    return found.where(F.col("kind").isin(*wanted)).withColumn("ord", F.row_number().over(of_event) - 1)


def from_ticks(ticks: DataFrame, sizes: bool = False) -> DataFrame:
    """Ticks as a stream of events, without sizes unless they are asked for."""
    none = [F.lit(None).cast("double").alias(c) for c in ("bid", "ask", "bid_size", "ask_size")]
    return ticks.select("symbol", "ts_ns", "seq", F.lit("t").alias("etype"), "price", (F.col("size") if sizes else F.lit(0.0)).alias("size"), *none)


def from_quotes(quotes: DataFrame) -> DataFrame:
    none = [F.lit(None).cast("double").alias(c) for c in ("price", "size")]
    return quotes.select("symbol", "ts_ns", "seq", F.lit("q").alias("etype"), *none, "bid", "ask", "bid_size", "ask_size")


class PriceScores:
    def __init__(self, params: Params):
        self.state = Returns(params)

    def __call__(self, symbol: str, columns: list[np.ndarray]) -> list:
        ts, seq, price = columns
        x = self.state.add(price, ts)
        hidden = ~x["scored"]
        return [[symbol] * len(ts), ts, seq, x["mean"], x["mad"], pa.array(x["r"], mask=hidden), pa.array(x["z"], mask=hidden)]

    def mark(self) -> bytes:
        return self.state.mark()


def price_scores(ticks: DataFrame, params: Params = LIBRARY, piece_rows: int | None = None) -> DataFrame:
    """What the price detector knows after each tick: mean, mad, and r and z where the tick is scored. Ticks without a price are left out."""
    rows = ticks.where("price is not null").select("symbol", "ts_ns", "seq", "price")
    schema = "symbol string, ts_ns bigint, seq bigint, mean double, mad double, r double, z double"
    return folded(rows, lambda symbol, _: PriceScores(params), schema, max(params.min_obs, remembered(params)), piece_rows)


def robust_z_alerts(ticks: DataFrame, params: Params = LIBRARY) -> DataFrame:
    """symbol, ts_ns, seq, z of ticks whose return's z exceeds the threshold, as detect gives them."""
    return price_scores(ticks, params).where(F.abs("z") > params.z_thresh).select("symbol", "ts_ns", "seq", "z")


class Thresholds:
    """Counts of the alerts of each threshold, in one pass: z depends on none of them, and each h has a CUSUM."""

    def __init__(self, params: Params, z_grid: list[float], h_grid: list[float]):
        self.state, self.sums = Returns(params), [Cusum(params.cusum_k, h) for h in h_grid]
        self.z_grid, self.h_grid = z_grid, h_grid

    def __call__(self, symbol: str, columns: list[np.ndarray]) -> list:
        ts, _, price = columns
        x = self.state.add(price, ts)
        size = np.abs(x["z"][x["scored"]])
        seen = np.where(x["broke"], np.nan, x["z"])[x["scored"] | x["broke"]].tolist()
        hits = [[abs(hit) for _, hit in s.add(seen)] for s in self.sums]
        over = [size[size > z] for z in self.z_grid]
        kinds = ["z"] * len(over) + ["h"] * len(hits) + ["ticks"]
        most = [max(v, default=0.0) for v in (*(o.tolist() for o in over), *hits, [])]
        return [kinds, [*self.z_grid, *self.h_grid, 0.0], [*map(len, over), *map(len, hits), len(ts)], most]

    def mark(self) -> bytes:
        return self.state.mark() + np.array([(c.up, c.down) for c in self.sums]).tobytes()


def sweep(ticks: DataFrame, z_grid: list[float], h_grid: list[float], params: Params = LIBRARY, piece_rows: int | None = None) -> DataFrame:
    """Alerts of each pair of thresholds. A task hands on its counts alone."""
    rows = ticks.where("price is not null").select("symbol", "ts_ns", "seq", "price")
    found = folded(rows, lambda symbol, _: Thresholds(params, z_grid, h_grid), "kind string, x double, n bigint, m double", max(params.min_obs, 2 * remembered(params)), piece_rows)
    counts = found.groupBy("kind", "x").agg(F.sum("n").alias("n"), F.max("m").alias("m"))
    of = lambda kind, x, n, m: counts.where(F.col("kind") == kind).select(F.col("x").alias(x), F.col("n").alias(n), F.col("m").alias(m))
    grid = of("z", "z_thresh", "z_alerts", "mz").join(of("h", "cusum_h", "cusum_alerts", "mh"), F.lit(True)).join(of("ticks", "_x", "ticks", "_m"), F.lit(True))  # some tens of rows
    n = F.col("z_alerts") + F.col("cusum_alerts")
    return grid.select("z_thresh", "cusum_h", "z_alerts", "cusum_alerts", (n / F.col("ticks") * 100).alias("pct_ticks"), F.greatest("mz", "mh").alias("max_abs_score"))


class Deviations:
    def __init__(self, params: Params):
        self.state, self.min_obs = Ewma(params.alpha, True), params.min_obs

    def __call__(self, symbol: str, columns: list[np.ndarray]) -> list:
        ts, seq, x = columns
        early = self.state.n + 1 + np.arange(len(x)) < self.min_obs
        return [[symbol] * len(ts), ts, seq, x, pa.array(robust_z(x, *self.state.add(x)), mask=early)]

    def mark(self) -> bytes:
        return np.array([self.state.mean, self.state.mad, self.state.n > 0, min(self.state.n, self.min_obs)]).tobytes()


def ewma_scores(rows: DataFrame, value: str, params: Params = LIBRARY, piece_rows: int | None = None) -> DataFrame:
    """z of a value against its symbol's EWMA mean and deviation, which begin at the first value and include it; null
    before the min_obs-th. Nulls are skipped."""
    own = rows.where(F.col(value).isNotNull()).select("symbol", "ts_ns", "seq", F.col(value).alias("x"))
    return folded(own, lambda symbol, _: Deviations(params), "symbol string, ts_ns bigint, seq bigint, x double, z double", max(params.min_obs, remembered(params)), piece_rows)


def volume_spikes(ticks: DataFrame, params: Params = LIBRARY) -> DataFrame:
    sized = ticks.where("size > 0").withColumn("log_size", F.log("size"))
    return ewma_scores(sized, "log_size", params).where(F.col("z") > params.vol_z)


def microprice_drifts(quotes: DataFrame, params: Params = LIBRARY) -> DataFrame:
    return ewma_scores(quotes.withColumn("drift", microprice_drift()), "drift", params).where(F.abs("z") > params.micro_z)


def p2_quantiles(ticks: DataFrame, value: str, shares: tuple[float, ...] = (0.25, 0.5, 0.75), fallback: str = "parity") -> DataFrame:
    """Streaming quantiles of a value by symbol, as they stand after its last row. Nulls are skipped."""

    def fresh(symbol: str) -> Step:
        states = [P2(p, fallback) for p in shares]

        def own(symbol: str, columns: list[np.ndarray]) -> list:
            values = columns[2].tolist()
            return [[symbol], [states[0].n + len(values)], *([s.add(values)[-1]] for s in states)]

        return own

    names = [f"q{round(p * 100)}" for p in shares]
    rows = in_order(ticks.where(F.col(value).isNotNull()).select("symbol", "ts_ns", "seq", F.col(value).cast("double").alias("x")), fresh, "symbol string, n bigint, " + ", ".join(f"{n} double" for n in names))
    return rows.groupBy("symbol").agg(F.max("n").alias("n"), *(F.max_by(n, "n").alias(n) for n in names))


def crossed_books(quotes: DataFrame) -> DataFrame:
    return quotes.where("bid > ask and ask > 0").select("symbol", "ts_ns", "seq", mid().alias("price"), (F.col("bid") - F.col("ask")).alias("score"))
