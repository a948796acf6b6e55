"""What an operator may change while a stream runs: its symbols, thresholds and whether it is active, read anew for each
micro-batch; and a view of the settings in force."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.operators.control import reconcile
from driftwatch.operators.kernels import LIBRARY, Params

#: The most symbols of a list; a longer one is taken for a mistake.
MOST_SYMBOLS = 100_000


class Watchlist:
    """The symbols that a stream lets through. poll reads them from wherever they are kept.

    A poll that fails, or gives no symbols (unless allow_empty), keeps the symbols of the one before. Symbols are trimmed
    and in upper case, blank and null ones don't count.
    """

    def __init__(self, spark: SparkSession, read: Callable[[], DataFrame], start: tuple[str, ...] = (), allow_empty: bool = False):
        self.spark, self.read, self.allow_empty = spark, read, allow_empty
        self.symbols: tuple[str, ...] = tuple(sorted(start))
        #: What the last poll changed, and why it failed, if it did.
        self.added: list[str] = []
        self.removed: list[str] = []
        self.error: str | None = None

    def _table(self) -> DataFrame:
        return self.spark.createDataFrame([(s,) for s in self.symbols], "symbol string")

    def poll(self) -> None:
        self.added, self.removed, self.error = [], [], None
        try:
            changes = reconcile(self.read(), self._table(), self.allow_empty).limit(MOST_SYMBOLS + 1).collect()
            if len(changes) > MOST_SYMBOLS:
                raise ValueError(f"more than {MOST_SYMBOLS} changes")
        except Exception as e:  # whatever the list's keeper does, the stream goes on with what it has
            self.error = f"{type(e).__name__}: {e}"
            return
        self.added, self.removed = (sorted(r.symbol for r in changes if r.change == c) for c in ("add", "remove"))
        self.symbols = tuple(sorted((set(self.symbols) | set(self.added)) - set(self.removed)))

    def of(self, batch: DataFrame) -> DataFrame:
        return batch.join(F.broadcast(self._table()), "symbol", "left_semi")

    def sink(self, then: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: polls, then hands on the batch's rows of the symbols on the list."""

        def write(batch: DataFrame, batch_id: int) -> None:
            self.poll()
            then(self.of(batch), batch_id)

        return write


def updated(params: Params, changes: dict[str, object]) -> Params:
    """params with some values changed. An unknown name, or a value of another kind or below zero, raises and changes nothing."""
    kinds = {f.name: type(getattr(LIBRARY, f.name)) for f in fields(Params)}
    good: dict[str, object] = {}
    for name, value in changes.items():
        if name not in kinds:
            raise ValueError(f"unknown setting {name}")
        kind = kinds[name]
        if isinstance(value, bool) != (kind is bool) or not isinstance(value, (int, float) if kind is float else kind):
            raise ValueError(f"{name} takes {kind.__name__}, not {value!r}")
        if kind in (int, float) and not 0 <= value < float("inf"):
            raise ValueError(f"{name} must not be below 0: {value!r}")
        good[name] = kind(value)
    return replace(params, **good)


def settings(spark: SparkSession, params: Params, feed: str, symbols: tuple[str, ...], overrides: dict[str, float] | None = None, active: bool = True) -> DataFrame:
    """What is in force, a row a setting: name and value (JSON)."""
    values = asdict(params) | {"feed_name": feed, "symbols": sorted(symbols), "z_thresh_by_symbol": dict(sorted((overrides or {}).items())), "active": active}
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in sorted(values.items())], "name string, value string")
