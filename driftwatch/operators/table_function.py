"""The detectors as a table function of SQL: SELECT * FROM detect_alerts(TABLE(events) PARTITION BY symbol ORDER BY (ts_ns, seq))."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from driftwatch.operators.kernels import LIBRARY, Params, Symbol, as_rows
from driftwatch.schemas import ALERT

#: Rows that are handed to the detectors together.
RUN = 8192
VALUES = ("price", "size", "bid", "ask", "bid_size", "ask_size")


def register_detectors(spark: SparkSession, params: Params = LIBRARY, name: str = "detect_alerts") -> None:
    """Registers the function under a name. Its table has the columns of an event stream, any others are ignored; a
    partition is a symbol, whose rows come in order. Alerts are those of detect."""

    class Detect:
        def __init__(self) -> None:
            self.state, self.rows, self.symbol = Symbol(params), [], None

        def eval(self, event: Row) -> Iterator[tuple]:
            self.symbol = event["symbol"]
            self.rows.append((event["etype"], event["ts_ns"], event["seq"], *(event[v] for v in VALUES)))
            if len(self.rows) == RUN:
                yield from self.terminate()

        def terminate(self) -> Iterator[tuple]:
            if self.rows:
                etype, ts, seq, *values = zip(*self.rows)
                self.rows = []
                ts, seq = np.array(ts, np.int64), np.array(seq, np.int64)
                numbers = [np.array([np.nan if x is None else x for x in v], float) for v in values]
                yield from as_rows(self.symbol, ts, seq, self.state.run(np.array([e == "q" for e in etype]), ts, *numbers))

    spark.udtf.register(name, udtf(Detect, returnType=ALERT))
