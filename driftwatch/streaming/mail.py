"""Digests of strong alerts as mails: windows that an alert opens, a silence for each symbol that was told, subject and text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.functions.scalar import narrative, severity, text_of
from driftwatch.operators.detect import folded

NS = 1_000_000_000
#: Lines of a mail; a digest of more goes out in numbered parts. Names in a subject.
LINES, NAMES = 500, 3
#: What feeds that aren't live are called in a mail.
NOT_LIVE = {"synthetic": "generated data", "csv": "a recording"}


class Digests:
    """Which alerts are told, and when: a fold over all alerts in order, whatever their symbol.

    The sender wakes for each alert, and window_sec after it last woke. Waking with nothing to tell, it starts to wait anew;
    otherwise it sends once it has waited window_sec, and symbols told then are silent for cooldown_sec. At equal times it
    sends first.
    """

    def __init__(self, window_sec: float, min_score: float, cooldown_sec: float):
        self.window, self.min_score, self.cooldown = int(window_sec * NS), min_score, int(cooldown_sec * NS)
        self.waits_since: int | None = None
        self.told: set[str] = set()
        self.sent: dict[str, int] = {}
        self.last = 0

    def __call__(self, symbol: str, columns: list[np.ndarray]) -> list | None:
        ts, _, names, scores = columns[:4]
        goes, at = [], []
        for k, (t, name, score) in enumerate(zip(ts.tolist(), names.tolist(), scores.tolist())):
            self.last = t
            if self.told and t >= self.waits_since + self.window:
                self.waits_since += self.window
                self.sent.update(dict.fromkeys(self.told, self.waits_since))
                self.told.clear()
            if self.waits_since is None:
                self.waits_since = t
            if not self.told:
                self.waits_since += (t - self.waits_since) // self.window * self.window
            if abs(score) >= self.min_score and t - self.sent.get(name, t - self.cooldown) >= self.cooldown:
                self.told.add(name)
                goes.append(k)
                at.append(self.waits_since + self.window)
            elif not self.told:
                self.waits_since = t
        if not goes:
            return None
        return [at, *(c[goes].tolist() for c in columns)]

    def mark(self) -> bytes:
        self.sent = {name: t for name, t in self.sent.items() if self.last - t < self.cooldown}
        waits = -1 if self.waits_since is None else self.waits_since if self.told else self.waits_since + (self.last - self.waits_since) // self.window * self.window
        return repr((waits, sorted(self.told), sorted(self.sent.items()))).encode()


def told(alerts: DataFrame, window_sec: float = 60, min_score: float = 6.0, cooldown_sec: float = 900, piece_rows: int | None = None) -> DataFrame:
    """Alerts that a digest tells, with its time as digest_ns: digest_ns, ts_ns, symbol, kind, price, score, details.

    Alerts go by (ts_ns, seq, ord). Where there are many they are cut by time, and pieces run side by side: what a piece
    takes over is a window and the symbols that are silent, which the alerts just before it tell.
    """
    columns = set(alerts.columns)
    of = lambda name, kind: F.col(name) if name in columns else F.lit(None).cast(kind)
    rows = alerts.where("score is not null and symbol is not null").select(
        F.lit("").alias("symbol"), "ts_ns", (F.col("seq") * 16 + F.coalesce(of("ord", "int"), F.lit(0))).alias("seq"), F.col("symbol").alias("name"), "score", "kind", "price", of("details", "string").alias("details"),
    )
    schema = "digest_ns bigint, ts_ns bigint, seq bigint, name string, score double, kind string, price double, details string"
    found = folded(rows, lambda symbol, _: Digests(window_sec, min_score, cooldown_sec), schema, 20_000, piece_rows)
    return found.withColumnRenamed("name", "symbol")


def mails(alerts: DataFrame, feed: str, window_sec: float = 60, min_score: float = 6.0, cooldown_sec: float = 900, piece_rows: int | None = None) -> DataFrame:
    """digest_ns (when it is sent), part (from 0), n, n_symbols, subject and body of each digest's mails.

    The subject has the symbol, kind and score of a single alert; of more their number and the first symbols by name. The
    body has two lines an alert, facts and narrative, in order of time, then notices.
    """
    t = told(alerts, window_sec, min_score, cooldown_sec, piece_rows)
    seconds = F.timestamp_seconds(F.expr("ts_ns div 1000000000"))
    facts = F.concat(
        F.date_format(seconds, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC  "), "symbol", F.lit("  "), "kind", F.lit("  score "), text_of(F.col("score"), "+.2f"),
        F.lit("  ["), severity(), F.lit("]  price "), text_of(F.col("price"), ",.4f"),
    )
    line = F.concat(facts, F.lit("\n    "), narrative())
    short = F.concat("symbol", F.lit(" "), "kind", F.lit(" ("), text_of(F.col("score"), "+.1f"), F.lit(")"))
    lines = t.select("digest_ns", "ts_ns", "seq", "symbol", line.alias("line"), short.alias("short"))
    place = F.row_number().over(Window.partitionBy("digest_ns").orderBy("ts_ns", "seq")) - 1
    whole = lines.groupBy("digest_ns").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("symbol")).alias("_names"), F.min("short").alias("_short"))
    texts = lines.withColumn("part", F.floor(place / LINES)).groupBy("digest_ns", "part").agg(
        F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("ts_ns", "seq", "line"))), lambda x: x["line"])).alias("_lines")  # LINES at most
    )
    many = F.concat(F.col("n").cast("string"), F.lit(" alerts on "), F.concat_ws(", ", F.slice("_names", 1, NAMES)), F.when(F.size("_names") > NAMES, "…").otherwise(""))
    notices = ["A score says how far a value lies from its own recent past; it foretells nothing."]
    if feed.lower() in NOT_LIVE:
        notices.append(f"The data came from {NOT_LIVE[feed.lower()]}, not from a live feed.")
    notices.append("For information only.")
    head = F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " alert").otherwise(" alerts"), F.lit(f" on the feed {feed}.\n\n"))
    return whole.join(texts, "digest_ns").select(
        "digest_ns", "part", "n", F.size("_names").cast("bigint").alias("n_symbols"), F.concat(F.lit("[driftwatch] "), F.when(F.col("n") == 1, F.col("_short")).otherwise(many)).alias("subject"),
        F.concat(head, "_lines", F.lit("\n\n" + "\n\n".join(notices) + "\n")).alias("body"),
    )
