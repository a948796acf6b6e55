"""Watchlists by micro-batch, changes of settings, bodies of long windows."""

import json

import pytest
from pyspark.sql import functions as F

from driftwatch.operators.kernels import LIBRARY, Params
from driftwatch.streaming import control, live


def names(spark, *symbols):
    return spark.createDataFrame([(s,) for s in symbols], "symbol string")


def test_a_watchlist_survives_failures_and_empty_lists(spark):
    lists = [names(spark, " aapl", "BTC", None, ""), None, names(spark), names(spark, "btc", "ETH"), "broken"]

    def read():
        x = lists.pop(0)
        if x is None:
            raise OSError("unreachable")
        return spark.read.parquet("/nowhere") if isinstance(x, str) else x

    w = control.Watchlist(spark, read, ("OLD",))
    w.poll()
    assert (w.symbols, w.added, w.removed, w.error) == (("AAPL", "BTC"), ["AAPL", "BTC"], ["OLD"], None)
    w.poll()
    assert w.symbols == ("AAPL", "BTC") and w.error == "OSError: unreachable" and not w.added
    w.poll()
    assert w.symbols == ("AAPL", "BTC") and w.error is None
    w.poll()
    assert (w.symbols, w.added, w.removed) == (("BTC", "ETH"), ["ETH"], ["AAPL"])
    w.poll()
    assert w.symbols == ("BTC", "ETH") and w.error
    cleared = control.Watchlist(spark, lambda: names(spark), ("A",), allow_empty=True)
    cleared.poll()
    assert cleared.symbols == ()


def test_a_stream_takes_up_changes_of_its_list(spark, tmp_path):
    lists = iter([names(spark, "A"), names(spark, "B", "C"), names(spark)])
    for k in range(3):
        spark.createDataFrame([(s, k) for s in "ABC"], "symbol string, n int").coalesce(1).write.json(f"{tmp_path}/in/{k}")
    w = control.Watchlist(spark, lambda: next(lists))
    source = spark.readStream.schema("symbol string, n int").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    sink = w.sink(lambda batch, k: batch.withColumn("k", F.lit(k)).write.mode("overwrite").parquet(f"{tmp_path}/out/{k}"))
    source.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.k, r.symbol) for k in range(3) for r in spark.read.parquet(f"{tmp_path}/out/{k}").collect())
    assert got == [(0, "A"), (1, "B"), (1, "C"), (2, "B"), (2, "C")]


def test_settings_change_in_whole_or_not_at_all(spark):
    p = control.updated(LIBRARY, {"z_thresh": 5, "regime_short": 20, "use_quote_mid": False})
    assert (p.z_thresh, p.regime_short, p.use_quote_mid) == (5.0, 20, False) and isinstance(p.z_thresh, float) and LIBRARY.z_thresh == 4.0
    for bad in ({"z": 1.0}, {"z_thresh": "5"}, {"z_thresh": -1.0}, {"regime_short": 2.5}, {"use_quote_mid": 1}, {"z_thresh": True}, {"z_thresh": float("nan")}):
        with pytest.raises(ValueError):
            control.updated(LIBRARY, {"cusum_h": 9.0} | bad)
    rows = {r.name: json.loads(r.value) for r in control.settings(spark, Params(z_thresh=3.0), "crypto", ("B", "A"), {"A": 2.0}, active=False).collect()}
    assert rows["z_thresh"] == 3.0 and rows["symbols"] == ["A", "B"] and rows["z_thresh_by_symbol"] == {"A": 2.0} and rows["active"] is False and len(rows) == len(vars(LIBRARY)) + 4


def test_bodies_of_a_long_window(spark, monkeypatch):
    monkeypatch.setattr(live, "BODY_ALERTS", 40)
    rows = spark.range(100).select((F.col("id") * 1000).alias("ts_ns"), F.lit("A").alias("symbol"), F.lit("cusum").alias("kind"), F.col("id").cast("double").alias("price"), F.lit(5.0).alias("score"))
    got = live.webhook_bodies(rows, "iex").collect()
    assert 2 <= len(got) <= 3 and sum(r.n for r in got) == 100 and {r.w for r in got} == {0}
    prices = [a["price"] for r in got for a in json.loads(r.body)["alerts"]]
    assert sorted(prices) == [float(k) for k in range(100)]
    assert all([a["ts_ns"] for a in json.loads(r.body)["alerts"]] == sorted(a["ts_ns"] for a in json.loads(r.body)["alerts"]) for r in got)
