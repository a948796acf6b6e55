"""Streams against the same operators over tables: ordered detection with recovery, windows, joins, the feed's source."""

import json
import random

import pytest
from pyspark.sql import functions as F
from tests.test_pieces import P, stream

from driftwatch.operators import asof as A
from driftwatch.operators import detect as D
from driftwatch.operators import evaluate as E
from driftwatch.plans import queries
from driftwatch.schemas import EVENT_STREAM
from driftwatch.sources import feed
from driftwatch.sources import views as V
from driftwatch.streaming import live, stateful
from driftwatch.streaming import windows as T

SF = "/root/testdata/sf0.001"
NS = 10**9


def parts(df, folder, cuts, order="ts_ns"):
    """df as files, one for each stretch of the order between two cuts."""
    rows = sorted(df.collect(), key=lambda r: r[order])
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        df.sparkSession.createDataFrame(rows[a:b], df.schema).coalesce(1).write.json(f"{folder}/part{k}")
    return rows


def run(out, folder, name, sink=None):
    query = out.writeStream.foreachBatch(sink or live.table_sink(f"{folder}/{name}")).option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_detection_in_event_time_survives_a_failure(spark, tmp_path):
    """Events of two micro-batches and more, each dealt out at random; the query fails in mid-stream and is started again."""
    events = stream(spark, 2500, seed=4)
    end = max(r.ts_ns for r in events.collect())
    last = spark.createDataFrame([("end", end + 10_000 * NS, 10**6, "t", 1.0, 1.0, None, None, None, None)], events.schema)
    parts(events.unionByName(last), f"{tmp_path}/in", [700, 1500, 1501])
    source = spark.readStream.schema(EVENT_STREAM).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    alerts = stateful.detect_in_event_time(source, P, delay_sec=3_000, stretch_sec=600)
    sink = live.table_sink(f"{tmp_path}/out")

    def fails(batch, k):
        if k == 2:
            raise RuntimeError("lost")
        sink(batch, k)

    with stateful.rocksdb(spark):
        with pytest.raises(Exception, match="lost"):
            run(alerts, tmp_path, "out", fails)
        run(alerts, tmp_path, "out", sink)
    assert all(spark.conf.get(key, None) != value for key, value in stateful.STATE_STORE.items())
    got = spark.read.parquet(f"{tmp_path}/out").select(*D.detect(events, P).columns)
    wanted = D.detect(events, P)
    assert rows(got) == rows(wanted) and wanted.count() > 100 and len({r[4] for r in rows(wanted)}) >= 8


def test_windows_and_sessions_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    alerts = V.alerts(spark, SF)
    end = alerts.agg(F.max("ts_ns")).first()[0]
    last = spark.createDataFrame([(end + 10**6 * NS, "end", 0, "end", 1.0, 1.0)], alerts.schema)
    late = alerts.limit(3).withColumn("ts_ns", F.lit(NS))
    parts(alerts.unionByName(last), f"{tmp_path}/in", [40, 90])
    late.coalesce(1).write.json(f"{tmp_path}/in/part9")
    source = spark.readStream.schema(alerts.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    for name, over in (("windows", lambda x: T.alert_windows(x, 21_600, 7_200, 60)), ("sessions", lambda x: T.alert_sessions(x, 14_400, 60))):
        found = over(source)
        query = run(found, tmp_path, name, lambda batch, k: batch.write.mode("overwrite").parquet(f"{tmp_path}/{name}/batch={k}"))  # noqa: B023
        got = spark.read.parquet(f"{tmp_path}/{name}").drop("batch").where("symbol <> 'end'").select(*found.columns)
        assert rows(got) == rows(over(alerts)) and got.count() > 20
        assert T.late_rows(query) >= 3


@pytest.mark.parametrize("how", ["inner", "left_outer"])
def test_alerts_meet_events_as_both_stream_in(spark, tmp_path, how):
    alerts, events = V.alerts(spark, SF), V.catalog(spark, SF)
    end = alerts.agg(F.max("ts_ns")).first()[0] + 10**6 * NS
    later = alerts.limit(1).withColumn("ts_ns", F.lit(end)).withColumn("symbol", F.lit("end")), events.limit(1).withColumn("ts_ns", F.lit(end)).withColumn("symbol", F.lit("end"))
    parts(alerts.unionByName(later[0]), f"{tmp_path}/a", [50, 51])
    parts(events.unionByName(later[1]), f"{tmp_path}/e", [3, 9])
    read = lambda df, x: spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/{x}")
    found = T.alerts_with_events(read(alerts, "a"), read(events, "e"), 18_000.0, 7_200, delay_sec=60, how=how)
    run(found, tmp_path, how, lambda batch, k: batch.write.mode("overwrite").parquet(f"{tmp_path}/{how}/batch={k}"))
    columns = ["ts_ns", "symbol", "seq", "kind", "event_no", "event_ts", "we_from", "we_to"]
    got = spark.read.parquet(f"{tmp_path}/{how}").where("symbol <> 'end'").select(*columns)
    wanted = E.interval_join(alerts, events, 18_000.0, how="inner" if how == "inner" else "left").select(*columns)
    assert rows(got) == rows(wanted) and wanted.where("event_no is not null").count() > 5
    if how == "left_outer":
        assert wanted.where("event_no is null").count() > 5


def recorded(events):
    stamp = lambda ns: f"2024-01-01T00:{ns // NS // 60:02d}:{ns // NS % 60:02d}.{ns % NS:09d}Z"
    out = []
    for e in events:
        if e["T"] == "t":
            out.append({"T": "t", "S": e["S"], "p": e["p"], "s": 10, "t": stamp(e["ts"])})
        else:
            out.append({"T": "q", "S": e["S"], "bp": e["p"] - 0.01, "ap": e["p"] + 0.01, "bs": 5, "as": 7, "t": stamp(e["ts"])})
    return out


def test_feed_source_resumes_and_skips(spark, tmp_path):
    rng = random.Random(6)
    ticks = recorded([{"T": rng.choice("tq"), "S": rng.choice(["A", "B"]), "p": 100 + rng.gauss(0, 1), "ts": k * NS} for k in range(600)])
    lines = [json.dumps(ticks[k : k + 3]) for k in range(0, 600, 3)]
    lines[5:5] = ['[{"T":"error","code":406,"msg":"connection limit exceeded"}]', "{not json", '{"T":"t"}', "[]", '[{"T":"success","msg":"connected"}]']
    folder, state = tmp_path / "frames", str(tmp_path / "state")
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join(lines[:90]) + "\n" + lines[90][:20])  # the last line isn't whole yet
    out = feed.frame_messages(spark, str(folder), partition_bytes=1000)

    def take():
        query = out.writeStream.foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={k}")).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out").drop("batch")

    assert take().count() == (90 - 5) * 3
    with open(folder / "a.jsonl", "a") as f:
        f.write(lines[90][20:] + "\n" + "\n".join(lines[91:150]) + "\n")
    (folder / "b.jsonl").write_text("\n".join(lines[150:]) + "\n")
    got, whole = take(), feed.frame_messages(spark, str(folder), stream=False, partition_bytes=777)
    assert got.count() == 600 and rows(got.select(*whole.columns)) == rows(whole)
    assert whole.select("symbol", "ts_ns", "seq").distinct().count() == 600
    assert [p.end - p.start for p in feed.FrameReader({"path": str(folder), "partitionBytes": "777"}).partitions()][0] == 777
    assert rows(D.detect(got.select(*whole.columns), queries.PARAMS)) == rows(D.detect(whole, queries.PARAMS))


def test_asof_against_a_loop(spark):
    rng = random.Random(2)
    side = lambda n, kind: [(rng.choice(["a", "b", None]), rng.randrange(0, 40 * 86_400) * NS if rng.random() < 0.9 else 10 * 86_400 * NS, rng.randrange(10**6), f"{kind}{k}") for k in range(n)]
    left, right = side(200, "l"), side(60, "r")
    right.append((left[0][0], left[0][1], left[0][2], "same place"))
    frame = lambda x, c: spark.createDataFrame(x, f"symbol string, ts_ns bigint, seq bigint, {c} string")
    for within in (None, 3 * 86_400):
        got = {r.name: (r.right_ts, r.value) for r in A.asof(frame(left, "name"), frame(right, "value"), ["value"], within_sec=within).collect()}
        assert len(got) == len(left)
        for s, t, k, name in left:
            best = max(((b, c, v) for a, b, c, v in right if a == s and s is not None and (b, c) <= (t, k)), default=None)
            if best and within and t - best[0] > within * NS:
                best = None
            if s is not None:
                assert got[name] == ((best[0], best[2]) if best else (None, None)), name


def test_context(spark):
    events = stream(spark, 3000, seed=8)
    got = {r.symbol: r for r in A.context(events, 400).collect()}
    by = {}
    for r in sorted(events.collect(), key=lambda r: (r.ts_ns, r.seq)):
        ring, book = by.setdefault(r.symbol, ([], [None]))
        if r.etype == "t" and r.price is not None:
            ring.append((r.ts_ns, r.price))
        if r.etype == "q" and r.bid is not None:
            middle = 0.5 * (r.bid + r.ask) if r.ask > 0 else 0.0
            if middle > 0:
                ring.append((r.ts_ns, middle))
            book[0] = (r.bid, r.ask, r.bid_size, r.ask_size)
    assert got.keys() == by.keys()
    for symbol, (ring, (book,)) in by.items():
        r = got[symbol]
        assert list(zip(r.ts_ns, r.prices)) == ring[-400:]
        if book and book[1] > book[0] > 0:
            assert tuple(r.quote)[:4] == book and r.quote.spread_baseline_bps > 0
        else:
            assert r.quote is None
