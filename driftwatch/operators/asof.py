"""What was known at a time: the last quote before each trade, the last rows of a symbol, and both as a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.functions.scalar import mid, spread_bps
from driftwatch.operators.detect import p2_quantiles

NS, DAY = 1_000_000_000, 86_400
#: Stretches of time into which a symbol is counted to find its last rows, at least.
STRETCHES = 64


def asof(left: DataFrame, right: DataFrame, columns: list[str], keys: tuple[str, ...] = ("symbol",), bucket_sec: int = DAY, within_sec: float | None = None) -> DataFrame:
    """left with the columns of the last row of right at or before each row, by keys, in the order of (ts_ns, seq); at
    equal places right comes first. right_ts is that row's time. Null where there is none, or none within so many seconds.

    Both sides are one relation, dealt out by keys and time bucket: a window fills in the last row of right within a
    bucket, and each bucket begins with one row that is carried over from those before. So a hot symbol runs bucket by
    bucket, and each row is shuffled once.
    """
    value = F.struct(F.col("ts_ns").alias("right_ts"), *columns)
    r = right.select(*keys, "ts_ns", "seq", F.lit(0).alias("_side"), value.alias("_value"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_row"))
    row = left.select(*keys, "ts_ns", "seq", F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_value"].dataType).alias("_value"), F.struct("*").alias("_row"))
    bucket = F.floor(F.col("ts_ns") / (bucket_sec * NS)).alias("_bucket")
    last = r.groupBy(*keys, bucket).agg(F.max_by("_value", F.struct("ts_ns", "seq")).alias("_value"))
    # a row a bucket: what its first rows find before them
    seen = last.select(*keys, "_bucket", "_value").unionByName(left.select(*keys, bucket).distinct().withColumn("_value", F.lit(None).cast(r.schema["_value"].dataType)))
    by_bucket = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    one = seen.groupBy(*keys, "_bucket").agg(F.max("_value").alias("_value"))
    carried = one.withColumn("_value", F.last("_value", ignorenulls=True).over(by_bucket)).where("_value is not null")
    first = carried.select(*keys, "_bucket", F.lit(None).cast("bigint").alias("ts_ns"), F.lit(None).cast("bigint").alias("seq"), F.lit(-1).alias("_side"), "_value", F.lit(None).cast(row.schema["_row"].dataType).alias("_row"))
    both = r.unionByName(row).withColumn("_bucket", bucket).unionByName(first)
    upto = Window.partitionBy(*keys, "_bucket").orderBy(F.asc_nulls_first("ts_ns"), "seq", "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_value", F.last("_value", ignorenulls=True).over(upto)).where("_side = 1")
    if within_sec is not None:
        near = F.col("ts_ns") - F.col("_value.right_ts") <= F.lit(int(within_sec * NS))
        filled = filled.withColumn("_value", F.when(near, F.col("_value")))
    return filled.select("_row.*", "_value.right_ts", *(F.col("_value")[c].alias(c) for c in columns))


def last_rows(rows: DataFrame, n: int) -> DataFrame:
    """Each symbol's last n rows in the order of (ts_ns, seq), numbered from 1 at the latest, as column age.

    Rows are counted by symbol and stretches of time; only those of the latest stretches that hold n rows are sorted.
    """
    sizes = rows.groupBy("symbol").agg(F.count("*").alias("_n"), F.min("ts_ns").alias("_from"), F.max("ts_ns").alias("_to"))
    spans = sizes.select("symbol", "_to", F.expr(f"(_to - _from) div greatest({STRETCHES}, 4 * (_n div {n})) + 1").alias("_width"))
    placed = rows.join(spans, "symbol").withColumn("_back", F.expr("(_to - ts_ns) div _width"))
    later = Window.partitionBy("symbol").orderBy("_back").rowsBetween(Window.unboundedPreceding, -1)  # a row a stretch
    counts = placed.groupBy("symbol", "_back").agg(F.count("*").alias("_n")).withColumn("_later", F.coalesce(F.sum("_n").over(later), F.lit(0)))
    far = counts.where(F.col("_later") < n).groupBy("symbol").agg(F.max("_back").alias("_far"))
    few = placed.join(far, "symbol").where(F.col("_back") <= F.col("_far")).select(*rows.columns)
    age = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts_ns"), F.desc("seq")))
    return few.withColumn("age", age).where(F.col("age") <= n)


def context(events: DataFrame, n: int = 4096) -> DataFrame:
    """A symbol's last n prices and what its book showed last: symbol, ts_ns and prices (arrays, oldest first), quote
    (bid, ask, bid_size, ask_size, mid, spread_bps, spread_baseline_bps).

    Prices are those of trades and the middles of quotes, if above 0. quote is null where there is none or the last one is
    crossed, empty or without a bid. The baseline is the streaming median of the spreads of all valid quotes. Events without
    a price, or without bid or ask, are passed over.
    """
    quotes = events.where("etype = 'q' and bid is not null and ask is not null")
    priced = events.select("symbol", "ts_ns", "seq", F.when(F.col("etype") == "q", F.when(mid() > 0, mid())).otherwise(F.col("price")).alias("price"))
    ring = last_rows(priced.where("price is not null"), n)
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct("age", "ts_ns", "price"))))  # n at most
    own = ring.groupBy("symbol").agg(ordered.alias("_ring")).select("symbol", F.col("_ring.ts_ns").alias("ts_ns"), F.col("_ring.price").alias("prices"))
    latest = quotes.groupBy("symbol").agg(F.max_by(F.struct("bid", "ask", "bid_size", "ask_size"), F.struct("ts_ns", "seq")).alias("q")).select("symbol", "q.*").where("ask > bid and bid > 0")
    usual = p2_quantiles(quotes.where("ask > bid and bid > 0").withColumn("bps", spread_bps()), "bps", (0.5,)).select("symbol", F.col("q50").alias("spread_baseline_bps"))
    book = latest.withColumn("mid", mid()).withColumn("spread_bps", spread_bps()).join(usual, "symbol")
    quote = F.struct("bid", "ask", "bid_size", "ask_size", "mid", "spread_bps", "spread_baseline_bps")
    return own.join(book.select("symbol", quote.alias("quote")), "symbol", "left")
