"""Windows over ordered rows. Those over events run by symbol and time bucket, so that a hot symbol is spread over the
buckets; those over daily series, a row a day, by the keys of the series, many of which run side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


DAY = 86_400


def by_symbol(*order: str) -> Window:
    return Window.partitionBy("symbol").orderBy(*(order or ("ts_ns", "seq")))


def in_bucket(*order: str) -> Window:
    """A window over what by_time deals out."""
    return Window.partitionBy("symbol", "_bucket").orderBy(*(order or ("ts_ns", "seq")))


def own_rows(dealt: DataFrame) -> DataFrame:
    return dealt.where("_own").drop("_own")


def forward_fill(wide: DataFrame, order: str, names: list[str], limit: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each null takes the last value of the limit rows before it, by series."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-limit, 0)
    return wide.select(*keys, order, *(F.last(n, ignorenulls=True).over(w).alias(n) for n in names))


def log_returns(wide: DataFrame, order: str, names: list[str], outputs: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Log returns of complete daily rows, numbered from 1 by series; the first row has none."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = wide.select(*keys, order, (F.row_number().over(w) - 1).cast("bigint").alias("t"), *(F.log(F.col(n) / F.lag(n).over(w)).alias(o) for n, o in zip(names, outputs)))
    return rows.where("t > 0")


def sessions(ticks: DataFrame, gap_sec: float, bucket_sec: int = DAY) -> DataFrame:
    """session: 0, 1, ... by symbol; a new one begins after a gap longer than gap_sec."""
    new = F.when(F.col("ts_ns") - F.lag("ts_ns").over(in_bucket()) > int(gap_sec * 1e9), 1).otherwise(0)
    rows = own_rows(by_time(ticks, bucket_sec, back_rows=1).withColumn("_new", new))
    # what starts within a bucket, and in all of the symbol's buckets before: a row a bucket
    w = Window.partitionBy("symbol").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("symbol", "_bucket").agg(F.sum("_new").alias("_n")).select("symbol", "_bucket", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    inside = rows.withColumn("_inside", F.sum("_new").over(in_bucket()))
    return inside.join(starts, ["symbol", "_bucket"]).withColumn("session", F.col("_inside") + F.col("_before")).select(*ticks.columns, "session")


def log_return(ticks: DataFrame, bucket_sec: int = DAY) -> DataFrame:
    """log_return: against the symbol's price before; null for its first row, 0 for a price that isn't positive."""
    before = F.lag("price").over(in_bucket())
    value = F.when(F.col("price") > 0, F.log(F.col("price") / before)).when(before.isNotNull(), F.lit(0.0))
    return own_rows(by_time(ticks, bucket_sec, back_rows=1).withColumn("log_return", value)).select(*ticks.columns, "log_return")


def quote_rate(quotes: DataFrame, window: int = 20, bucket_sec: int = DAY) -> DataFrame:
    """rate: window quotes over the seconds since the one window - 1 rows before; 0 until there is one, or without time between."""
    span = F.col("ts_ns") - F.lag("ts_ns", window - 1).over(in_bucket())
    value = F.when(span > 0, window / (span / 1e9)).otherwise(0.0)
    return own_rows(by_time(quotes, bucket_sec, back_rows=window - 1).withColumn("rate", value)).select(*quotes.columns, "rate")


def within_each(rows: DataFrame, spans: dict[str, int], bucket_sec: int = DAY) -> DataFrame:
    """For each name how many rows of the symbol lie in so many seconds up to a row, both ends included. Rows are dealt out
    once, with what the longest span looks back to."""
    longest = max(spans.values())
    dealt = by_time(rows, max(bucket_sec, longest), back_sec=longest)
    counts = {name: F.count(F.lit(1)).over(in_bucket("ts_ns").rangeBetween(-seconds * 1_000_000_000, 0)) for name, seconds in spans.items()}
    return own_rows(dealt.withColumns(counts)).select(*rows.columns, *spans)


def within(rows: DataFrame, seconds: int, name: str = "n_within", bucket_sec: int = DAY) -> DataFrame:
    """How many rows of the symbol lie in the given seconds up to a row, both ends included."""
    return within_each(rows, {name: seconds}, bucket_sec)


def rolling_sum(series: DataFrame, order: str, value: str, k: int, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sums of k rows in order, by series; rows before the k-th are left out."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = series.withColumn("_n", F.row_number().over(w)).withColumn(name, F.sum(value).over(w.rowsBetween(1 - k, 0)))
    return rows.where(F.col("_n") >= k).drop("_n")


def realized_volatility(series: DataFrame, order: str, value: str, n: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """vol: the sample deviation of n rows, by series; null before the n-th."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - n, 0)
    return series.withColumn("vol", F.when(F.count(value).over(w) == n, F.stddev_samp(value).over(w)))


def hysteresis(rows: DataFrame, value: str, fire: float, rearm: float, bucket_sec: int = DAY) -> DataFrame:
    """Rows at which abs(value) exceeds fire for the first time since it was below rearm. Nulls change nothing."""
    size = F.abs(value)
    mark = F.when(size > fire, 1).when(size < rearm, 0)
    dealt = by_time(rows, bucket_sec, back_sec=0).withColumn("_mark", mark)
    # the last mark of the symbol's buckets before: a row a bucket
    w = Window.partitionBy("symbol").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = dealt.where("_mark is not null").groupBy("symbol", "_bucket").agg(F.max_by("_mark", F.struct("ts_ns", "seq")).alias("_last"))
    known = dealt.select("symbol", "_bucket").distinct().join(last, ["symbol", "_bucket"], "left").select("symbol", "_bucket", F.last("_last", ignorenulls=True).over(w).alias("_carried"))
    before = F.last("_mark", ignorenulls=True).over(in_bucket().rowsBetween(Window.unboundedPreceding, -1))
    out = dealt.withColumn("_before", before).where(size > fire).join(known, ["symbol", "_bucket"])
    return out.where(F.coalesce("_before", "_carried", F.lit(0)) == 0).select(*rows.columns)


def average_rank(value: Column, partition: list[str] | None = None) -> Column:
    """Ranks from 1; equal values share the mean of theirs."""
    w = Window.partitionBy(*(partition or []))
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(w.partitionBy(*(partition or []), value)) - 1) / 2


#: Pieces into which a hot key's values are cut by approximate quantiles.
PIECES = 64


def at_ranks(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """For each key the values at some ranks, counted from 0 in ascending order, as columns named as in ranks; there n is
    the key's number of values. Nulls are left out, a rank beyond the values gives null.

    A key's values are cut into pieces between approximate quantiles and counted; only the different values of the pieces
    that hold a wanted rank are sorted, so no task sorts all of a hot key's rows, or all that share one value.
    """
    x = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    cuts = x.groupBy(*keys).agg(F.count("*").alias("n"), F.approx_percentile("_v", F.array(*(F.lit(k / PIECES) for k in range(1, PIECES))), F.lit(1000)).alias("_cuts"))
    wanted = cuts.select(*keys, "n", F.array(*(F.struct(F.lit(name).alias("_name"), r.cast("bigint").alias("_rank")) for name, r in ranks.items())).alias("_ranks"))
    same = lambda df: F.broadcast(df) if not keys else df  # noqa: E731  # without keys one row
    join = lambda a, b, on: a.join(b, on) if on else a.join(b, F.lit(True))
    piece = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    cut = join(x, same(cuts.select(*keys, "_cuts")), keys).select(*keys, "_v", piece.alias("_piece"))
    w = Window.partitionBy(*keys).orderBy("_piece")  # PIECES rows a key
    counts = cut.groupBy(*keys, "_piece").agg(F.count("*").alias("_c")).withColumn("_end", F.sum("_c").over(w))
    hit = join(counts, wanted.select(*keys, F.inline("_ranks")), keys).where((F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_c")))
    inside = cut.join(hit.select(*keys, "_piece", "_name", (F.col("_rank") - F.col("_end") + F.col("_c")).alias("_at")), [*keys, "_piece"])
    # equal values are counted before they are sorted, so that one that fills a piece is a single row
    values = inside.groupBy(*keys, "_name", "_at", "_v").agg(F.count("*").alias("_c"))
    upto = values.withColumn("_end", F.sum("_c").over(Window.partitionBy(*keys, "_name").orderBy("_v")))
    return upto.where((F.col("_at") < F.col("_end")) & (F.col("_at") >= F.col("_end") - F.col("_c"))).groupBy(*keys).agg(*(F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks))


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """For each key the percentiles at some shares, as columns named as in shares, by linear interpolation between the two
    nearest ranks; from at_ranks, so without a list of a hot key's values. Nulls are left out."""
    place = {name: F.lit(float(p)) * (F.col("n") - 1) for name, p in shares.items()}
    ends = {f"_low_{name}": F.floor(x) for name, x in place.items()} | {f"_high_{name}": F.ceil(x) for name, x in place.items()}
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"))
    found = at_ranks(rows, keys, value, ends)
    both = found.join(counts, keys) if keys else found.join(counts, F.lit(True))  # without keys one row
    between = lambda name: F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * (place[name] - F.floor(place[name]))
    return both.select(*keys, *(between(name).alias(name) for name in shares))


def by_time(rows: DataFrame, bucket_sec: int, back_rows: int = 0, back_sec: float = 0) -> DataFrame:
    """rows dealt out by symbol and time bucket for windows that look back so many rows or seconds: columns _bucket, and
    _own, false for copies of rows from before the bucket that its first rows look back to.

    So a window by (symbol, _bucket) in place of symbol gives its own rows what a window over the whole symbol would.
    A bucket's last back_rows rows go to the later buckets that haven't as many rows between; rows of its last back_sec
    seconds to the next ones. What is copied is bounded by back_rows a bucket, or by the share of back_sec in a bucket.
    """
    size = bucket_sec * 1_000_000_000
    own = rows.withColumn("_bucket", F.floor(F.col("ts_ns") / size)).withColumn("_own", F.lit(True))
    if not back_sec:
        return with_rows_before(own, back_rows) if back_rows else own
    end = F.floor((F.col("ts_ns") + F.lit(int(back_sec * 1_000_000_000)).cast("bigint")) / size)
    later = own.where(end > F.col("_bucket")).withColumn("_bucket", F.explode(F.sequence(F.col("_bucket") + 1, end)))
    return own.unionByName(later.withColumn("_own", F.lit(False)).select(*own.columns))


def with_rows_before(own: DataFrame, back_rows: int) -> DataFrame:
    """Rows with a _bucket, whose numbers follow their time, and _own; and copies, not their own, of the back_rows rows of
    the symbol before each bucket's first."""
    w = Window.partitionBy("symbol").orderBy("_bucket")  # a row a bucket
    if back_rows == 1:  # the last row of the bucket before
        last = own.groupBy("symbol", "_bucket").agg(F.max_by(F.struct(*own.columns), F.struct("ts_ns", "seq")).alias("_row"))
        copies = last.withColumn("_to", F.lead("_bucket").over(w)).where("_to is not null").select("_row.*", "_to").drop("_bucket").withColumnRenamed("_to", "_bucket")
        return own.unionByName(copies.withColumn("_own", F.lit(False)).select(*own.columns))
    sizes = own.groupBy("symbol", "_bucket").agg(F.count("*").alias("_n")).withColumn("_end", F.sum("_n").over(w))
    last = F.row_number().over(Window.partitionBy("symbol", "_bucket").orderBy(F.desc("ts_ns"), F.desc("seq")))
    tails = own.withColumn("_age", last).where(F.col("_age") <= back_rows).join(sizes.select("symbol", "_bucket", "_end"), ["symbol", "_bucket"])
    # by a row's number in its symbol: a bucket with so many rows before it needs those above that less back_rows
    tails = tails.withColumn("_i", F.col("_end") - F.col("_age") + 1).withColumn("_part", F.floor(F.col("_i") / back_rows))
    before = F.col("_end") - F.col("_n")
    parts = F.explode(F.sequence(F.floor((before - back_rows + 1) / back_rows), F.floor(before / back_rows)))
    goals = sizes.where(before > 0).select("symbol", F.col("_bucket").alias("_to"), before.alias("_before"), parts.alias("_part"))
    later = tails.join(goals, ["symbol", "_part"]).where((F.col("_i") <= F.col("_before")) & (F.col("_i") > F.col("_before") - back_rows))
    later = later.drop("_bucket", "_before", "_end", "_age", "_i", "_part").withColumnRenamed("_to", "_bucket")
    return own.unionByName(later.withColumn("_own", F.lit(False)).select(*own.columns))


def null_scores(series: DataFrame, value: str, name: str = "z", keys: tuple[str, ...] = ()) -> DataFrame:
    """z of each value against the mean and sample deviation of its series: one row of moments a series is joined back."""
    moments = series.groupBy(*keys).agg(F.avg(value).alias("_m"), F.greatest(F.stddev_samp(value), F.lit(1e-12)).alias("_s"))
    joined = series.join(moments, list(keys)) if keys else series.join(F.broadcast(moments), F.lit(True))  # without keys one row
    return joined.withColumn(name, (F.col(value) - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def quiet_starts(series: DataFrame, order: str, z: str, vol: str, days: int = 30, calm: float = 2.0, n: int = 3) -> DataFrame:
    """start: the first n windows of days rows, none overlapping another, in which abs(z) stays below calm and the median
    of vol is below the whole series'. Rows are numbered by order, without gaps; a null vol is left out of medians."""
    own = series.select(F.col(order).alias("start"), F.col(z).alias("_z"), F.col(vol).alias("_vol"))
    ahead = Window.orderBy("start").rowsBetween(0, days - 1)
    middle = own.agg(F.percentile("_vol", F.lit(0.5)).alias("_middle"))
    seen = own.select("start", F.count("*").over(ahead).alias("_n"), F.max(F.abs("_z")).over(ahead).alias("_most"), F.percentile("_vol", F.lit(0.5)).over(ahead).alias("_here"))
    fits = seen.join(F.broadcast(middle), F.lit(True)).where((F.col("_n") == days) & (F.col("_most") < calm) & (F.col("_here") < F.col("_middle"))).select("start")
    # each next one is the first that starts after the one before has ended
    picked = fits.agg(F.min("start").alias("s1"))
    for k in range(2, n + 1):
        later = fits.join(F.broadcast(picked), F.col("start") >= F.col(f"s{k - 1}") + days).agg(F.min("start").alias(f"s{k}"))
        picked = picked.join(later, F.lit(True))
    return picked.select(F.explode(F.array(*(f"s{k}" for k in range(1, n + 1)))).alias("start")).where("start is not null")
