"""Gates: how far the returns around labelled events fall out of models of the days before, and what that decides."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.operators.models import TCopula
from driftwatch.operators.tensor_trains import BinnedCopula

#: Models by name, each made of the reference days' returns.
COPULAS: dict[str, Callable[[np.ndarray], TCopula | BinnedCopula]] = {
    "gaussian": lambda x: TCopula(x, gaussian=True),
    "t": TCopula,
    "mps_chi2": lambda x: BinnedCopula(x, 2),
    "mps_chi4": lambda x: BinnedCopula(x, 4),
    "mps_chi8": lambda x: BinnedCopula(x, 8),
}
SCORES = "event string, type string, method string, part string, day bigint, ll double"


def event_windows(returns: DataFrame, onsets: DataFrame, ref: int = 252, gap: int = 30, days: int = 20, short: int = 20) -> DataFrame:
    """event, type, part and day beside the returns of each event's days: part ref, the ref days that end gap days before
    its onset, and part eval, the days from the onset on; day counts each from 0.

    returns is numbered by t without gaps from 1, onsets holds event, type and onset (such a t). Events with more than
    short of their reference days missing are left out. Both sides are dealt out by stretches of t.
    """
    size = ref + gap + days
    first = F.greatest(F.lit(1), F.col("onset") - gap - ref)
    known = onsets.where(F.col("onset") - gap - first >= ref - short).withColumn("_first", first)
    spans = known.withColumn("_stretch", F.explode(F.sequence(F.floor(F.col("_first") / size), F.floor((F.col("onset") + days - 1) / size))))
    at = F.col("t")
    part = F.when(at < F.col("onset") - gap, "ref").when((at >= F.col("onset")) & (at < F.col("onset") + days), "eval")
    beside = returns.withColumn("_stretch", F.floor(at / size)).join(spans, "_stretch").where(at >= F.col("_first")).withColumn("part", part).where("part is not null")
    return beside.withColumn("day", F.when(F.col("part") == "ref", at - F.col("_first")).otherwise(at - F.col("onset"))).select("event", "type", "part", "day", *returns.columns)


def copula_scores(windows: DataFrame, names: list[str], models: tuple[str, ...] = tuple(COPULAS)) -> DataFrame:
    """Log-likelihoods of each event's days under each model fitted to its reference days: event, type, method, part, day,
    ll. A task holds an event's some three hundred days and fits all models to them."""

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "day"])
        x, own = pdf[names].to_numpy(), pdf[["event", "type", "part", "day"]]
        made = [own.assign(method=name, ll=COPULAS[name](x[(pdf["part"] == "ref").to_numpy()]).log_likelihood(x)) for name in models]
        return pd.concat(made)[["event", "type", "method", "part", "day", "ll"]]

    parts = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return windows.repartition(parts, "event").groupBy("event").applyInPandas(score, SCORES)


def marginal_scores(windows: DataFrame, names: list[str]) -> DataFrame:
    """As copula_scores, each column by itself: normal (gaussian), Student's t of five degrees, and the shares of two and of
    four bins of deviations from the reference's mean (mps_2, mps_4). DataFrame functions only."""
    ref = F.col("part") == "ref"
    of_name = Window.partitionBy("event", "name")
    long = windows.select("event", "type", "part", "day", F.inline(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("x")) for n in names))))
    spread = F.greatest(F.stddev_samp(F.when(ref, F.col("x"))).over(of_name), F.lit(1e-12))
    z = long.withColumn("z", (F.col("x") - F.avg(F.when(ref, F.col("x"))).over(of_name)) / spread)
    binned = z.withColumn("two", F.when(F.col("z") > 0, 1).otherwise(0)).withColumn("four", F.when(F.col("z") > 1, 3).when(F.col("z") > 0, 2).when(F.col("z") > -1, 1).otherwise(0))
    inside = lambda *keys: F.count(F.when(ref, 1)).over(Window.partitionBy("event", "name", *keys))
    counted = binned.withColumn("in_two", inside("two")).withColumn("in_four", inside("four")).withColumn("n", inside())
    scores = {
        "gaussian": -0.5 * F.col("z") ** 2, "t": -3 * F.log1p(F.col("z") ** 2 / 5),
        "mps_2": F.log((F.col("in_two") + 1) / (F.col("n") + 2)), "mps_4": F.log((F.col("in_four") + 1) / (F.col("n") + 4)),
    }
    each = counted.groupBy("event", "type", "part", "day").agg(*(F.sum(x).alias(n) for n, x in scores.items()))
    return each.select("event", "type", "part", "day", F.inline(F.array(*(F.struct(F.lit(n).alias("method"), F.col(n).alias("ll")) for n in scores)))).select("event", "type", "method", "part", "day", "ll")


def peaks(scores: DataFrame, roll: int = 5) -> DataFrame:
    """For each event and method the deepest fall of the rolling log-likelihood after the onset: event, type, method,
    peak_z (against the reference's rolling ones), peak_day (its window's first day, the earliest on ties). Both are 0
    where the reference doesn't vary."""
    w = Window.partitionBy("event", "method", "part").orderBy("day").rowsBetween(1 - roll, 0)
    rolled = scores.withColumn("_n", F.count("*").over(w)).withColumn("s", F.sum("ll").over(w)).where(F.col("_n") == roll).withColumn("day", F.col("day") - roll + 1)
    null = rolled.where("part = 'ref'").groupBy("event", "method").agg(F.avg("s").alias("_m"), F.stddev_samp("s").alias("_s"))
    own = rolled.where("part = 'eval'").join(null, ["event", "method"]).withColumn("z", F.when(F.col("_s") < 1e-12, F.lit(0.0)).otherwise((F.col("s") - F.col("_m")) / F.col("_s")))
    least = F.min(F.struct("z", "day"))
    return own.groupBy("event", "type", "method").agg(least.alias("b")).select("event", "type", "method", F.col("b.z").alias("peak_z"), F.when(F.col("b.z") == 0, 0).otherwise(F.col("b.day")).cast("int").alias("peak_day"))


def best_by_event(scores: DataFrame, prefix: str) -> DataFrame:
    """For each event the row of the largest abs(peak_z) among methods whose name starts with prefix; by name on ties."""
    own = scores.where(F.col("method").startswith(prefix))
    best = F.max_by(F.struct("method", "peak_z", "peak_day"), F.struct(F.abs("peak_z"), F.col("method")))
    return own.groupBy("event").agg(best.alias("b")).select("event", F.col("b.method").alias("best"), F.col("b.peak_z").alias("best_z"), F.col("b.peak_day").alias("best_day"))


def merged(scores: DataFrame, prefix: str = "mps_") -> DataFrame:
    """Crisis events with the best of the methods of a prefix beside gaussian and t; events that lack one are left out."""
    crisis = scores.where("type = 'crisis'")
    of = lambda method, name: crisis.where(F.col("method") == method).select("event", F.col("peak_z").alias(f"{name}_z"), F.col("peak_day").alias(f"{name}_day"))
    return best_by_event(crisis, prefix).join(of("gaussian", "gauss"), "event").join(of("t", "t"), "event")


def spurious_threshold(scores: DataFrame, prefix: str = "mps_") -> DataFrame:
    """threshold: the median over crisis events of the best abs(peak_z)."""
    return best_by_event(scores.where("type = 'crisis'"), prefix).agg(F.percentile(F.abs("best_z"), F.lit(0.5)).alias("threshold"))


def verdict(scores: DataFrame, prefix: str = "mps_") -> DataFrame:
    """One row: criteria c1 to c5 with what they count, the threshold, and the decision (full, partial or fail)."""
    m, z = merged(scores, prefix), lambda name: F.abs(f"{name}_z")
    far = z("best") >= 1.5 * z("gauss")
    count = lambda cond: F.count(F.when(cond, 1))
    crisis = m.agg(count(far).alias("n_far"), count(far & (F.col("best_day") <= F.col("gauss_day") + 2)).alias("n_timely"), count(z("best") > z("t")).alias("n_beyond_t"))
    quiet = scores.where("type = 'quiet'")
    over = lambda df, column, name: df.join(F.broadcast(spurious_threshold(scores, prefix)), F.lit(True)).agg(count(F.abs(column) >= F.col("threshold")).alias(name))  # noqa: E731  # one row
    one = crisis.join(over(best_by_event(quiet, prefix), "best_z", "n_spurious"), F.lit(True)).join(over(quiet.where("method = 't'"), "peak_z", "n_spurious_t"), F.lit(True)).join(spurious_threshold(scores, prefix), F.lit(True))
    one = one.select("*", (F.col("n_far") >= 2).alias("c1"), (F.col("n_timely") >= 2).alias("c2"), (F.col("n_beyond_t") >= 1).alias("c3"), (F.col("n_spurious") <= 1).alias("c4"), (F.col("n_spurious") <= F.col("n_spurious_t")).alias("c5"))
    return one.withColumn("decision", F.when(F.expr("c1 and c2 and c3 and c4 and c5"), "full").when(F.expr("c1 and c4 and c5"), "partial").otherwise("fail"))


def corroboration(scores: DataFrame, z_reference: str, z_new: str, reference_thresh: float = 3.0, new_thresh: float = 3.0) -> DataFrame:
    """One row: the share of the reference's firings at which the new score fires too (c1), and the share of the new
    one's at which the reference doesn't (c2); null without firings."""
    a, b = F.abs(z_reference) >= reference_thresh, F.abs(z_new) >= new_thresh
    count = lambda cond: F.count(F.when(cond, 1))
    share = lambda x, n: F.when(F.col(n) > 0, F.col(x) / F.col(n))
    one = scores.agg(count(a).alias("n_reference"), count(b).alias("n_new"), count(a & b).alias("n_both"), count(b & ~a).alias("n_new_alone"))
    return one.select("*", share("n_both", "n_reference").alias("corroborated"), share("n_new_alone", "n_new").alias("lift"))


def quiet_firings(scores: DataFrame, order: str, z_new: str, starts: DataFrame, days: int = 30, new_thresh: float = 3.0, most: float = 0.1) -> DataFrame:
    """For each quiet window: how often the new score fires in it, how often a day, and whether that is at most ``most``."""
    hit = scores.where(F.abs(z_new) >= new_thresh).select(F.col(order).alias("_at"))
    inside = starts.join(hit, (F.col("_at") >= F.col("start")) & (F.col("_at") < F.col("start") + days), "left")  # a few windows
    return inside.groupBy("start").agg(F.count("_at").alias("firings")).select("start", "firings", (F.col("firings") / days).alias("per_day"), (F.col("firings") / days <= most).alias("passed"))
