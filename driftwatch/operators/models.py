"""Rank transforms, rank correlation, two-sample tests, and copula scores of daily returns."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.operators.windows import average_rank

#: Degrees of freedom tried, how close to 0 and 1 a rank may come.
DEGREES, EDGE = (3, 5, 10, 20), 1e-6


def rank_uniform(rows: DataFrame, value: str, partition: list[str]) -> DataFrame:
    """u: average ranks over n + 1."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*partition))
    u = average_rank(F.col(value), partition) / (n + 1)
    return rows.withColumn("u", F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), u)))


def ecdf(rows: DataFrame, value: str, is_reference: str, partition: list[str]) -> DataFrame:
    """u: how many reference values are at most this one, over their number + 1."""
    w = Window.partitionBy(*partition)
    upto = F.count(F.when(F.col(is_reference), 1)).over(w.orderBy(value).rangeBetween(Window.unboundedPreceding, 0))
    n = F.count(F.when(F.col(is_reference), 1)).over(w)
    return rows.withColumn("u", F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), upto / (n + 1))))


def ks_two_sample(rows: DataFrame, value: str, is_first: str, key: str) -> DataFrame:
    """Largest distance between the distributions of a key's first and other rows."""
    w = Window.partitionBy(key)
    upto = w.orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    share = lambda cond: F.count(F.when(cond, 1)).over(upto) / F.count(F.when(cond, 1)).over(w)
    first = F.col(is_first)
    return rows.select(key, F.abs(share(first) - share(~first)).alias("d")).groupBy(key).agg(F.coalesce(F.max("d"), F.lit(0.0)).alias("ks"))


def kendall_tau(wide: DataFrame, order: str, names: list[str], days: int = 252) -> DataFrame:
    """tau-b of each pair of columns within each block of so many rows in order: block, x, y, tau.

    Rows are compared within a block only, so the work grows with the rows; the last block may be shorter.
    """
    rows = wide.withColumn("block", F.floor((F.col(order) - 1) / days))
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col(f"a.{order}") < F.col(f"b.{order}")))
    sign = {n: F.signum(F.col(f"a.{n}") - F.col(f"b.{n}")) for n in names}
    out = []
    for i, x in enumerate(names):
        for y in names[i + 1 :]:
            tau = F.sum(sign[x] * sign[y]) / F.sqrt(F.sum(F.abs(sign[x])) * F.sum(F.abs(sign[y])))
            out.append(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), tau.alias("tau")))
    return pairs.groupBy(F.col("a.block").alias("block")).agg(F.array(*out).alias("p")).select("block", F.inline("p"))


def joint_pmf(wide: DataFrame, names: list[str], bins: int = 4) -> DataFrame:
    """How often each combination of quantile bins occurs; edges are the columns' quantiles."""
    shares = [k / bins for k in range(1, bins)]
    edges = wide.agg(*(F.percentile(F.col(n), F.array(*map(F.lit, shares))).alias(f"e_{n}") for n in names))
    cell = [sum((F.when(F.col(n) > F.col(f"e_{n}")[k], 1).otherwise(0) for k in range(1, bins - 1)), F.when(F.col(n) > F.col(f"e_{n}")[0], 1).otherwise(0)).alias(f"b_{n}") for n in names]
    cells = wide.join(F.broadcast(edges), F.lit(True)).select(*cell)  # one row of edges
    n = Window.partitionBy()
    return cells.groupBy(*(f"b_{x}" for x in names)).agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(n))


def t_ppf(u: np.ndarray, df: int) -> np.ndarray:
    """Quantiles of Student's t by bisection on its distribution, given by a finite sum for whole degrees of freedom."""

    def cdf(x: np.ndarray) -> np.ndarray:
        theta = np.arctan(x / math.sqrt(df))
        c2 = np.cos(theta) ** 2
        if df % 2:
            term, total = np.cos(theta), np.zeros_like(theta)
            for k in range(1, (df - 1) // 2 + 1):
                total = total + term
                term = term * c2 * (2 * k) / (2 * k + 1)
            return 0.5 + (theta + np.sin(theta) * total) / math.pi
        term, total = np.ones_like(theta), np.zeros_like(theta)
        for k in range(1, df // 2 + 1):
            total = total + term
            term = term * c2 * (2 * k - 1) / (2 * k)
        return 0.5 + 0.5 * np.sin(theta) * total

    low, high = np.full(u.shape, -1e6), np.full(u.shape, 1e6)
    for _ in range(80):
        middle = (low + high) / 2
        below = cdf(middle) < u
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


def nearest_positive(r: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh((r + r.T) / 2)
    fixed = (vectors * np.maximum(values, EDGE)) @ vectors.T
    d = np.sqrt(np.diag(fixed))
    return fixed / np.outer(d, d)


def rank_correlation(x: np.ndarray) -> np.ndarray:
    """sin(pi tau / 2) of each pair of columns; 0 where tau isn't defined."""
    n, k = x.shape
    signs = [np.sign(x[:, None, i] - x[None, :, i])[np.triu_indices(n, 1)] for i in range(k)]
    out = np.eye(k)
    for i in range(k):
        for j in range(i):
            scale = math.sqrt(np.abs(signs[i]).sum() * np.abs(signs[j]).sum())
            tau = float(signs[i] @ signs[j]) / scale if scale else 0.0
            out[i, j] = out[j, i] = math.sin(math.pi * tau / 2)
    return out


def average_uniform(x: np.ndarray) -> np.ndarray:
    """Each column's ranks over n + 1; equal values share the mean of theirs."""
    ordered = np.sort(x, axis=0)
    rank = lambda k: (np.searchsorted(ordered[:, k], x[:, k], "left") + np.searchsorted(ordered[:, k], x[:, k], "right") + 1) / 2
    return np.clip(np.column_stack([rank(k) for k in range(x.shape[1])]) / (len(x) + 1), EDGE, 1 - EDGE)


class TCopula:
    """Student's t copula: rank correlation, and the degrees of freedom of greatest likelihood on average ranks, the first
    of equal ones. Gaussian: no degrees of freedom. Values are scored by the reference's empirical distribution."""

    def __init__(self, reference: np.ndarray, gaussian: bool = False):
        self.sorted = np.sort(reference, axis=0)
        self.r = nearest_positive(rank_correlation(reference))
        u = average_uniform(reference)
        self.df = None if gaussian else max(DEGREES, key=lambda df: (self.density(u, df).sum(), -df))

    def uniform(self, x: np.ndarray) -> np.ndarray:
        n = len(self.sorted)
        u = np.column_stack([np.searchsorted(self.sorted[:, k], x[:, k], "right") for k in range(x.shape[1])]) / (n + 1)
        return np.clip(u, EDGE, 1 - EDGE)

    def density(self, u: np.ndarray, df: int | None) -> np.ndarray:
        inverse, log_det, n = np.linalg.inv(self.r), np.linalg.slogdet(self.r)[1], u.shape[1]
        if df is None:
            z = np.vectorize(NormalDist().inv_cdf)(u)
            return -0.5 * log_det - 0.5 * np.einsum("ij,jk,ik->i", z, inverse - np.eye(n), z)
        ranks, at = np.unique(u, return_inverse=True)  # columns share most ranks
        z = t_ppf(ranks, df)[at].reshape(u.shape)
        q = np.einsum("ij,jk,ik->i", z, inverse, z)
        constant = math.lgamma((df + n) / 2) + (n - 1) * math.lgamma(df / 2) - n * math.lgamma((df + 1) / 2)
        return constant - 0.5 * log_det - (df + n) / 2 * np.log1p(q / df) + ((df + 1) / 2 * np.log1p(z * z / df)).sum(1)

    def log_likelihood(self, x: np.ndarray) -> np.ndarray:
        return self.density(self.uniform(x), self.df)


def _z(model: TCopula, reference: np.ndarray, window: np.ndarray, roll: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling log-likelihoods of the window, and their z against those of the reference."""
    rolled = lambda x: np.convolve(x, np.ones(roll), "valid")
    null, own = rolled(model.log_likelihood(reference)), rolled(model.log_likelihood(window))
    return own, (own - null.mean()) / max(null.std(ddof=1), 1e-12)


def walk_forward(returns: DataFrame, names: list[str], ref: int = 252, roll: int = 5, every: int = 20) -> DataFrame:
    """z of each day's rolling log-likelihood under a copula of the ref days that end roll days before its block.

    A block of ``every`` days is fitted once. Its rows are its own and the ref + roll before: each task holds some
    hundred daily rows per block, and blocks are independent.
    """
    first = ref + roll
    block = F.floor((F.col("t") - 1 - first) / every)
    last_block = F.ceil(F.lit((ref + roll + every - 1) / every)).cast("int")
    # a day serves its own block and those after it that reach back to it
    dealt = returns.withColumn("block", F.explode(F.sequence(F.greatest(F.lit(0).cast("bigint"), block), block + last_block))).where(F.col("block") >= 0)

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        start = int(pdf["block"].iloc[0]) * every + first + 1  # the block's first day
        x, t = pdf[names].to_numpy(), pdf["t"].to_numpy()
        reference = x[(t >= start - ref - roll) & (t < start - roll)]
        window = (t >= start - roll + 1) & (t < start + every)
        if len(reference) < ref or window.sum() < roll:
            return pd.DataFrame({"t": [], "rolling_ll": [], "z": [], "df": []}).astype({"t": "int64", "df": "int32"})
        model = TCopula(reference)
        own, z = _z(model, reference, x[window], roll)
        return pd.DataFrame({"t": t[window][roll - 1 :], "rolling_ll": own, "z": z, "df": np.int32(model.df)})

    # so many tasks, although the rows are few: adaptive execution would put all blocks into one
    parts = int(returns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "block").groupBy("block").applyInPandas(score, "t bigint, rolling_ll double, z double, df int")


def dependence_shift(returns: DataFrame, names: list[str], ref: int = 252, roll: int = 5, z_thresh: float = 3.0) -> DataFrame:
    """One row: z of the last roll days under a copula of the oldest ref of the last ref + 3 * roll days; symbol, t, price
    (the rolling log-likelihood), score, df, alert. No row with fewer than ref days, or without spread.

    A job for a schedule: it looks at some hundred daily rows, which one task fits and scores.
    """
    lookback = ref + 3 * roll
    last = returns.orderBy(F.desc("t")).limit(lookback)

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        x = pdf[names].to_numpy()
        if len(x) < ref:
            return pd.DataFrame({"t": [], "price": [], "score": [], "df": []}).astype({"t": "int64", "df": "int32"})
        model = TCopula(x[:ref])
        null = np.convolve(model.log_likelihood(x[:ref]), np.ones(roll), "valid")
        own, sd = float(model.log_likelihood(x[-roll:]).sum()), float(null.std(ddof=1))
        return pd.DataFrame({"t": [int(pdf["t"].iloc[-1])], "price": [own], "score": [(own - null.mean()) / max(sd, 1e-12)], "df": [np.int32(model.df)]})[[sd >= 1e-12]]

    out = last.groupBy(F.lit("all").alias("_g")).applyInPandas(score, "t bigint, price double, score double, df int")
    return out.select(F.concat_ws(",", *map(F.lit, names)).alias("symbol"), "t", "price", "score", "df", (F.abs("score") >= z_thresh).alias("alert"))


def gamma_upper(a: float, x: float) -> float:
    """Q(a, x), the regularised upper incomplete gamma function, in a bounded memory and some root of a steps: the series
    below a + 1, above it the continued fraction. For a whole a it is P(N < a) of a Poisson variable of mean x."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-17:
            k += 1
            term *= x / k
            total += term
        return 1 - scale * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h, k = d, 0
    while True:
        k += 1
        step = -k * (k - a)
        b += 2
        d, c = step * d + b, b + step / c
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = c if abs(c) > 1e-300 else 1e-300
        h *= c * d
        if abs(c * d - 1) < 1e-16 or k > 10_000_000:
            return scale * h


def poisson_interval(k: int, exposure: float, level: float = 0.95) -> tuple[float, float]:
    """Garwood's interval of a rate: k events in an exposure."""
    if exposure <= 0:
        return 0.0, 0.0
    tail = (1 - level) / 2

    def solve(n: int, goal: float) -> float:
        """The mean at which n or more events have that probability."""
        spread = 10 * math.sqrt(n) + 20
        low, high = max(0.0, n - spread), n + spread
        while high - low > 1e-15 * high:
            m = (low + high) / 2
            if m in (low, high):
                break
            low, high = (m, high) if 1 - gamma_upper(n, m) < goal else (low, m)
        return (low + high) / 2

    return (solve(k, tail) / exposure if k else 0.0), solve(k + 1, 1 - tail) / exposure


def poisson_intervals(rows: DataFrame, k: str, exposure: str) -> DataFrame:
    """rate_low and rate_high beside each row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            ends = [poisson_interval(int(a), float(b)) for a, b in zip(pdf[k], pdf[exposure])]
            yield pdf.assign(rate_low=[a for a, _ in ends], rate_high=[b for _, b in ends])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, schema + ", rate_low double, rate_high double")
