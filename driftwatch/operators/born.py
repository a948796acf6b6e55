"""A Born machine over quantile bins: probabilities are squares of a tensor train's cells, sampled exactly.

It is kept in canonical form: all cores but one, the centre, are orthonormal, so that the sum of all squares is the
centre's own, a likelihood's gradient by the centre has two terms, and with the first core as centre each bin's conditional
probabilities, given those drawn before it, are the squared lengths of a few short vectors.
"""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranks, bins, and the greatest divergence between two fits, in nats, and time of a fit, in seconds, that pass.
RANK, BINS, MOST_NATS, MOST_SECONDS = 4, 8, 0.5, 30.0
#: Sweeps over the cores and back, steps at each core, and their length at first.
SWEEPS, STEPS, RATE = 30, 3, 0.12
TINY = 1e-150


class BornMachine:
    def __init__(self, reference: np.ndarray, rank: int = RANK, bins: int = BINS, seed: int = 3):
        self.edges = np.quantile(reference, np.arange(1, bins) / bins, axis=0)
        cells, n = self.bins(reference), reference.shape[1]
        #: What a bin stands for: the median of the reference's values in it.
        self.middles = [np.array([np.median(v) if len(v := reference[cells[:, k] == b, k]) else np.nan for b in range(bins)]) for k in range(n)]
        rng = np.random.default_rng(seed)
        sizes = [1, *(min(rank, bins ** min(k, n - k)) for k in range(1, n)), 1]
        self.cores = [1 + 0.3 * rng.standard_normal((a, bins, b)) for a, b in zip(sizes, sizes[1:])]
        for k in range(n - 1, 0, -1):
            self._to_left(k)
        self.cores[0] /= np.linalg.norm(self.cores[0])
        self._fit(cells)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges.T, x.T)])

    def _to_left(self, k: int) -> None:
        """Makes core k orthonormal and hands what is over to the one before it."""
        a, d, b = self.cores[k].shape
        q, r = np.linalg.qr(self.cores[k].reshape(a, d * b).T)
        self.cores[k] = q.T.reshape(-1, d, b)
        self.cores[k - 1] = np.einsum("adb,cb->adc", self.cores[k - 1], r)

    def _to_right(self, k: int) -> None:
        a, d, b = self.cores[k].shape
        q, r = np.linalg.qr(self.cores[k].reshape(a * d, b))
        self.cores[k] = q.reshape(a, d, -1)
        self.cores[k + 1] = np.einsum("ca,adb->cdb", r, self.cores[k + 1])

    def _climb(self, k: int, left: np.ndarray, at: np.ndarray, right: np.ndarray, rate: float) -> None:
        """Steps up the mean log-likelihood by the centre k, whose length stays 1."""
        core = self.cores[k] / np.linalg.norm(self.cores[k])
        for _ in range(STEPS):
            psi = np.einsum("na,nab,nb->n", left, core[:, at].transpose(1, 0, 2), right)
            psi = np.where(np.abs(psi) < TINY, TINY, psi)
            slope = np.zeros((core.shape[1], core.shape[0], core.shape[2]))
            np.add.at(slope, at, np.einsum("na,nb->nab", left / psi[:, None], right) * (2 / len(at)))
            slope = slope.transpose(1, 0, 2)
            slope -= core * (slope * core).sum()  # along the sphere
            length = np.linalg.norm(slope)
            if length < 1e-9:
                break
            core = core + rate * slope / max(1.0, length)
            core /= np.linalg.norm(core)
        self.cores[k] = core

    def _fit(self, cells: np.ndarray) -> None:
        n = len(self.cores)
        for sweep in range(SWEEPS):
            rate = RATE * (1 - sweep / SWEEPS) + 0.01
            right = [np.ones((len(cells), 1))]
            for k in range(n - 1, 0, -1):
                right.append(np.einsum("anb,nb->na", self.cores[k][:, cells[:, k]], right[-1]))
            left = [np.ones((len(cells), 1))]
            for k in range(n):
                self._climb(k, left[-1], cells[:, k], right[n - 1 - k], rate)
                if k < n - 1:
                    self._to_right(k)
                    left.append(np.einsum("na,anb->nb", left[-1], self.cores[k][:, cells[:, k]]))
            back = np.ones((len(cells), 1))
            for k in range(n - 1, -1, -1):
                self._climb(k, left[k], cells[:, k], back, rate)
                if k:
                    self._to_left(k)
                    back = np.einsum("anb,nb->na", self.cores[k][:, cells[:, k]], back)

    def log_cells(self, cells: np.ndarray) -> np.ndarray:
        """Logarithms of the probabilities of rows of bins."""
        value = np.ones((len(cells), 1))
        for k, core in enumerate(self.cores):
            value = np.einsum("na,anb->nb", value, core[:, cells[:, k]])
        return 2 * np.log(np.maximum(np.abs(value[:, 0]), TINY))

    def log_likelihood(self, x: np.ndarray) -> np.ndarray:
        return self.log_cells(self.bins(x))

    def sample(self, n: int, seed: int = 1) -> np.ndarray:
        """n rows of bins, core by core, all at once: a bin's probability given the bins before it is the squared length of
        what the cores so far make of it, since the cores behind are orthonormal."""
        rng, state, out = np.random.default_rng(seed), np.ones((n, 1)), []
        for core in self.cores:
            each = np.einsum("na,adb->ndb", state, core)
            p = (each**2).sum(2)
            upto = np.cumsum(p, axis=1)
            drawn = np.minimum((rng.random((n, 1)) * upto[:, -1:] >= upto).sum(1), core.shape[1] - 1)
            out.append(drawn)
            state = each[np.arange(n), drawn] / np.sqrt(np.maximum(p[np.arange(n), drawn], TINY))[:, None]
        return np.column_stack(out)

    def divergence(self, other: BornMachine, n: int = 10_000, seed: int = 1) -> float:
        """Of other from this one, in nats, by n samples of this one, taken as the values that their bins stand for."""
        cells = self.sample(n, seed)
        x = np.column_stack([m[c] for m, c in zip(self.middles, cells.T)])
        known = ~np.isnan(x).any(1)
        return float(np.mean(self.log_cells(cells[known]) - other.log_likelihood(x[known])))


def stability(returns: DataFrame, names: list[str], ref: int = 252, apart: int = 90, every: int = 252) -> DataFrame:
    """How alike two machines are, of ref days and of the ref days that begin apart days after their end: a row for each
    such pair from day 1, 1 + every, ... on: start, divergence, seconds (of the first fit), c4 and c5 (whether they pass).

    returns is numbered by t from 1. Each pair's days go to one task, some hundreds of rows; pairs run side by side.
    """
    length = 2 * ref + apart
    first = F.floor((F.col("t") - 1) / every)
    back = F.floor((F.col("t") - length - 1) / every) + 1
    dealt = returns.select("t", *names).withColumn("_pair", F.explode(F.sequence(F.greatest(F.lit(0).cast("bigint"), back), first)))

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        start, x = int(pdf["_pair"].iloc[0]) * every + 1, pdf[names].to_numpy()
        if len(x) < length:
            return pd.DataFrame({"start": [], "divergence": [], "seconds": []}).astype({"start": "int64", "divergence": "float64", "seconds": "float64"})
        began = time.perf_counter()
        one = BornMachine(x[:ref])
        seconds = time.perf_counter() - began
        return pd.DataFrame({"start": [start], "divergence": [one.divergence(BornMachine(x[ref + apart :]))], "seconds": [seconds]})

    parts = int(returns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = dealt.repartition(parts, "_pair").groupBy("_pair").applyInPandas(score, "start bigint, divergence double, seconds double")
    return out.withColumn("c4", F.abs("divergence") <= MOST_NATS).withColumn("c5", F.col("seconds") <= MOST_SECONDS)
