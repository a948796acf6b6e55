"""Distributions over bins as tensor trains: a table of d^n cells held as n small cores."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Fixed value: the least probability whose logarithm is taken.
FLOOR = 1e-9


@dataclass
class TensorTrain:
    """Cores of shape (rank before, bins, rank after); a cell is the product of one slice of each."""

    cores: list[np.ndarray]

    def at(self, cells: np.ndarray) -> np.ndarray:
        """The values of cells, each a row of one bin a core."""
        value = np.ones((len(cells), 1))
        for k, core in enumerate(self.cores):
            value = np.einsum("na,anb->nb", value, core[:, cells[:, k], :])
        return value[:, 0]

    def total(self) -> float:
        """The sum of all cells, core by core."""
        value = np.ones(1)
        for core in self.cores:
            value = value @ core.sum(1)
        return float(value[0])

    @property
    def ranks(self) -> list[int]:
        return [core.shape[2] for core in self.cores[:-1]]


def compressed(table: np.ndarray, rank: int) -> tuple[TensorTrain, float]:
    """table as a train of that rank at most, axis by axis by truncated singular values (Oseledets, 2011), and a bound of
    its distance from the table (the root of the squares of all singular values left out)."""
    cores, left, rest, lost = [], 1, table.reshape(1, -1), 0.0
    for size in table.shape[:-1]:
        u, s, v = np.linalg.svd(rest.reshape(left * size, -1), full_matrices=False)
        kept = min(rank, len(s))
        lost += float((s[kept:] ** 2).sum())
        cores.append(u[:, :kept].reshape(left, size, kept))
        left, rest = kept, s[:kept, None] * v[:kept]
    return TensorTrain([*cores, rest.reshape(left, table.shape[-1], 1)]), lost**0.5


class BinnedCopula:
    """The joint distribution of quantile bins of a reference, compressed to a rank; values score the log of their cell's
    share of the train's total."""

    def __init__(self, reference: np.ndarray, rank: int, bins: int = 4):
        self.inner = np.quantile(reference, np.arange(1, bins) / bins, axis=0)
        table = np.zeros((bins,) * reference.shape[1])
        np.add.at(table, tuple(self.bins(reference).T), 1 / len(reference))
        self.train, self.error = compressed(table, rank)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(edges, column, "right") for edges, column in zip(self.inner.T, x.T)])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.train.at(self.bins(x)) / max(self.train.total(), FLOOR)

    def log_likelihood(self, x: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(self.probability(x), FLOOR))
