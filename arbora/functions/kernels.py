"""Named kernels: each as a numpy function of coordinate blocks and, where closed, as a Spark expression."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances, exactly zero where two points coincide."""
    out = np.zeros((len(x), len(y)))
    for k in range(x.shape[1]):
        out += (x[:, k][:, None] - y[:, k][None, :]) ** 2
    return np.sqrt(out)


@dataclass(frozen=True)
class Kernel:
    """``block(x, y)`` has the entries for all pairs of rows of x and y; ``symmetry`` is N, S or H."""

    name: str
    block: Callable[[np.ndarray, np.ndarray], np.ndarray]
    symmetry: str = "N"
    of_distance: Callable[[Column], Column] | None = None

    def column(self, x: Column, y: Column) -> Column:
        """The same entry for two ``array<double>`` columns."""
        if self.of_distance is None:
            raise ValueError(f"kernel {self.name} has no closed expression")
        return self.of_distance(F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)))


def _radial(name: str, f: Callable, symmetry: str = "S") -> Kernel:
    return Kernel(name, lambda x, y: f(distances(x, y)), symmetry, lambda d: f(d))


_PI4 = 4 * np.pi

KERNELS = {
    k.name: k
    for k in (
        _radial("laplace", lambda d: 1 / (_PI4 * d), "N"),
        _radial("reg_sym", lambda d: 1 / (1e-5 + _PI4 * d)),
        _radial("ex_inv5", lambda d: 1 / (1e-5 + d)),
        _radial("ex_inv1", lambda d: 1 / (1 + d)),
        Kernel("laplace_c", lambda x, y: (1 + 1j) / (_PI4 * distances(x, y))),
        Kernel("reg_sym_c", lambda x, y: (1 + 1j) / (1e-5 + _PI4 * distances(x, y)), "S"),
        Kernel("reg_herm", lambda x, y: (1 + 1j * np.sign(x[:, 0][:, None] - y[:, 0][None, :])) / (1e-5 + _PI4 * distances(x, y)), "H"),
    )
}
