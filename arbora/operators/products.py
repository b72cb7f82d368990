"""Low-rank matrices as pairs of tables, and their products and sums with hierarchical matrices.

``LowRank`` stands for U V^T; both factors are ``(pos, val)`` with an array of the rank's length a row, real.
All work is by position or on rank x rank sums, so neither factor meets one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.operators import lowrank
from arbora.operators.hmatrix import SCHEMA, SEGMENT, HMatrix, _segments, _with_segments, pack, unpack
from arbora.sources.storage import durable


def _width(a: DataFrame) -> int:
    return a.select(F.size("val")).first()[0]


def gram(a: DataFrame, b: DataFrame) -> np.ndarray:
    """a^T b for two tables of rows, rank x rank on the driver; summed in parts first."""
    m, n = _width(a), _width(b)
    both = a.select("pos", F.col("val").alias("x")).join(b.select("pos", F.col("val").alias("y")), "pos")
    row = both.agg(*[F.coalesce(F.sum(F.col("x")[i] * F.col("y")[j]), F.lit(0.0)).alias(f"g{i}_{j}") for i in range(m) for j in range(n)]).first()
    return np.array(list(row), float).reshape(m, n)


def times_small(a: DataFrame, c: np.ndarray) -> DataFrame:
    """Each row of a table times a small matrix."""
    row = lambda j: sum((F.col("val")[i] * float(c[i, j]) for i in range(1, c.shape[0])), F.col("val")[0] * float(c[0, j]))
    return a.select("pos", F.array(*[row(j) for j in range(c.shape[1])]).alias("val"))


@dataclass(frozen=True)
class LowRank:
    u: DataFrame
    v: DataFrame

    @property
    def rank(self) -> int:
        return _width(self.u)

    def times(self, x: DataFrame, trans: str = "N") -> DataFrame:
        """op(U V^T) x for x ``(pos, val)``, val a double or an array of right sides."""
        left, right = (self.u, self.v) if trans == "N" else (self.v, self.u)
        many = dict(x.dtypes)["val"].startswith("array")
        rows = x if many else x.select("pos", F.array("val").alias("val"))
        out = times_small(left, gram(right, rows))
        return out if many else out.select("pos", F.col("val")[0].alias("val"))

    def transposed(self) -> LowRank:
        return LowRank(self.v, self.u)

    def scaled(self, k: float) -> LowRank:
        return LowRank(self.u.select("pos", F.transform("val", lambda x: x * float(k)).alias("val")), self.v)

    def plus(self, other: LowRank) -> LowRank:
        """The exact sum, of the ranks' sum; both cover the same positions."""
        side = lambda a, b: a.join(b.select("pos", F.col("val").alias("w")), "pos").select("pos", F.concat("val", "w").alias("val"))
        return LowRank(side(self.u, other.u), side(self.v, other.v))

    def rounded(self, eps: float) -> LowRank:
        """The least rank within eps of this matrix, relative to its Frobenius norm, by the factors' Gram matrices."""
        roots = []
        for side in (self.u, self.v):
            values, vectors = np.linalg.eigh(gram(side, side))
            keep = values > values.max(initial=0.0) * 1e-14
            if not keep.any():
                return LowRank(times_small(self.u, np.zeros((self.rank, 1))), times_small(self.v, np.zeros((self.rank, 1))))
            roots.append((vectors[:, keep], np.sqrt(values[keep])))
        (p, s), (q, t) = roots
        a, w, b = np.linalg.svd((s[:, None] * p.T) @ (q * t))
        k = lowrank.truncation_rank(w, eps)
        half = np.sqrt(w[:k])
        return LowRank(times_small(self.u, (p / s) @ a[:, :k] * half), times_small(self.v, (q / t) @ b[:k].T * half))

    def frobenius(self) -> float:
        return float(np.sqrt(max(0.0, np.trace(gram(self.u, self.u) @ gram(self.v, self.v)))))


def low_rank_product(a: LowRank, b: LowRank) -> LowRank:
    """(U_a V_a^T)(U_b V_b^T), of b's rank."""
    return LowRank(times_small(a.u, gram(a.v, b.u)), b.v)


def hmatrix_low_rank(h: HMatrix, a: LowRank) -> LowRank:
    """H (U V^T)."""
    return LowRank(h.product(a.u), a.v)


def low_rank_hmatrix(a: LowRank, h: HMatrix) -> LowRank:
    """(U V^T) H."""
    return LowRank(a.u, h.product(a.v, "T"))


def hmatrix_matrix_low_rank(h: HMatrix, m: DataFrame, n: DataFrame, eps: float = 0.0) -> LowRank:
    """H M N^T for tall tables M and N, as a low-rank matrix; rounded with eps."""
    out = LowRank(h.product(m), n)
    return out.rounded(eps) if eps else out


def matrix_hmatrix(rows: DataFrame, h: HMatrix, trans: str = "N") -> DataFrame:
    """M op(H) for a flat M given by columns, ``(pos, val)`` with M's column as the array; the result likewise."""
    if trans == "C" or h.options.symmetry == "H":
        raise ValueError("real products only")
    return h.product(rows, "T" if trans == "N" else "N")


def add_low_rank(h: HMatrix, a: LowRank, eps: float | None = None) -> HMatrix:
    """H + U V^T: added to dense leaves, a rounded sum in low-rank ones; each leaf gets the rows of the factors that it covers."""
    if h.options.symmetry != "N":
        raise ValueError("a matrix stored by half takes no unsymmetric summand")
    tol = h.options.eps if eps is None else eps
    own = _with_segments(h.leaves, _segments(a.u, "val"), "t_off", "t_size", "us")
    own = _with_segments(own, _segments(a.v, "val"), "s_off", "s_size", "vs")
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                cut = lambda got, off, n: np.stack(got)[off % SEGMENT : off % SEGMENT + n].astype(float)
                u, v = cut(row.us, row.t_off, row.t_size), cut(row.vs, row.s_off, row.s_size).T
                out = {c: getattr(row, c) for c in names}
                if row.storage == "dense":
                    out["dense"] = pack(unpack(row.dense, row.t_size, row.s_size, row.dtype) + u @ v)
                else:
                    p, q = lowrank.add((unpack(row.u, row.t_size, row.rank, row.dtype), unpack(row.v, row.rank, row.s_size, row.dtype)), (u, v), tol)
                    out |= {"u": pack(p), "v": pack(q), "rank": p.shape[1]}
                rows.append(out)
            if rows:
                yield pd.DataFrame(rows)[names]

    return replace(h, leaves=durable(own.mapInPandas(run, SCHEMA)), stream=None)
