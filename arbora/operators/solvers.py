"""Krylov solvers over a distributed operator, with Schwarz preconditioners and a coarse space.

The operator is a Spark job a step; the driver holds the Krylov basis (positions x
steps). Local solves run by owner with ``applyInPandas``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.operators.hmatrix import HMatrix, block_of, positions

Operator = Callable[[np.ndarray], np.ndarray]


@dataclass
class Result:
    x: np.ndarray
    iterations: int
    residuals: list[float] = field(default_factory=list)

    @property
    def infos(self) -> dict[str, str]:
        return {"Nb_it": str(self.iterations), "Residual": f"{self.residuals[-1]:.3e}" if self.residuals else "0"}


def distributed(h: HMatrix) -> Operator:
    """x -> A x as a Spark job."""
    spark = h.leaves.sparkSession

    def apply(x: np.ndarray) -> np.ndarray:
        frame = spark.createDataFrame(pd.DataFrame({"pos": np.arange(len(x)), "val": x}))
        got = h.product(frame).toPandas()
        y = np.zeros(h.shape[0])
        y[got["pos"].to_numpy()] = got["val"].to_numpy()
        return y

    return apply


def cg(a: Operator, b: np.ndarray, m: Operator = lambda r: r, tol: float = 1e-6, most: int = 200) -> Result:
    x, r = np.zeros_like(b), b.copy()
    z = m(r)
    p, rz, norm = z.copy(), r @ z, np.linalg.norm(b) or 1.0
    out = Result(x, 0, [np.linalg.norm(r) / norm])
    while out.residuals[-1] >= tol and out.iterations < most:
        q = a(p)
        step = rz / (p @ q)
        x += step * p
        r -= step * q
        z = m(r)
        rz, old = r @ z, rz
        p = z + rz / old * p
        out.iterations += 1
        out.residuals.append(float(np.linalg.norm(r) / norm))
    return out


def gmres(a: Operator, b: np.ndarray, m: Operator = lambda r: r, tol: float = 1e-6, most: int = 200) -> Result:
    """Right-preconditioned, without restart."""
    norm = np.linalg.norm(b) or 1.0
    basis, h, out = [b / norm], np.zeros((most + 1, most), b.dtype), Result(np.zeros_like(b), 0, [1.0])
    for k in range(most):
        w = a(m(basis[k]))
        for i, v in enumerate(basis):
            h[i, k] = np.vdot(v, w)
            w = w - h[i, k] * v
        h[k + 1, k] = np.linalg.norm(w)
        e = np.zeros(k + 2, b.dtype)
        e[0] = norm
        y, *_ = np.linalg.lstsq(h[: k + 2, : k + 1], e, rcond=None)
        out.iterations = k + 1
        out.residuals.append(float(np.linalg.norm(e - h[: k + 2, : k + 1] @ y) / norm))
        if out.residuals[-1] < tol or h[k + 1, k] == 0:
            break
        basis.append(w / h[k + 1, k])
    out.x = m(np.stack(basis[: out.iterations], axis=1) @ y)
    return out


def gmres_columns(a: Operator, b: np.ndarray, m: Operator, tol: float, most: int = 60) -> np.ndarray:
    """Right-preconditioned GMRES for all columns of b at once, each with its own basis; at most ``most`` steps."""
    norm = np.linalg.norm(b, axis=0)
    over = lambda v, by: np.divide(v, by, out=np.zeros_like(v), where=by > 0)
    basis, h, width = [over(b, norm)], np.zeros((b.shape[1], most + 1, most)), b.shape[1]
    for k in range(most):
        w = a(m(basis[k]))
        for i, v in enumerate(basis):
            h[:, i, k] = (v * w).sum(axis=0)
            w = w - h[:, i, k] * v
        h[:, k + 1, k] = np.linalg.norm(w, axis=0)
        e = np.zeros(k + 2)
        e[0] = 1.0
        y = [np.linalg.lstsq(h[c, : k + 2, : k + 1], e, rcond=None)[0] for c in range(width)]
        if max(float(np.linalg.norm(e - h[c, : k + 2, : k + 1] @ y[c])) for c in range(width) if norm[c] > 0) < tol:
            break
        basis.append(over(w, h[:, k + 1, k]))
    total = sum(v * np.array([c[i] for c in y]) for i, v in enumerate(basis[: len(y[0])]))
    return m(total * norm)


def richardson(a: Operator, b: np.ndarray, m: Operator = lambda r: r, tol: float = 1e-6, most: int = 200, damping: float = 1.0) -> Result:
    x, norm, out = np.zeros_like(b), np.linalg.norm(b) or 1.0, Result(np.zeros_like(b), 0)
    while True:
        r = b - a(x)
        out.residuals.append(float(np.linalg.norm(r) / norm))
        if out.residuals[-1] < tol or out.iterations >= most:
            out.x = x
            return out
        x = x + damping * m(r)
        out.iterations += 1


KRYLOV = {"cg": cg, "gmres": gmres, "richardson": richardson}


def local_inverses(h: HMatrix, overlap: dict[int, np.ndarray] | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By owner the positions of its (overlapping) subdomain and the inverse of the matrix there, made on the executors."""
    inner = {int(r.owner): (int(r.lo), int(r.hi)) for r in h.leaves.groupBy("owner").agg(F.min("t_off").alias("lo"), F.max(F.col("t_off") + F.col("t_size")).alias("hi")).collect()}
    wanted = {o: np.unique(np.concatenate([np.arange(lo, hi), (overlap or {}).get(o, np.zeros(0, int))])).astype(int) for o, (lo, hi) in inner.items()}
    symmetry = h.options.symmetry
    need = [(o, int(p)) for o, own in wanted.items() for p in own]
    spark = h.leaves.sparkSession
    ranges = spark.createDataFrame([(o, int(own.min()), int(own.max())) for o, own in wanted.items()], "sub int, lo long, hi long")
    touches = lambda off, size: (F.col(off) <= F.col("hi")) & (F.col(off) + F.col(size) > F.col("lo"))
    pairs = h.leaves.join(F.broadcast(ranges), touches("t_off", "t_size") & touches("s_off", "s_size"))
    assert need

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own = wanted[int(key[0])]
        place = {int(p): k for k, p in enumerate(own)}
        a = np.zeros((len(own), len(own)))
        for row in frame.itertuples(index=False):
            block = block_of(row).real
            i = [k for k in range(row.t_size) if row.t_off + k in place]
            j = [k for k in range(row.s_size) if row.s_off + k in place]
            if i and j:
                gi, gj = [place[row.t_off + k] for k in i], [place[row.s_off + k] for k in j]
                a[np.ix_(gi, gj)] = block[np.ix_(i, j)]
                if row.mirror and symmetry != "N":
                    a[np.ix_(gj, gi)] = block[np.ix_(i, j)].T
        return pd.DataFrame({"sub": [int(key[0])], "inverse": [np.linalg.inv(a).ravel()]})

    got = pairs.groupBy("sub").applyInPandas(run, "sub int, inverse array<double>").collect()
    return {r.sub: (wanted[r.sub], np.asarray(r.inverse).reshape(len(wanted[r.sub]), -1)) for r in got}


def schwarz(local: dict[int, tuple[np.ndarray, np.ndarray]], inner: dict[int, np.ndarray] | None = None) -> Operator:
    """Additive Schwarz: sum of R_i^T A_i^-1 R_i; with ``inner`` restricted (RAS): only each subdomain's own positions are kept."""

    def apply(r: np.ndarray) -> np.ndarray:
        out = np.zeros_like(r)
        for owner, (own, inverse) in local.items():
            z = inverse @ r[own]
            if inner is not None:
                z = np.where(np.isin(own, inner[owner]), z, 0)
            out[own] += z
        return out

    return apply


def geneo(a_local: np.ndarray, b_local: np.ndarray, nu: int = 2, threshold: float | None = None) -> np.ndarray:
    """Coarse vectors of one subdomain: leading eigenvectors of a u = lambda b u."""
    values, vectors = np.linalg.eig(np.linalg.solve(b_local, a_local))
    order = np.argsort(-np.abs(values), kind="stable")
    keep = order[:nu] if threshold is None else order[np.abs(values[order]) > threshold]
    return vectors[:, keep].real


def two_level(one: Operator, z: np.ndarray, a: Operator) -> Operator:
    """Additive coarse correction: M r + Z E^-1 Z^T r with E = Z^T A Z."""
    e = z.T @ np.stack([a(c) for c in z.T], axis=1)

    def apply(r: np.ndarray) -> np.ndarray:
        return one(r) + z @ np.linalg.solve(e, z.T @ r)

    return apply
