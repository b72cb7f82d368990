"""Compression of a kernel block into factors U (m x r) and V (r x n), and arithmetic on such factors.

A compressor gets ``entries(rows, cols)``, a function that gives any sub-block, and
the shape; it returns the factors, or None if the block does not pay off at the
wanted accuracy (more numbers than the dense block) and is to be kept dense.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Entries = Callable[[np.ndarray, np.ndarray], np.ndarray]
Factors = tuple[np.ndarray, np.ndarray]
_TINY = 1e-15
#: Relative accuracy that double precision leaves to a residual.
_ROUNDING = 1e-14


def truncation_rank(s: np.ndarray, eps: float) -> int:
    """Least rank, one at least, whose discarded tail is below eps of the whole in the Frobenius norm."""
    total = np.linalg.norm(s)
    if total == 0:
        return len(s)
    tail = np.sqrt(np.cumsum(s[::-1] ** 2)[::-1])
    below = np.flatnonzero(tail[1:] < eps * total)
    return int(below[0]) + 1 if len(below) else len(s)


def pays(rank: int, m: int, n: int) -> bool:
    return rank * (m + n) <= m * n


#: Rows and columns of the largest part of a block that is held at once by svd and by full_aca.
SVD_TILE, CROSS_TILE = 1024, 512


def _join(a: Factors, b: Factors, beside: bool, eps: float) -> Factors:
    """Rounded factors of two blocks side by side, or one above the other."""
    (ua, va), (ub, vb) = a, b
    zero = lambda m, n: np.zeros((m, n), np.result_type(ua, ub))
    if beside:
        return recompress(np.hstack([ua, ub]), np.block([[va, zero(len(va), vb.shape[1])], [zero(len(vb), va.shape[1]), vb]]), eps)
    return recompress(np.block([[ua, zero(len(ua), ub.shape[1])], [zero(len(ub), ua.shape[1]), ub]]), np.vstack([va, vb]), eps)


def _in_tiles(tile: Callable, most: int, entries: Entries, m: int, n: int, eps: float) -> Factors:
    """Every entry is read, but no more than ``most`` rows and columns at once: longer sides are halved, the halves' factors joined.

    ``tile(a, eps)`` gives factors of an array. Errors of the parts, each relative to its own norm, and of the roundings above
    add up to at most ``eps`` of the whole.
    """
    levels = sum(max(0, int(np.ceil(np.log2(k / most)))) for k in (m, n))
    own = max(eps / (2 * levels + 2), min(eps, _ROUNDING)) if levels else eps

    def part(r0: int, r1: int, c0: int, c1: int) -> Factors:
        h, w = r1 - r0, c1 - c0
        if max(h, w) <= most:
            return tile(entries(np.arange(r0, r1), np.arange(c0, c1)), own)
        if h >= w:
            mid = r0 + h // 2
            return _join(part(r0, mid, c0, c1), part(mid, r1, c0, c1), False, own)
        mid = c0 + w // 2
        return _join(part(r0, r1, c0, mid), part(r0, r1, mid, c1), True, own)

    u, v = part(0, m, 0, n)
    return recompress(u, v, eps / 2) if levels else (u, v)


def _ranged_svd(a: np.ndarray, eps: float) -> Factors:
    """Truncated SVD; the range of larger arrays is found by random vectors and taken if what lies outside, which is measured, is below eps / 10."""
    k, least = 32, min(a.shape)
    q = np.zeros((len(a), 0), a.dtype)
    total = np.linalg.norm(a)
    rng = np.random.default_rng(0)
    bound = max(eps / 10, min(eps / 2, _ROUNDING / 4))
    while 4 * k <= least and total:
        q, _ = np.linalg.qr(a @ rng.standard_normal((a.shape[1], k)))
        core = q.conj().T @ a
        if np.linalg.norm(a - q @ core) <= bound * total:
            u, s, v = np.linalg.svd(core, full_matrices=False)
            r = truncation_rank(s, eps)
            return q @ u[:, :r] * s[:r], v[:r]
        k *= 2
    u, s, v = np.linalg.svd(a, full_matrices=False)
    r = truncation_rank(s, eps) if s.any() else 0
    return u[:, :r] * s[:r], v[:r]


def svd(entries: Entries, m: int, n: int, eps: float, rank: int = -1) -> Factors | None:
    if rank > 0:
        u, s, v = np.linalg.svd(entries(np.arange(m), np.arange(n)), full_matrices=False)
        r = min(rank, len(s))
        return u[:, :r] * s[:r], v[:r]
    u, v = _in_tiles(_ranged_svd, SVD_TILE, entries, m, n, eps)
    return (u, v) if u.shape[1] and u.any() and pays(u.shape[1], m, n) else None


def _full_crosses(rest: np.ndarray, eps: float, rank: int, most: int) -> Factors | None:
    """Crosses through the largest entry of the residual, which overwrites the array; None if over ``most`` are needed."""
    total, us, vs = np.linalg.norm(rest), [], []
    size, cross = np.empty(rest.shape), np.empty_like(rest)
    while True:
        if rank > 0 and len(us) == min(rank, *rest.shape) or rank <= 0 and us and np.linalg.norm(rest) <= eps * total:
            break
        if rank <= 0 and len(us) >= most:
            return None
        i, j = divmod(int(np.abs(rest, out=size).argmax()), rest.shape[1])
        if size[i, j] < _TINY:
            break
        us.append(rest[:, j] / rest[i, j])
        vs.append(rest[i].copy())
        rest -= np.outer(us[-1], vs[-1], out=cross)
    return (np.stack(us, axis=1), np.stack(vs)) if us else (np.zeros((len(rest), 0), rest.dtype), np.zeros((0, rest.shape[1]), rest.dtype))


def full_aca(entries: Entries, m: int, n: int, eps: float, rank: int = -1) -> Factors | None:
    """Crosses through the largest entry of the residual until its norm is small; larger blocks in tiles."""
    most = m * n // (m + n)
    if rank > 0 or max(m, n) <= CROSS_TILE:
        out = _full_crosses(entries(np.arange(m), np.arange(n)).copy(), eps, rank, most)
    else:
        out = _in_tiles(lambda a, own: _full_crosses(a.copy(), own, -1, min(a.shape)) or (a, np.eye(a.shape[1], dtype=a.dtype)), CROSS_TILE, entries, m, n, eps)
    return out if out is not None and out[0].shape[1] and pays(out[0].shape[1], m, n) | (rank > 0) else None


#: Rows of the residual, spread over the block, that are looked at before crosses stop.
PROBES = 16


def _crosses(rows_of: Callable, column_of: Callable, m: int, n: int, eps: float, rank: int) -> Factors | None:
    """Adaptive cross approximation by partial pivoting; ties take the last index.

    A small step or an empty row says little where rows repeat: the largest entry of the last column is then in a copy of the
    row just taken, whose residual is rounding. So crosses stop only if ``PROBES`` rows spread over the block (others each
    time) are within eps too; else they go on from the one that is furthest off.
    """
    us = vs = np.zeros((0, 0))
    free_rows, free_cols = np.ones(m, bool), np.ones(n, bool)
    i, norm2, k, asked = 0, 0.0, 0, 0
    last = lambda a, free: int(len(a) - 1 - np.argmax(np.where(free, np.abs(a), -1.0)[::-1]))
    residual = lambda i: rows_of([i])[0] - (us[:k, i] @ vs[:k] if k else 0)

    def furthest() -> int | None:
        """A probed row to go on with, or None if what is left is within eps, or empty with a fixed rank."""
        nonlocal asked
        rows = np.flatnonzero(free_rows)
        # odd multiples of a golden step give other rows each time
        rows = rows[np.unique(((np.arange(PROBES) + 0.618 * asked % 1) * len(rows) / PROBES).astype(int))] if len(rows) > PROBES else rows
        asked += 1
        rest = rows_of(rows) - (us[:k, rows].T @ vs[:k] if k else 0)
        own = np.einsum("ij,ij->i", rest.conj(), rest).real
        # columns taken before are zero but for rounding
        empty = np.abs(rest[:, free_cols]).max(axis=1, initial=0.0) < _TINY
        free_rows[rows[empty]] = False
        left = float(own.sum())
        found = None if empty.all() else int(rows[np.where(empty, -1.0, own).argmax()])
        bound = max(eps, _ROUNDING) if rank <= 0 else 0.0
        return None if found is None or left * m / len(rows) <= bound**2 * norm2 else found

    while k < min(m, n):
        if rank > 0 and k == rank:
            break
        if rank <= 0 and not pays(k + 1, m, n):
            return None
        free_rows[i] = False
        r = residual(i)
        j = last(r, free_cols)
        small = abs(r[j]) < _TINY
        if not small:
            free_cols[j] = False
            v = r / r[j]
            u = column_of(j) - vs[:k, j] @ us[:k] if k else column_of(j)
            step2 = float(np.vdot(u, u).real * np.vdot(v, v).real)
            norm2 += step2 + (2 * float(((us[:k].conj() @ u) * (vs[:k].conj() @ v)).sum().real) if k else 0.0)
            if k == len(us):
                grown = np.zeros((max(16, 2 * k), m + n), np.result_type(u, v))
                grown[:k, :m], grown[:k, m:] = us[:k] if k else 0, vs[:k] if k else 0
                us, vs = grown[:, :m], grown[:, m:]
            us[k], vs[k] = u, v
            k += 1
            small = rank <= 0 and np.sqrt(step2) <= eps * np.sqrt(max(norm2, _TINY**2))
        if not free_rows.any():
            break
        if small:
            onward = furthest()
            if onward is None:
                break
            i = onward
        else:
            i = last(us[k - 1], free_rows)
    return (us[:k].T.copy(), vs[:k].copy()) if k else None


def partial_aca(entries: Entries, m: int, n: int, eps: float, rank: int = -1) -> Factors | None:
    rows, cols = np.arange(m), np.arange(n)
    return _crosses(lambda own: entries(rows[own], cols), lambda j: entries(rows, cols[j : j + 1])[:, 0], m, n, eps, rank)


def symmetric_partial_aca(entries: Entries, m: int, n: int, eps: float, rank: int = -1, first: bool = True) -> Factors | None:
    """Driven from rows if ``first`` (target offset at least the source's), else from columns, so that a block and its mirror get transposed factors."""
    if first:
        return partial_aca(entries, m, n, eps, rank)
    out = partial_aca(lambda r, c: entries(c, r).T, n, m, eps, rank)
    return None if out is None else (out[1].T, out[0].T)


def recompress(u: np.ndarray, v: np.ndarray, eps: float) -> Factors:
    """Round the factors to accuracy eps: QR of both, SVD of the core, the root of the values on either side."""
    if u.shape[1] == 0:
        return u, v
    if u.shape[1] > min(u.shape[0], v.shape[1]):
        a, s, b = np.linalg.svd(u @ v, full_matrices=False)
    else:
        q, r = np.linalg.qr(u)
        p, t = np.linalg.qr(v.conj().T)
        a, s, b = np.linalg.svd(r @ t.conj().T)
        a, b = q @ a, b @ p.conj().T
    k = truncation_rank(s, eps) if s.any() else 1
    root = np.sqrt(s[:k])
    return a[:, :k] * root, root[:, None] * b[:k]


def recompressed(compressor: Callable) -> Callable:
    """The compressor followed by a recompression; not in fixed-rank mode."""

    def run(entries: Entries, m: int, n: int, eps: float, rank: int = -1, **more) -> Factors | None:
        out = compressor(entries, m, n, eps, rank, **more)
        return out if out is None or rank > 0 else recompress(*out, eps)

    return run


COMPRESSORS = {
    "svd": svd,
    "full_aca": full_aca,
    "partial_aca": partial_aca,
    "sym_partial_aca": symmetric_partial_aca,
    "recompressed_partial_aca": recompressed(partial_aca),
    "recompressed_sym_partial_aca": recompressed(symmetric_partial_aca),
}


def add(a: Factors, b: Factors, eps: float) -> Factors:
    """Rounded sum; no rounding if a side has rank zero."""
    if not a[0].shape[1] or not b[0].shape[1]:
        return b if not a[0].shape[1] else a
    return recompress(np.hstack([a[0], b[0]]), np.vstack([a[1], b[1]]), eps)


def compression_ratio(m: int, n: int, r: int) -> float:
    return m * n / (r * (m + n))


def space_saving(m: int, n: int, r: int) -> float:
    return 1 - r * (1 / m + 1 / n)
