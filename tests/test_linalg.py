"""Numpy leaf mathematics: compressors, dense and hierarchical factorisations."""

from __future__ import annotations

import numpy as np
import pytest

from arbora.functions.kernels import KERNELS, Kernel
from arbora.operators import dense, hmatrix, lowrank
from arbora.operators.htree import from_block
from arbora.plans import blocks
from arbora.plans.clustering import Clustering, cut, subtree


def disk(n, z, seed=0):
    rng = np.random.default_rng(seed)
    r, phi = np.sqrt(rng.random(n)), 2 * np.pi * rng.random(n)
    return np.stack([r * np.cos(phi), r * np.sin(phi), np.full(n, float(z))], axis=1)


@pytest.mark.parametrize("name", sorted(lowrank.COMPRESSORS))
@pytest.mark.parametrize("gap", [15, 40])
def test_compressors_meet_accuracy_and_saving(name, gap):
    x, y = disk(500, 0), disk(100, gap, 1)
    a = KERNELS["laplace"].block(x, y)
    entries = lambda r, c: KERNELS["laplace"].block(x[r], y[c])
    u, v = lowrank.COMPRESSORS[name](entries, 500, 100, 1e-4)
    assert np.linalg.norm(a - u @ v) < 1e-4
    assert 0.93 <= lowrank.space_saving(500, 100, u.shape[1]) <= 0.99
    u, v = lowrank.COMPRESSORS[name](entries, 500, 100, 1e-4, 10)
    assert u.shape[1] == 10 and np.linalg.norm(a - u @ v) < 1e-8
    assert lowrank.space_saving(500, 100, 10) == pytest.approx(0.88)


def test_incompressible_and_zero_blocks_stay_dense():
    a = np.random.default_rng(0).random((40, 40))
    for f in (lowrank.svd, lowrank.full_aca, lowrank.partial_aca):
        assert f(lambda r, c: a[np.ix_(r, c)], 40, 40, 1e-10) is None
        assert f(lambda r, c: np.zeros((len(r), len(c))), 40, 40, 1e-3) is None


def test_truncation_and_rounded_sum():
    assert lowrank.truncation_rank(np.array([1.0, 1e-3, 1e-9]), 1e-6) == 2
    rng = np.random.default_rng(1)
    a, b = ((rng.random((50, 4)), rng.random((4, 30))) for _ in range(2))
    u, v = lowrank.add(a, b, 1e-10)
    assert u.shape[1] == 8 and np.allclose(u @ v, a[0] @ a[1] + b[0] @ b[1])
    assert lowrank.add(a, (np.zeros((50, 0)), np.zeros((0, 30))), 1e-3) is a


def test_dense_factorisations():
    rng = np.random.default_rng(2)
    a, b = rng.random((150, 150)), rng.random((150, 3))
    assert np.allclose(a @ dense.lu_solve(dense.lu(a), b), b)
    s = a @ a.T + 150 * np.eye(150)
    assert np.allclose(s @ dense.cholesky_solve(np.linalg.cholesky(s), b), b)
    with pytest.raises(np.linalg.LinAlgError):
        dense.lu(np.zeros((3, 3)))


@pytest.mark.parametrize("children", [2, 3, 4])
@pytest.mark.parametrize("direction", ["pca", "box"])
@pytest.mark.parametrize("split", ["regular", "geometric"])
@pytest.mark.parametrize("axes", [False, True])
@pytest.mark.parametrize("dim", [2, 3])
def test_cluster_tree_invariants(children, direction, split, axes, dim):
    x = disk(200, 1)[:, :dim]
    how = Clustering(children=children, leaf=10, direction=direction, split=split, axes=axes, owners=4)
    root, order = subtree(x, np.arange(200), np.zeros(200), np.ones(200), how)
    assert sorted(order) == list(range(200))
    owned = []
    for node in root.preorder():
        if node.children:
            assert len(node.children) >= children and sum(c.size for c in node.children) == node.size
            at = node.offset
            for c in node.children:
                assert c.offset == at and c.depth == node.depth + 1
                at += c.size
        if node.on_partition:
            owned.append(node.owner)
        own = x[order[node.offset : node.offset + node.size]]
        assert np.sqrt(((own - node.center) ** 2).sum(axis=1)).max() <= node.radius + 1e-12
    assert sorted(owned) == [0, 1, 2, 3] or split == "geometric" or children == 3


def test_cuts():
    assert cut(np.arange(10.0), 3, "regular") == [3, 6, 10] and cut(np.arange(2.0), 3, "regular") == []
    assert cut(np.array([0.0, 1, 2, 3, 10, 11]), 2, "geometric") == [4, 6] and cut(np.zeros(5), 2, "geometric") == []


def tree(n, eps, symmetry="N", uplo="N", kernel="ex_inv5"):
    x = disk(n, 0, 3)
    root, order = subtree(x, np.arange(n), np.zeros(n), np.ones(n), Clustering(leaf=25))
    x = x[order]
    plan = blocks.build(root, root, blocks.rjasanow_steinbach(5.0), symmetry, uplo)
    assert sum(b.t.size * b.s.size * (2 if b.mirror else 1) for b in plan.leaves()) == n * n

    def leaf_of(b):
        r, c = x[b.t.offset : b.t.offset + b.t.size], x[b.s.offset : b.s.offset + b.s.size]
        got = lowrank.svd(lambda i, j: KERNELS[kernel].block(r[i], c[j]), len(r), len(c), eps) if b.storage == "lowrank" else None
        return KERNELS[kernel].block(r, c) if got is None else got

    return from_block(plan, leaf_of, eps, symmetry), KERNELS[kernel].block(x, x)


@pytest.mark.parametrize("symmetry,uplo", [("N", "N"), ("S", "L"), ("S", "U")])
def test_hierarchical_products(symmetry, uplo):
    h, a = tree(300, 1e-8, symmetry, uplo)
    x = np.random.default_rng(0).random((300, 3))
    assert h.ranks() and np.linalg.norm(h.to_dense() - a) < 1e-7 * np.linalg.norm(a)
    assert np.allclose(h @ x, a @ x, rtol=1e-6) and np.allclose(h.transposed() @ x, a.T @ x, rtol=1e-6)
    out = h.copy().scale(0.0)
    out.add_product(h, h, 2.0)
    assert np.linalg.norm(out.to_dense() - 2 * a @ a) < 1e-5 * np.linalg.norm(a @ a)


@pytest.mark.parametrize("eps", [1e-6, 1e-9])
def test_hierarchical_solves(eps):
    x = np.random.default_rng(0).random((400, 2))
    h, a = tree(400, eps)
    assert np.linalg.norm(h.copy().factorise_lu().lu_solve(a @ x) - x) < 1e3 * eps * np.linalg.norm(x)
    h, a = tree(400, eps, "S", "L")
    assert np.linalg.norm(h.factorise_cholesky().cholesky_solve(a @ x) - x) < 1e3 * eps * np.linalg.norm(x)


def test_block_plan_rejects_bad_options():
    root, _ = subtree(disk(50, 0), np.arange(50), np.zeros(50), np.ones(50), Clustering())
    with pytest.raises(ValueError):
        blocks.build(root, root, blocks.rjasanow_steinbach(10.0), "S", "N")
    with pytest.raises(ValueError):
        Clustering(children=1)


@pytest.mark.parametrize("name", ["partial_aca", "recompressed_sym_partial_aca", "sym_partial_aca", "recompressed_partial_aca"])
@pytest.mark.parametrize("eps", [1e-4, 1e-8, 1e-12])
def test_crosses_of_repeated_points(name, eps):
    """Copies of a point give rows whose residual is rounding; they do not end the crosses."""
    rng = np.random.default_rng(2)
    x, y = (np.repeat(rng.random((k, 2)), 6, axis=0) for k in (120, 90))
    x, y = x[rng.permutation(len(x))], y + [1.5, 0]
    for kernel in ("ex_inv1", "reg_sym_c"):
        a = KERNELS[kernel].block(x, y)
        u, v = lowrank.COMPRESSORS[name](lambda r, c: a[np.ix_(r, c)], *a.shape, eps)  # noqa: B023
        assert np.linalg.norm(u @ v - a) < 10 * eps * np.linalg.norm(a)


@pytest.mark.parametrize("name", ["svd", "full_aca"])
def test_no_more_than_a_tile_of_a_large_block_is_held(name, monkeypatch):
    monkeypatch.setattr(lowrank, "SVD_TILE", 60)
    monkeypatch.setattr(lowrank, "CROSS_TILE", 60)
    rng = np.random.default_rng(3)
    a = KERNELS["reg_sym_c"].block(rng.random((330, 2)), rng.random((210, 2)) + [1.5, 0])
    read = np.zeros(a.shape, int)

    def entries(r, c):
        assert max(len(r), len(c)) <= 60
        read[np.ix_(r, c)] += 1
        return a[np.ix_(r, c)]

    for eps in (1e-4, 1e-10):
        read[:] = 0
        u, v = lowrank.COMPRESSORS[name](entries, *a.shape, eps)
        assert (read == 1).all() and np.linalg.norm(u @ v - a) < eps * np.linalg.norm(a)


@pytest.mark.parametrize("name", ["full_aca", "sym_partial_aca", "recompressed_sym_partial_aca", "recompressed_partial_aca"])
def test_a_point_that_is_rare_among_copies_is_not_missed(name):
    """The rows looked at before crosses stop may all be copies of points that were taken; each point is compressed once."""
    rng, eps = np.random.default_rng(5), 1e-12
    for _ in range(150):
        x, y = (rng.random((4, 2))[rng.permutation(np.repeat(np.arange(4), [14, 8, 6, 1]))] for _ in range(2))
        row = hmatrix.Row(40, len(x), 0, len(y), 0, 0, "lowrank", "N", False, [])
        parts, failed = hmatrix.payload(row, KERNELS["ex_inv1"], x, y + [3, 0], hmatrix.Options(eps=eps, compressor=name))
        a = KERNELS["ex_inv1"].block(x, y + [3, 0])
        assert not failed and len(parts) == 2 and np.linalg.norm(parts[0] @ parts[1] - a) < 20 * eps * np.linalg.norm(a)
        assert np.abs(parts[0] @ parts[1] - a).max() < 1e-10


def test_copies_of_points_are_not_crossed_again():
    """Of 40 x 30 points in ten copies each full crosses read one entry a pair of points."""
    rng, read = np.random.default_rng(6), []
    x, y = (np.repeat(rng.random((k, 2)), 10, axis=0) for k in (40, 30))
    kernel = Kernel("counted", lambda a, b: read.append(len(a) * len(b)) or KERNELS["ex_inv1"].block(a, b))
    row = hmatrix.Row(0, len(x), 0, len(y), 0, 0, "lowrank", "N", False, [])
    parts, _ = hmatrix.payload(row, kernel, x, y + [4, 0], hmatrix.Options(eps=1e-8, compressor="full_aca"))
    a = KERNELS["ex_inv1"].block(x, y + [4, 0])
    assert sum(read) == 40 * 30 and np.linalg.norm(parts[0] @ parts[1] - a) < 1e-8 * np.linalg.norm(a)
