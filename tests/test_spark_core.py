"""The core on Spark: clustering in two phases, products, owners, exports, solvers, and the queries' oracles."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from arbora.functions import vectors
from arbora.functions.kernels import KERNELS
from arbora.operators import factor, hmatrix, products, solvers
from arbora.plans import clustering
from arbora.plans.clustering import Clustering
from arbora.sources import exports, points

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cloud(spark):
    return points.synthetic(spark, "disk", 240, 3, 1.0, seed=4)


@pytest.fixture(scope="module")
def made(spark, cloud):
    tree = clustering.build(cloud, Clustering(leaf=20, owners=2))
    x = np.stack(tree.points.orderBy("pos").select("coords").toPandas()["coords"].to_list())
    return tree, hmatrix.assemble(tree, tree, "ex_inv5", hmatrix.Options(eps=1e-7)), KERNELS["ex_inv5"].block(x, x)


def vector(spark, v):
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(v)], "pos long, val double")


def values(df):
    return df.orderBy("pos").toPandas()["val"].to_numpy()


@pytest.mark.parametrize(
    "how",
    [
        Clustering(leaf=20), Clustering(leaf=200), Clustering(leaf=10**9), Clustering(leaf=60, complete=True), Clustering(leaf=100, children=3, direction="box"),
        Clustering(leaf=20, owners=2), Clustering(leaf=20, owners=5), Clustering(leaf=100, owners=3, children=4), Clustering(leaf=30, owners=10, children=3), Clustering(leaf=200, owners=8),
    ],
    ids=str,
)
def test_both_phases_build_one_tree(spark, cloud, how):
    whole, split = (clustering.build(cloud, how, local) for local in (1000, 70))
    shape = lambda t: [(n.offset, n.size, n.depth, n.owner, n.counter, n.on_partition, round(n.radius, 9)) for n in t.root.preorder()]
    assert shape(whole) == shape(split)
    assert whole.permutation().exceptAll(split.permutation()).count() == 0
    assert {n.owner for n in whole.root.preorder() if n.on_partition} == set(range(how.owners))


def test_given_partitions(spark, cloud):
    owners = cloud.select("point_id", (F.col("point_id") % 3).cast("int").alias("owner"))
    for local in (1000, 50):
        tree = clustering.build(cloud, Clustering(leaf=15), local, owners)
        parts = [n for n in tree.root.preorder() if n.on_partition]
        assert [(n.owner, n.size, n.depth) for n in parts] == [(0, 80, 1), (1, 80, 1), (2, 80, 1)] and tree.part(2) == (160, 80)
        assert tree.points.filter("pos >= 80 AND pos < 160 AND point_id % 3 <> 1").count() == 0
        assert all(n.size <= 15 for n in tree.root.preorder() if not n.children)
    ranged = clustering.from_ranges(cloud, [(0, 100), (100, 140)], Clustering(leaf=15))
    assert ranged.points.filter("pos < 100 AND point_id >= 100").count() == 0
    for bad in (lambda: clustering.from_ranges(cloud, [(0, 100), (110, 130)]), lambda: clustering.build(cloud, Clustering(owners=2), partition=owners), lambda: clustering.build(cloud, partition=owners.filter("owner > 0"))):
        with pytest.raises(ValueError):
            bad()


def test_complex_numbers_on_both_paths(spark, made, monkeypatch):
    tree, h, a = made
    rng = np.random.default_rng(1)
    x, y = (rng.random((240, 2)) + 1j * rng.random((240, 2)) for _ in range(2))
    table = lambda v: spark.createDataFrame([(k, r.view(float).tolist()) for k, r in enumerate(v)], "pos long, val array<double>")
    for bound in (1 << 20, 1):
        monkeypatch.setattr(hmatrix, "BROADCAST_BYTES", bound)
        got = h.product(table(x), "N", 2 - 1j, 1 + 3j, table(y), complex_x=True).orderBy("pos").toPandas()["val"]
        assert np.allclose(np.stack(got.to_list()).view(complex), (2 - 1j) * (a @ x) + (1 + 3j) * y, rtol=1e-5)


def test_factors_solve_again_and_again(spark, made):
    tree, h, a = made
    rng = np.random.default_rng(2)
    b = rng.random(240)
    lu = factor.factorise(h, "lu", 1e-10)
    for trans, op in (("N", a), ("T", a.T), ("C", a.T)):
        assert np.allclose(op @ values(lu.solve(vector(spark, b), trans)), b, rtol=1e-3, atol=1e-3)
    with pytest.raises(ValueError):
        factor.factorise(h, "qr")


def test_triangles(spark, made):
    tree, h, a = made
    b = np.random.default_rng(3).random(240)
    low = np.tril(a)
    assert np.allclose(low @ values(factor.triangular_solve(h, vector(spark, b))), b, rtol=1e-4, atol=1e-4)
    assert np.allclose(values(factor.triangular_solve(h, vector(spark, b), "R", "L", "N")) @ low, b, rtol=1e-4, atol=1e-4)
    unit = np.tril(a, -1) / 1e6 + np.eye(240)
    assert np.allclose(unit @ values(factor.triangular_solve(h.scale(1e-6), vector(spark, b), unit=True)), b, rtol=1e-4, atol=1e-4)


def test_products_are_matrices(spark, made):
    tree, h, a = made
    assert np.linalg.norm(factor.product(h, h).to_numpy() - a @ a) < 1e-4 * np.linalg.norm(a @ a)
    rng = np.random.default_rng(4)
    u, v = rng.random((240, 3)), rng.random((240, 3))
    table = lambda m: spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(m)], "pos long, val array<double>")
    low = products.LowRank(table(u), table(v))
    assert np.linalg.norm(products.add_low_rank(h, low).to_numpy() - a - u @ v.T) < 1e-4 * np.linalg.norm(a)
    x = rng.random(240)
    assert np.allclose(values(products.low_rank_product(low, low).times(vector(spark, x))), u @ (v.T @ (u @ (v.T @ x))))
    rounded = low.plus(low).rounded(1e-10)
    assert rounded.rank == 3 and np.isclose(rounded.frobenius(), 2 * np.linalg.norm(u @ v.T))
    rows = products.matrix_hmatrix(table(u), h).orderBy("pos").toPandas()["val"]
    assert np.allclose(np.stack(rows.to_list()).T, u.T @ a, rtol=1e-4)
    assert np.allclose(values(h.sub_product(vector(spark, x[:50]), (10, 60), (100, 50))), a[10:70, 100:150] @ x[:50], rtol=1e-4)


def test_extension_points_and_reports(spark, cloud, made, tmp_path):
    tree, h, a = made
    none = hmatrix.assemble(tree, tree, "ex_inv5", hmatrix.Options(compressor=lambda entries, m, n, eps, rank: None))
    assert none.leaves.filter("storage <> 'dense'").count() == 0 and none.leaves.filter("false_positive").count() > 0
    never = hmatrix.assemble(tree, tree, "ex_inv5", hmatrix.Options(admissible=lambda t, s: False, dense=lambda pairs: [KERNELS["ex_inv5"].block(x, y) for x, y in pairs]))
    assert np.allclose(never.to_numpy(), a) and never.leaves.filter("false_positive").count() == 0
    errors = h.block_errors("ex_inv5").toPandas()
    assert len(errors) == h.low_rank_leaves().count() and (errors["error"] < 1e-4 * errors["norm"]).all()
    assert h.information("owner").count() == 2 and h.tree_parameters().filter("key = 'target_leaf' AND value = '20'").count() == 1
    top = h.plan.children[0]
    part = h.block(top.t.offset, top.t.size, top.s.offset, top.s.size)
    assert 0 < part.leaves.count() < h.leaves.count() and h.plan.holds(top) and not top.holds(h.plan) and h.block(1, 2, 3, 4) is None
    lines = [r.value for r in exports.dot_tree_lines(h).orderBy("line").collect()]
    assert sum("->" in x for x in lines) == sum(1 for _ in h.plan.walk()) - 1
    exports.save_levels(h, f"{tmp_path}/levels")
    exports.save_properties(tree, f"{tmp_path}/properties")
    exports.save_infos(spark, {"Nb_it": "3"}, f"{tmp_path}/infos")
    assert spark.read.option("header", True).csv(f"{tmp_path}/levels").count() == len(h.plan.levels())
    assert spark.read.text(f"{tmp_path}/infos").first().value == "Nb_it = 3"
    assert exports.clustered_geometry(tree, [0, 2]).groupBy("depth").count().filter("count = 240").count() == 2


def test_small_matrix_operators(spark):
    rng = np.random.default_rng(6)
    a, b = rng.random((6, 6)), rng.random((6, 4))
    sym, c = np.tril(a) + np.tril(a, -1).T, np.tril(a) + 1j * np.tril(a, -1)
    herm = c + np.tril(c, -1).conj().T
    coo = lambda m: spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in np.ndindex(m.shape) if m[i, j]], "i long, j long, val double")
    coz = lambda m: spark.createDataFrame([(int(i), int(j), float(m[i, j].real), float(m[i, j].imag)) for i, j in np.ndindex(m.shape) if m[i, j]], "i long, j long, val double, imag double")

    def dense(df, shape, imag=False):
        out = np.zeros(shape, complex)
        for r in df.collect():
            out[r.i, r.j] = r.val + 1j * (r.imag if imag else 0)
        return out

    assert np.allclose(dense(vectors.symm(coo(np.tril(a)), coo(b)), (6, 4)), sym @ b)
    assert np.allclose(dense(vectors.symm(coo(np.tril(a)), coo(b.T), "R"), (4, 6)), b.T @ sym)
    assert np.allclose(dense(vectors.hemm(coz(c), coz(b + 1j * b)), (6, 4), True), herm @ (b + 1j * b))
    x = spark.createDataFrame([(k, float(k), 1.0) for k in range(6)], "pos long, val double, imag double")
    assert np.allclose([r.val + 1j * r.imag for r in vectors.hemv(coz(c), x).orderBy("i").collect()], herm @ (np.arange(6) + 1j))
    assert [r.val for r in vectors.row(coo(a), 2).orderBy("pos").collect()] == a[2].tolist()
    assert vectors.text_rows(coo(b)).count() == 6
    one = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], "a/b/name.txt", "1,,2", "x")], "v array<double>, p string, s string, n string")
    got = one.select(vectors.complex_dot(F.col("v"), F.col("v")).alias("d"), vectors.conjugate(F.col("v")).alias("c"), vectors.base_name(F.col("p")).alias("b"), vectors.pieces(F.col("s"), ",").alias("s"), vectors.number_or_zero(F.col("n")).alias("n"), vectors.padded(F.lit(7), 3).alias("z")).first()
    assert (got.d, got.c, got.b, got.s, got.n, got.z) == ([30.0, 0.0], [1.0, -2.0, 3.0, -4.0], "name", ["1", "2"], 0.0, "007")
    assert points.random_matrix(spark, 3, 4).count() == 12 and points.random_vector(spark, 5, 2.0, 3.0).filter("val < 2 OR val > 3").count() == 0


def test_products_and_beta(spark, made):
    tree, h, a = made
    rng = np.random.default_rng(0)
    x, y = rng.random(240), rng.random(240)
    got = values(h.product(vector(spark, x), "N", 2.0, -1.0, vector(spark, y)))
    assert np.allclose(got, 2 * a @ x - y, rtol=1e-5)
    assert np.allclose(values(h.product(vector(spark, x), "T")), a.T @ x, rtol=1e-5)
    with pytest.raises(ValueError):
        h.product(vector(spark, x), "X")


def test_join_path_equals_broadcast_path(spark, made, monkeypatch):
    tree, h, a = made
    monkeypatch.setattr(hmatrix, "BROADCAST_BYTES", 1)
    monkeypatch.setattr(hmatrix, "SEGMENT", 32)
    other = hmatrix.assemble(tree, tree, "ex_inv5", hmatrix.Options(eps=1e-7))
    assert np.allclose(values(other.product(vector(spark, np.ones(240)))), a.sum(axis=1), rtol=1e-5)


def test_owners_scale_and_recompression(spark, made):
    tree, h, a = made
    parts = [h.restricted(o).product(vector(spark, np.ones(240))) for o in (0, 1)]
    assert np.allclose(values(parts[0].unionByName(parts[1])), a.sum(axis=1), rtol=1e-5)
    assert h.restricted(diagonal=True).leaves.count() < h.leaves.count()
    assert np.allclose(h.scale(3.0).recompress(1e-5).to_numpy(), 3 * a, rtol=1e-2, atol=1e-3)


def test_symmetric_and_hermitian_storage(spark, cloud):
    tree = clustering.build(cloud, Clustering(leaf=20))
    x = np.stack(tree.points.orderBy("pos").select("coords").toPandas()["coords"].to_list())
    for kernel, symmetry in (("reg_sym", "S"), ("reg_herm", "H"), ("reg_sym_c", "S")):
        h = hmatrix.assemble(tree, tree, kernel, hmatrix.Options(eps=1e-6, symmetry=symmetry, uplo="L"))
        a = KERNELS[kernel].block(x, x)
        assert np.linalg.norm(h.to_numpy() - a) < 1e-5 * np.linalg.norm(a)
        user = h.to_numpy(user=True)
        order = np.array([r.point_id for r in tree.permutation().orderBy("pos").collect()])
        assert np.allclose(user[np.ix_(order, order)], h.to_numpy())


def test_exports_and_files(spark, made, tmp_path):
    tree, h, a = made
    exports.save_tree(tree, str(tmp_path / "tree"))
    again = exports.load_tree(spark, str(tmp_path / "tree"))
    assert [(n.offset, n.size, n.owner) for n in again.root.preorder()] == [(n.offset, n.size, n.owner) for n in tree.root.preorder()]
    exports.save_ranks(h, str(tmp_path / "ranks"))
    assert spark.read.option("header", True).csv(str(tmp_path / "ranks")).count() == h.leaves.count() == exports.dot_lines(h).count()
    assert exports.tree_lines(tree).count() == max(n.depth for n in tree.root.preorder()) + 1
    h.save(str(tmp_path / "h"))
    assert np.allclose(h.load(str(tmp_path / "h")).to_numpy(), h.to_numpy())
    m = np.arange(6.0).reshape(2, 3)
    (tmp_path / "m.bin").write_bytes(points.matrix_to_bytes(m))
    assert {(r.i, r.j): r.val for r in points.read_matrix(spark, str(tmp_path / "m.bin")).collect()} == {(i, j): m[i, j] for i in range(2) for j in range(3)}
    assert np.array_equal(points.vector_from_bytes(points.vector_to_bytes(m[0])), m[0])
    (tmp_path / "mesh").write_text("$Nodes\n2\n1 0 0 0\n2 1 0.5 0\n$EndNodes\n")
    assert [(r.point_id, r.coords) for r in points.mesh_nodes(spark, str(tmp_path / "mesh")).orderBy("point_id").collect()] == [(1, [0, 0, 0]), (2, [1, 0.5, 0])]


def test_krylov_and_preconditioners():
    rng = np.random.default_rng(0)
    q = rng.random((60, 60))
    a = q @ q.T + 60 * np.eye(60)
    b = a @ np.ones(60)
    own = {k: np.arange(20 * k, 20 * k + 20) for k in range(3)}
    local = {k: (i, np.linalg.inv(a[np.ix_(i, i)])) for k, i in own.items()}
    for name, f in solvers.KRYLOV.items():
        m = solvers.schwarz(local, own) if name == "gmres" else solvers.schwarz(local)
        out = f(lambda x: a @ x, b, m, most=200, **({"damping": 0.3} if name == "richardson" else {}))
        assert out.residuals[-1] < 1e-6 and np.allclose(out.x, 1, atol=1e-3), name
    z = solvers.geneo(a, np.diag(np.diag(a)), 2)
    out = solvers.cg(lambda x: a @ x, b, solvers.two_level(solvers.schwarz(local), z, lambda x: a @ x))
    assert out.residuals[-1] < 1e-6 and out.iterations < 60


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.0, -3.0, 3.0], [2.0, 0.0, 1.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    r = df.select(vectors.dot(a, b), vectors.plus(a, b), vectors.minus(a, b), vectors.times(a, 2.0), vectors.mean(a), vectors.max_abs(a), vectors.min_abs(a), vectors.argmax_abs(a), vectors.sub_vector(a, F.array(F.lit(2), F.lit(0)))).first()
    assert list(r) == [5.0, [3.0, -3.0, 4.0], [-1.0, -3.0, 2.0], [2.0, -6.0, 6.0], pytest.approx(1 / 3), 3.0, 1.0, 1, [3.0, 1.0]]
    m = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 1, -5.0)], "i long, j long, val double")
    assert {(r.i, r.j): r.val for r in vectors.gemm(m, vectors.transpose(m)).collect()} == {(0, 0): 5, (0, 1): -10, (1, 0): -10, (1, 1): 25}
    assert vectors.argmax(m).first().asDict() == {"i": 1, "j": 1, "val": -5.0} and vectors.frobenius(m).first()[0] == pytest.approx(30**0.5)


def test_queries_match_their_oracles(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("embeddings", "lineitem", "part", "supplier", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found, oracles = entry.queries(), entry.oracle_sql()
    for name in ("kernel_matvec", "kernel_transpose", "owner_partition_matvec", "covariance_matrix", "admissible_pairs", "axis_permutation", "matrix_product_coo", "lu_solve_verdict"):
        got = found[name](spark, SF).toPandas()
        want = con.execute(oracles[name]).fetchdf()[list(got.columns)]
        key = lambda d: sorted(map(tuple, d.astype(float).to_numpy().tolist()))
        assert key(got) == key(want), name


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["o_orderkey", "y"] and out.count() == 1500


def test_streamed_matrices_equal_stored_ones(spark, cloud):
    """Planned and filled inside tasks: the same leaves, products and norms, for either side, half, owner and factors."""
    tree = clustering.build(cloud, Clustering(leaf=20, owners=2))
    x = np.stack(tree.points.orderBy("pos").select("coords").toPandas()["coords"].to_list())
    v = np.linspace(1, 2, tree.size)
    for kernel, options in (("ex_inv5", hmatrix.Options(eps=1e-7)), ("reg_sym", hmatrix.Options(eps=1e-7, symmetry="S", uplo="L")), ("reg_herm", hmatrix.Options(eta=1e-300))):
        stored, streamed = (hmatrix.assemble(tree, tree, kernel, options, stored=s) for s in (True, False))
        plan = lambda h: sorted(map(tuple, h.leaves.select("t_off", "t_size", "s_off", "s_size", "owner", "s_owner", "storage", "mirror", "rank").collect()))
        assert plan(stored) == plan(streamed)
        a = KERNELS[kernel].block(x, x)
        for trans in "NT":
            got = np.stack([np.atleast_1d(r) for r in values(streamed.product(vector(spark, v), trans))])
            want = (a if trans == "N" else a.T) @ v
            assert np.allclose(got, np.stack([want.real, want.imag], 1) if np.iscomplexobj(want) else want[:, None], rtol=1e-5)
        norm = streamed.frobenius().first()
        assert norm.entries == a.size and np.isclose(norm.norm, np.linalg.norm(a), rtol=1e-6) and np.isclose(stored.frobenius().first().norm, norm.norm)
    off, size = tree.part(1)
    part = streamed.restricted(1).product(vector(spark, v))
    assert sorted(r.pos for r in part.collect()) == list(range(off, off + size))
    inner = np.stack(streamed.local_product(1, vector(spark, v[off : off + size])).orderBy("pos").toPandas()["val"].to_list())
    assert np.allclose(inner[:, 0], (a[off : off + size, off : off + size] @ v[off : off + size]).real)
    assert np.isclose(streamed.scale(2.0).frobenius().first().norm, 2 * norm.norm)


STREAMED = ["complex_matvec", "given_partition_matvec", "kernel_matvec", "kernel_multi_rhs", "local_to_local_matvec", "operator_sum_matvec", "kernel_alpha_beta", "kernel_matvec_symmetric", "kernel_transpose", "matrix_frobenius", "owner_partition_matvec", "hmatrix_matvec_verdict", "hmatrix_recompressed_verdict", "hmatrix_orders", "hmatrix_orders_checked"]


@pytest.mark.parametrize("name", STREAMED)
def test_no_payload_is_stored(spark, name, monkeypatch):
    """Queries that multiply once keep neither leaves nor a plan of blocks."""

    def never(*_):
        raise AssertionError("the matrix is stored")

    monkeypatch.setattr(hmatrix, "durable", never)
    monkeypatch.setattr(hmatrix, "leaf_plan", never)
    assert entry.queries()[name](spark, SF).count() > 0


def test_uncompressed_products_run_in_tiles(spark, cloud, monkeypatch):
    monkeypatch.setattr(hmatrix, "TILE", (50, 70))
    tree = clustering.build(cloud, Clustering(leaf=20))
    x = hmatrix.coordinates(tree)
    v = np.linspace(1, 2, tree.size)
    got = hmatrix.dense_product(tree, tree, "ex_inv5", vector(spark, v))
    assert got.count() == tree.size and np.allclose(values(got), KERNELS["ex_inv5"].block(x, x) @ v)


@pytest.mark.parametrize("name", ["lu_solve_verdict", "lu_solution_transposed", "cholesky_solution", "cholesky_solve_verdict", "cg_schwarz_verdict"])
def test_systems_too_large_for_one_task(spark, name, monkeypatch):
    """Beyond ``DIRECT`` points nothing is factorised as a whole and no owner's inverse is made; the results are the same."""
    duckdb = pytest.importorskip("duckdb")
    data = SF.replace("sf0.001", "sf0.01")

    def refused(*_):
        raise AssertionError("one task or the driver would hold it all")

    for module, part in ((factor, "_made"), (solvers, "local_inverses")):
        monkeypatch.setattr(module, part, refused)
    monkeypatch.setattr(factor, "DIRECT", 50)
    monkeypatch.setattr(factor, "DIAGONAL", 30)
    got = entry.queries()[name](spark, data).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{data}/supplier.parquet'")
    assert sorted(tuple(r) for r in got) == sorted(con.sql(entry.oracle_sql()[name]).fetchall())


@pytest.mark.parametrize("kernel", ["ex_inv5", "reg_herm"])
def test_products_of_matrices_that_are_not_stored_are_composed(spark, made, kernel):
    tree, _, _ = made
    x = np.stack(tree.points.orderBy("pos").select("coords").toPandas()["coords"].to_list())
    a = KERNELS[kernel].block(x, x)
    h = hmatrix.assemble(tree, tree, kernel, hmatrix.Options(eps=1e-7), stored=False)
    v = np.random.default_rng(5).standard_normal(240)
    both = factor.product(h, h)
    assert both.shape == (240, 240)
    for trans, want in (("N", a @ (a @ v)), ("T", a.T @ (a.T @ v)), ("C", a.conj().T @ (a.conj().T @ v))):
        got = values(both.product(vector(spark, v), trans))
        got = np.stack(got).view(complex)[:, 0] if np.iscomplexobj(a) else got
        assert np.linalg.norm(got - want) < 1e-5 * np.linalg.norm(want)
    if kernel == "ex_inv5":
        assert np.allclose(values(factor.multiply(h, h, vector(spark, v))), a @ (a @ v), rtol=1e-4, atol=1e-4)


def test_product_verdict_beyond_one_task_stores_no_matrix(spark, monkeypatch):
    monkeypatch.setattr(factor, "FORMED", 10)
    monkeypatch.setattr(hmatrix, "leaf_plan", lambda *_: pytest.fail("the blocks were planned on the driver"))
    got = entry.queries()["hmatrix_product_verdict"](spark, SF).toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/part.parquet").count() and got["agrees"].all()


def test_product_matvec_beyond_one_task_is_the_same(spark, monkeypatch):
    want = {r.point_id: r.y for r in entry.queries()["hmatrix_product_matvec"](spark, SF).collect()}
    monkeypatch.setattr(factor, "FORMED", 5)
    monkeypatch.setattr(factor, "PAYLOAD_BYTES", 8)
    got = {r.point_id: r.y for r in entry.queries()["hmatrix_product_matvec"](spark, SF).collect()}
    assert got and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1.5e-4 for k in want)
