"""Hierarchical matrices as a table of leaf blocks.

``HMatrix.leaves`` has a row a leaf: ``(block_id, t_off, t_size, s_off, s_size,
owner, s_owner, storage, symmetry, mirror, rank, dtype, dense, u, v)``; payloads are
column-major, complex numbers interleaved. A leaf is filled and multiplied inside
Arrow batches by numpy; planning, reductions and reports are DataFrame operations.

Coordinates and vectors reach the leaves by broadcast only while their size is at
most ``BROADCAST_BYTES``; beyond that each leaf is joined with the segments that it needs.

A matrix that is multiplied once need not be stored: with ``stored=False`` tasks plan, fill
and apply the leaves of their own rows, or columns, and neither plan nor payloads are kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.functions.kernels import KERNELS, Kernel
from arbora.operators.lowrank import COMPRESSORS, pays, recompress
from arbora.plans import blocks
from arbora.plans.clustering import ClusterTree
from arbora.sources.storage import durable

BROADCAST_BYTES = 64 << 20
#: The same for the coordinates of a matrix that is not stored, which each Python worker holds.
STREAM_BYTES = 256 << 20
#: Points of one segment in the join beyond the broadcast bound.
SEGMENT = 1024
#: Payload of the rows that a task hands over at once.
BATCH_BYTES = 16 << 20
#: Rows of the result that a task hands over at once.
EMITTED = 1 << 16
#: Rows and columns that an uncompressed product takes at once.
TILE = (128, 1024)
SCHEMA = "block_id long, t_off long, t_size long, s_off long, s_size long, owner int, s_owner int, storage string, symmetry string, mirror boolean, rank int, dtype string, dense array<double>, u array<double>, v array<double>, false_positive boolean"


@dataclass(frozen=True)
class Options:
    """``compressor`` is a name or ``f(entries, m, n, eps, rank)`` that gives factors or None; ``admissible`` replaces the usual
    predicate of two nodes; ``dense`` fills several dense blocks at once: it takes pairs of coordinate arrays and gives arrays."""

    eps: float = 1e-6
    eta: float = 10.0
    rank: int = -1
    compressor: str | Callable = "sym_partial_aca"
    symmetry: str = "N"
    uplo: str = "N"
    consistent: bool = True
    min_depths: tuple[int, int] = (0, 0)
    admissible: Callable | None = None
    dense: Callable | None = None


def pack(a: np.ndarray) -> np.ndarray:
    flat = np.asarray(a).ravel(order="F")
    return flat.view(np.float64) if np.iscomplexobj(flat) else flat.astype(np.float64)


def unpack(flat, m: int, n: int, dtype: str) -> np.ndarray:
    a = np.ascontiguousarray(flat, np.float64)
    return (a.view(np.complex128) if dtype == "complex" else a).reshape((m, n), order="F")


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Of points some of which coincide: where each first stands, the number of each row's point, and how often points occur; None if all differ."""
    order = np.lexsort(x.T)
    ordered = x[order]
    new = np.ones(len(x), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    if new.all():
        return None
    group = np.cumsum(new) - 1
    first = order[new]
    number = np.empty(len(first), int)
    number[np.argsort(first)] = np.arange(len(first))
    inverse = np.empty(len(x), int)
    inverse[order] = number[group]
    return np.sort(first), inverse, np.bincount(inverse)


def _compressed(compress: Callable, kernel: Kernel, x: np.ndarray, y: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray] | None:
    """Factors of a block; where points coincide, one row and column of each are compressed and copied.

    A point counts by the root of its number, so the block that is compressed has the singular values of the whole one. If it
    does not pay by itself but its smaller side does against the whole, the factors are exact.
    """
    own = [distinct(x), distinct(y)]
    if own == [None, None]:
        return compress(lambda r, c: kernel.block(x[r], y[c]), len(x), len(y))
    (rows, i, m), (cols, j, n) = (d or (np.arange(len(z)), np.arange(len(z)), np.ones(len(z), int)) for d, z in zip(own, (x, y), strict=True))
    a, b, p, q = x[rows], y[cols], np.sqrt(m), np.sqrt(n)
    out = compress(lambda r, c: kernel.block(a[r], b[c]) * p[r][:, None] * q[c], len(a), len(b))
    if out is not None:
        return (out[0] / p[:, None])[i], (out[1] / q)[:, j]
    if not pays(min(len(a), len(b)), len(x), len(y)):
        return None
    if len(a) < len(b) or len(a) == len(b) and first:
        return np.eye(len(a))[i], kernel.block(a, y)
    return kernel.block(x, b), np.eye(len(b))[:, j]


def payload(row, kernel: Kernel, x: np.ndarray, y: np.ndarray, options: Options) -> tuple[list[np.ndarray], bool]:
    """The leaf's factors, or the dense block alone, and whether an admissible block did not compress."""
    if row.storage == "lowrank":
        named = isinstance(options.compressor, str)
        more = {"first": row.t_off >= row.s_off} if named and options.compressor.endswith("sym_partial_aca") else {}
        compressor = COMPRESSORS[options.compressor] if named else options.compressor
        if named and options.rank <= 0:
            # a block and its mirror get transposed factors
            factors = _compressed(lambda entries, m, n: compressor(entries, m, n, options.eps, **more), kernel, x, y, row.t_off >= row.s_off)
        else:
            factors = compressor(lambda r, c: kernel.block(x[r], y[c]), len(x), len(y), options.eps, options.rank, **more)
        if factors is not None:
            return list(factors), False
    return [kernel.block(x, y) if options.dense is None else options.dense([(x, y)])[0]], row.storage == "lowrank"


def fill(row, kernel: Kernel, x: np.ndarray, y: np.ndarray, options: Options, after: tuple[Callable, ...] = ()) -> dict:
    """Payload of one leaf; an admissible block that does not compress becomes dense."""
    parts, failed = payload(row, kernel, x, y, options)
    for f in after:
        parts = f(parts)
    out = {"storage": "dense", "rank": -1, "dense": None, "u": None, "v": None, "false_positive": failed, "dtype": "complex" if np.iscomplexobj(parts[0]) else "real"}
    if len(parts) == 1:
        return out | {"dense": pack(parts[0])}
    return out | {"storage": "lowrank", "rank": parts[0].shape[1], "u": pack(parts[0]), "v": pack(parts[1])}


def batches(rows: Iterator[dict]) -> Iterator[pd.DataFrame]:
    """Filled rows in frames of about ``BATCH_BYTES``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(row[c].nbytes for c in ("dense", "u", "v") if row[c] is not None)
        if size >= BATCH_BYTES:
            yield pd.DataFrame(held)[[c.split()[0] for c in SCHEMA.split(", ")]]
            held, size = [], 0
    if held:
        yield pd.DataFrame(held)[[c.split()[0] for c in SCHEMA.split(", ")]]


def leaf_plan(root: blocks.Block, spark) -> DataFrame:
    rows = [(k, b.t.offset, b.t.size, b.s.offset, b.s.size, b.t.owner, b.s.owner, b.storage, b.symmetry, b.mirror) for k, b in enumerate(root.leaves())]
    return spark.createDataFrame(rows, "block_id long, t_off long, t_size long, s_off long, s_size long, owner int, s_owner int, storage string, symmetry string, mirror boolean")


def _segments(values: DataFrame, column: str) -> DataFrame:
    """(segment, values by position) of a table by pos."""
    pairs = values.groupBy(F.floor(F.col("pos") / SEGMENT).alias("segment")).agg(F.array_sort(F.collect_list(F.struct("pos", column))).alias("own"))
    return pairs.select("segment", F.col(f"own.{column}").alias("own"))


def _with_segments(leaves: DataFrame, segments: DataFrame, off: str, size: str, into: str) -> DataFrame:
    """Leaves with the concatenated segments that cover [off, off + size)."""
    first, last = F.floor(F.col(off) / SEGMENT), F.floor((F.col(off) + F.col(size) - 1) / SEGMENT)
    asked = leaves.select("block_id", F.explode(F.sequence(first, last)).alias("segment"))
    got = asked.join(segments, "segment").groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("segment", "own"))).alias("all"))
    return leaves.join(got.select("block_id", F.flatten(F.col("all.own")).alias(into)), "block_id")


def coordinates(tree: ClusterTree) -> np.ndarray:
    """The points in cluster numbering, on the driver."""
    d = len(tree.root.center)
    return positions(tree.points.select("pos", *[F.col("coords")[k].alias(f"c{k}") for k in range(d)]), tree.size)


def positions(table: DataFrame, n: int) -> np.ndarray:
    """Rows by position of a table ``(pos, numbers...)``; positions without a row are zero."""
    got = table.toArrow()
    out = np.zeros((n, got.num_columns - 1))
    at = got.column(0).to_numpy()
    for k in range(1, got.num_columns):
        out[at, k - 1] = got.column(k).to_numpy()
    return out


def dense_product(target: ClusterTree, source: ClusterTree, kernel: Kernel | str, x: DataFrame) -> DataFrame:
    """``(pos, val)`` of the uncompressed product with the vector x ``(pos, val)``, in tiles of the rows that a task holds."""
    kernel = KERNELS[kernel] if isinstance(kernel, str) else kernel
    spark, n = target.points.sparkSession, target.size
    rows = coordinates(target)
    sent = spark.sparkContext.broadcast((rows, rows if source is target else coordinates(source), positions(x.select("pos", "val"), source.size)[:, 0]))
    strips = -(-n // TILE[0])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        xs, ys, v = sent.value
        for frame in frames:
            for k in frame["id"]:
                own = xs[k * TILE[0] : (k + 1) * TILE[0]]
                sums = np.zeros(len(own))
                for at in range(0, len(ys), TILE[1]):
                    sums += kernel.block(own, ys[at : at + TILE[1]]) @ v[at : at + TILE[1]]
                yield pd.DataFrame({"pos": k * TILE[0] + np.arange(len(own)), "val": sums})

    tasks = min(strips, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, strips, 1, tasks).mapInPandas(run, "pos long, val double")


class Row(NamedTuple):
    """A leaf made inside a task, with its numbers as ``parts``."""

    t_off: int
    t_size: int
    s_off: int
    s_size: int
    owner: int
    s_owner: int
    storage: str
    symmetry: str
    mirror: bool
    parts: list[np.ndarray]


@dataclass(frozen=True)
class Stream:
    """What a task needs to plan and fill leaves by itself; ``sent`` has the roots and the coordinates of both sides."""

    sent: Broadcast
    shape: tuple[int, int]
    kernel: Kernel
    options: Options
    tasks: int
    owner: int | None = None
    #: Only blocks whose rows and columns have the same owner.
    diagonal: bool = False
    #: What is done to the parts of each leaf once it is filled.
    after: tuple[Callable[[list[np.ndarray]], list[np.ndarray]], ...] = ()

    def then(self, f: Callable[[list[np.ndarray]], list[np.ndarray]]) -> Stream:
        return replace(self, after=(*self.after, f))

    def table(self, spark) -> DataFrame:
        """One row a task."""
        return spark.range(0, self.tasks, 1, self.tasks)

    def planned(self, part: int, side: str) -> Iterator[blocks.Block]:
        target, source, _, _ = self.sent.value
        n, o = self.shape[side == "s"], self.options
        decide = blocks.decider(o.admissible or blocks.rjasanow_steinbach(o.eta), o.symmetry, o.uplo, self.owner, o.consistent, o.min_depths)
        for b in blocks.leaves_within(target, source, decide, o.symmetry, side, n * part // self.tasks, n * (part + 1) // self.tasks):
            if not self.diagonal or b.t.owner == b.s.owner:
                yield b

    def rows(self, frame: pd.DataFrame, side: str) -> Iterator[Row]:
        """The leaves of a task's rows (``side`` t) or columns (s)."""
        _, _, x, y = self.sent.value
        for part in frame["id"]:
            for b in self.planned(int(part), side):
                plan = Row(b.t.offset, b.t.size, b.s.offset, b.s.size, b.t.owner, b.s.owner, b.storage, b.symmetry, b.mirror, [])
                parts, _ = payload(plan, self.kernel, x[plan.t_off : plan.t_off + plan.t_size], y[plan.s_off : plan.s_off + plan.s_size], self.options)
                for f in self.after:
                    parts = f(parts)
                yield plan._replace(parts=parts)

    def filled(self, spark) -> DataFrame:
        """The leaves as a table, made anew by each action."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            _, _, x, y = self.sent.value

            def rows(frame: pd.DataFrame) -> Iterator[dict]:
                for part in frame["id"]:
                    for k, b in enumerate(self.planned(int(part), "t")):
                        plan = Row(b.t.offset, b.t.size, b.s.offset, b.s.size, b.t.owner, b.s.owner, b.storage, b.symmetry, b.mirror, [])
                        own = plan._asdict() | {"block_id": (int(part) << 40) + k}
                        yield own | fill(plan, self.kernel, x[plan.t_off : plan.t_off + plan.t_size], y[plan.s_off : plan.s_off + plan.s_size], self.options, self.after)

            for frame in frames:
                yield from batches(rows(frame))

        return self.table(spark).mapInPandas(run, SCHEMA)

    def is_complex(self) -> bool:
        _, _, x, y = self.sent.value
        return np.iscomplexobj(self.kernel.block(x[:1], y[:1]))


def assemble(target: ClusterTree, source: ClusterTree, kernel: Kernel | str, options: Options = Options(), owner: int | None = None, stored: bool = True) -> HMatrix:
    """Plan the blocks and fill every leaf.

    With ``stored=False`` nothing is kept: each product plans and fills the leaves again inside its tasks. Such a matrix has no
    plan for factorisations. Clouds beyond ``STREAM_BYTES`` are stored in any case.
    """
    kernel = KERNELS[kernel] if isinstance(kernel, str) else kernel
    spark = target.points.sparkSession
    d = len(target.root.center)
    size = 8 * d * (target.size + (0 if source is target and not stored else source.size))
    small = size <= (BROADCAST_BYTES if stored else STREAM_BYTES)
    if small:
        x = coordinates(target)
        y = x if source is target else coordinates(source)
    if small and not stored:
        blocks.decider(options.admissible or blocks.rjasanow_steinbach(options.eta), options.symmetry, options.uplo)
        context = spark.sparkContext
        tasks = max(1, min(target.size, source.size, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * context.defaultParallelism)))
        stream = Stream(context.broadcast((target.root, source.root, x, y)), (target.size, source.size), kernel, options, tasks, owner)
        return HMatrix(stream.filled(spark), target, source, options, None, stream)
    plan = blocks.build(target.root, source.root, options.admissible or blocks.rjasanow_steinbach(options.eta), options.symmetry, options.uplo, owner, options.consistent, options.min_depths)
    leaves = leaf_plan(plan, spark)
    planned = leaves.columns
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the work of a leaf is its area; a hash of the number deals large and small ones evenly
    dealt = leaves.repartition(shuffles, F.xxhash64("block_id"))
    if small:
        sent = spark.sparkContext.broadcast((x, y))
    else:
        for tree, off, size, into in ((target, "t_off", "t_size", "x"), (source, "s_off", "s_size", "y")):
            dealt = _with_segments(dealt, _segments(tree.points, "coords"), off, size, into)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows(frame: pd.DataFrame) -> Iterator[dict]:
            for row in frame.itertuples(index=False):
                if small:
                    xs, ys = sent.value
                    xs, ys = xs[row.t_off : row.t_off + row.t_size], ys[row.s_off : row.s_off + row.s_size]
                else:
                    cut = lambda a, off, n: np.stack(a)[off % SEGMENT : off % SEGMENT + n].astype(float)
                    xs, ys = cut(row.x, row.t_off, row.t_size), cut(row.y, row.s_off, row.s_size)
                yield {c: getattr(row, c) for c in planned} | fill(row, kernel, xs, ys, options)

        for frame in frames:
            yield from batches(rows(frame))

    filled = durable(dealt.mapInPandas(run, SCHEMA))
    return HMatrix(filled, target, source, options, plan)


def parts_of(row) -> list[np.ndarray]:
    """A leaf's dense block alone, or its two factors."""
    if isinstance(row, Row):
        return row.parts
    if row.storage == "dense":
        return [unpack(row.dense, row.t_size, row.s_size, row.dtype)]
    return [unpack(row.u, row.t_size, row.rank, row.dtype), unpack(row.v, row.rank, row.s_size, row.dtype)]


def _apply(row, x: np.ndarray, trans: str) -> tuple[np.ndarray, np.ndarray | None]:
    """(contribution, that of the mirrored block or None); x gives any interval of the input."""
    def op(a: np.ndarray, t: str) -> np.ndarray:
        return a if t == "N" else a.T if t == "T" else a.conj().T

    parts = parts_of(row)

    def times(t: str, own: np.ndarray) -> np.ndarray:
        out = own
        for a in reversed(parts) if t == "N" else parts:
            out = op(a, t) @ out
        return out

    rows, cols = slice(row.t_off, row.t_off + row.t_size), slice(row.s_off, row.s_off + row.s_size)
    return times(trans, x[cols if trans == "N" else rows]), (rows, cols)


@dataclass(frozen=True)
class HMatrix:
    leaves: DataFrame
    target: ClusterTree
    source: ClusterTree
    options: Options
    plan: blocks.Block | None = None
    #: How tasks make the leaves, for a matrix that is not stored.
    stream: Stream | None = None

    @property
    def shape(self) -> tuple[int, int]:
        return self.target.size, self.source.size

    def product(self, x: DataFrame, trans: str = "N", alpha: complex = 1.0, beta: complex = 0.0, y: DataFrame | None = None, complex_x: bool = False) -> DataFrame:
        """alpha op(A) x + beta y in cluster numbering; x and y are ``(pos, val)``, val a double, or an array for several right sides.

        Output positions are those of op(A)'s rows. Complex numbers are two successive elements of an array:
        those of x with ``complex_x``, those of y and of the result if A, x, alpha or beta is complex.
        """
        sym = self.options.symmetry
        if trans not in ("N", "T", "C") or (trans, sym) in (("T", "H"), ("C", "S")):
            raise ValueError(f"trans {trans} is not defined with symmetry {sym}")
        n_in = self.shape[1] if trans == "N" else self.shape[0]
        many = dict(x.dtypes)["val"].startswith("array")
        width = x.select(F.size("val")).first()[0] if many else 1
        if self.stream is None and 16 * n_in * width > BROADCAST_BYTES:
            return self._product_by_join(x, trans, alpha, beta, y, complex_x, width)
        full = positions(x.select("pos", *[F.col("val")[k].cast("double").alias(f"v{k}") for k in range(width)]) if many else x.select("pos", F.col("val").cast("double")), n_in)
        sent = self.leaves.sparkSession.sparkContext.broadcast(full.view(complex) if complex_x else full)
        return self._collected(self.leaves, lambda row: sent.value, trans, sym, many, alpha, beta, y, complex_x, width, self.stream)

    def times(self, x: np.ndarray, trans: str = "N") -> np.ndarray:
        """op(A) x for real right sides on the driver, one a column; of a matrix that is real and not stored."""
        sent = self.leaves.sparkSession.sparkContext.broadcast(x)
        k = x.shape[1]
        table = self._collected(self.leaves, lambda row: sent.value, trans, self.options.symmetry, True, 1.0, 0.0, None, False, k, self.stream)
        out = positions(table.select("pos", *[F.col("val")[i].alias(f"v{i}") for i in range(k)]), self.shape[trans != "N"])
        sent.destroy()
        return out

    def _collected(self, leaves: DataFrame, source, trans: str, sym: str, many: bool, alpha, beta, y: DataFrame | None, complex_x: bool, width: int, stream: Stream | None = None) -> DataFrame:
        """Partial products summed inside each task first, then over the tasks; with a stream, a task's leaves are those of its part of the result."""
        side = "t" if trans == "N" else "s"
        mirrored = "N" if trans != "N" else "C" if sym == "H" else "T"
        is_complex = complex_x or isinstance(alpha, complex) or isinstance(beta, complex) or self.is_complex
        n_out = self.shape[0] if trans == "N" else self.shape[1]

        def streamed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # blocks of all sizes add to one vector of the result
            total, touched = None, np.zeros(n_out, bool)
            for frame in frames:
                for row in stream.rows(frame, side):
                    x = source(row)
                    for t in (trans, mirrored) if row.mirror else (trans,):
                        part, (rows, cols) = _apply(row, x, t)
                        if total is None:
                            total = np.zeros((n_out, part.shape[1]), part.dtype)
                        at = rows if t == "N" else cols
                        total[at] += part
                        touched[at] = True
            for lo in range(0, n_out, EMITTED):
                at = lo + np.flatnonzero(touched[lo : lo + EMITTED])
                if len(at):
                    flat = np.ascontiguousarray(alpha * total[at], complex).view(float) if is_complex else np.asarray(alpha * total[at], float)
                    yield pd.DataFrame({"pos": at, "parts": list(flat)})

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[int, np.ndarray] = {}

            def put(off: int, part: np.ndarray) -> None:
                sums[off] = part if off not in sums else sums[off] + part if sums[off].shape == part.shape else _widen(sums[off], part)

            for frame in frames:
                for row in frame.itertuples(index=False):
                    x = source(row)
                    part, (rows, cols) = _apply(row, x, trans)
                    put((rows if trans == "N" else cols).start, part)
                    if row.mirror:
                        part, _ = _apply(row, x, mirrored)
                        put((cols if mirrored != "N" else rows).start, part)
            for off, part in sums.items():
                flat = np.ascontiguousarray(alpha * part, complex).view(float) if is_complex else np.asarray(alpha * part, float)
                yield pd.DataFrame({"pos": off + np.arange(len(flat)), "parts": list(flat)})

        schema = "pos long, parts array<double>"
        partial = leaves.mapInPandas(run, schema) if stream is None else stream.table(leaves.sparkSession).mapInPandas(streamed, schema)
        columns = width if complex_x or not is_complex else 2 * width
        sums = [F.sum(F.col("parts")[k]).alias(f"v{k}") for k in range(columns)]
        summed = partial.groupBy("pos").agg(*sums)
        as_array = many or is_complex
        out = summed.select("pos", (F.array(*[f"v{k}" for k in range(columns)]) if as_array else F.col("v0")).alias("val"))
        if y is None:
            return out
        if as_array:
            scaled = _times("_y", beta)
            mixed = F.when(F.col("_y").isNull(), F.col("val")).when(F.col("val").isNull(), scaled).otherwise(F.zip_with("val", scaled, lambda a, b: a + b))
        else:
            mixed = F.coalesce("val", F.lit(0.0)) + F.lit(float(beta)) * F.coalesce("_y", F.lit(0.0))
        return out.join(y.select("pos", F.col("val").alias("_y")), "pos", "full").select("pos", mixed.alias("val"))

    def _product_by_join(self, x: DataFrame, trans: str, alpha, beta, y: DataFrame | None, complex_x: bool, width: int) -> DataFrame:
        many = dict(x.dtypes)["val"].startswith("array")
        segments = _segments(x, "val")
        own = _with_segments(self.leaves, segments, "s_off", "s_size", "xs")
        own = _with_segments(own, segments, "t_off", "t_size", "xt") if trans != "N" or self.options.symmetry != "N" else own.withColumn("xt", F.lit(None).cast(own.schema["xs"].dataType))

        class Interval:
            def __init__(self, row) -> None:
                self.row = row

            def __getitem__(self, at: slice) -> np.ndarray:
                got = self.row.xs if (at.start, at.stop) == (self.row.s_off, self.row.s_off + self.row.s_size) else self.row.xt
                a = _numbers(got, many, complex_x)
                return a[at.start % SEGMENT : at.start % SEGMENT + at.stop - at.start]

        return self._collected(own, Interval, trans, self.options.symmetry, many, alpha, beta, y, complex_x, width)

    @property
    def is_complex(self) -> bool:
        if self.stream is not None:
            return self.stream.is_complex()
        return self.leaves.filter("dtype = 'complex'").limit(1).count() > 0

    def user_product(self, x: DataFrame, trans: str = "N", alpha: complex = 1.0, beta: complex = 0.0, y: DataFrame | None = None, complex_x: bool = False) -> DataFrame:
        """The same in user numbering: ``(point_id, val)``."""
        rows, cols = (self.target, self.source) if trans == "N" else (self.source, self.target)
        return rows.to_user(self.product(cols.to_cluster(x), trans, alpha, beta, None if y is None else rows.to_cluster(y), complex_x))

    def local_product(self, owner: int, x: DataFrame, trans: str = "N") -> DataFrame:
        """op(A) x with the part of x that one owner holds, ``(pos, val)`` by its own numbers from 0; the result is the owner's part, numbered likewise."""
        tree_in, tree_out = (self.source, self.target) if trans == "N" else (self.target, self.source)
        (lo_in, _), (lo_out, n_out) = tree_in.part(owner), tree_out.part(owner)
        # the other owners' rows of the result are not wanted
        own = self.restricted(owner) if trans == "N" else self
        y = own.product(x.withColumn("pos", F.col("pos") + lo_in), trans)
        return y.filter((F.col("pos") >= lo_out) & (F.col("pos") < lo_out + n_out)).withColumn("pos", F.col("pos") - lo_out)

    def sub_product(self, x: DataFrame, rows: tuple[int, int] | None = None, columns: tuple[int, int] | None = None) -> DataFrame:
        """A[rows, columns] x for intervals ``(offset, size)`` in cluster numbering; x and the result count from their beginning."""
        (r0, m), (c0, n) = rows or (0, self.shape[0]), columns or (0, self.shape[1])
        y = self.product(x.filter((F.col("pos") >= 0) & (F.col("pos") < n)).withColumn("pos", F.col("pos") + c0))
        return y.filter((F.col("pos") >= r0) & (F.col("pos") < r0 + m)).withColumn("pos", F.col("pos") - r0)

    def information(self, *by: str) -> DataFrame:
        """Ranks, block sizes, numbers stored, compression ratio, space saving, false positives: one row, or one for each value of leaf columns, such as ``owner``."""
        stored = F.when(F.col("storage") == "dense", F.col("t_size") * F.col("s_size")).otherwise(F.col("rank") * (F.col("t_size") + F.col("s_size")))
        area = F.col("t_size") * F.col("s_size")
        twice = F.when(F.col("mirror"), 2).otherwise(1)
        low, dense = F.col("storage") == "lowrank", F.col("storage") == "dense"
        of = lambda name, c, test: [f(F.when(test, c)).alias(f"{name}_{n}") for n, f in (("max", F.max), ("mean", F.avg), ("min", F.min))]
        total = self.leaves.groupBy(*by).agg(
            F.sum(dense.cast("long")).alias("dense_blocks"), F.sum(low.cast("long")).alias("low_rank_blocks"), F.sum(F.col("false_positive").cast("long")).alias("false_positives"),
            *of("dense_size", area, dense), *of("low_rank_size", area, low), *of("rank", F.col("rank"), low), F.sum(stored).alias("stored"), F.sum(area * twice).alias("entries"), F.sum(stored * twice).alias("_full"),
        )
        return total.withColumn("compression_ratio", F.col("entries") / F.col("stored")).withColumn("space_saving", 1 - F.col("_full") / F.col("entries")).drop("_full")

    def tree_parameters(self) -> DataFrame:
        """``(key, value)``: how the two trees and the blocks were made."""
        o = self.options
        named = {"eps": o.eps, "eta": o.eta, "rank": o.rank, "compressor": o.compressor if isinstance(o.compressor, str) else "given", "symmetry": o.symmetry, "uplo": o.uplo, "consistent": o.consistent, "min_target_depth": o.min_depths[0], "min_source_depth": o.min_depths[1]}
        for name, tree in (("target", self.target), ("source", self.source)):
            leaves = [n for n in tree.root.preorder() if not n.children]
            named |= {f"{name}_size": tree.size, f"{name}_children": tree.how.children, f"{name}_leaf": tree.how.leaf, f"{name}_clusters": sum(1 for _ in tree.root.preorder()), f"{name}_depth_max": max(n.depth for n in leaves), f"{name}_depth_min": min(n.depth for n in leaves)}
        return self.leaves.sparkSession.createDataFrame([(k, str(v)) for k, v in named.items()], "key string, value string")

    def block(self, t_off: int, t_size: int, s_off: int, s_size: int) -> HMatrix | None:
        """The leaves of one block of the tree, with their positions as before; None if the tree has no such block."""
        if self.stream is not None:
            raise ValueError("a matrix that is not stored has no plan of blocks")
        found = self.plan.find(t_off, t_size, s_off, s_size) if self.plan is not None else None
        if found is None:
            return None
        inside = (F.col("t_off") >= t_off) & (F.col("t_off") + F.col("t_size") <= t_off + t_size) & (F.col("s_off") >= s_off) & (F.col("s_off") + F.col("s_size") <= s_off + s_size)
        return replace(self, leaves=self.leaves.filter(inside), plan=found)

    def low_rank_leaves(self) -> DataFrame:
        return self.leaves.filter("storage = 'lowrank'")

    def block_errors(self, kernel: Kernel | str) -> DataFrame:
        """``(block_id, rank, error, norm)``: Frobenius distance of each low-rank leaf from the kernel's block, and that block's norm."""
        exact = assemble(self.target, self.source, kernel, replace(self.options, admissible=self.options.admissible or blocks.rjasanow_steinbach(self.options.eta), compressor=_never))
        whole = exact.leaves.select("t_off", "t_size", "s_off", "s_size", F.col("dense").alias("exact"), F.col("dtype").alias("exact_type"))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                for row in frame.itertuples(index=False):
                    a = unpack(row.exact, row.t_size, row.s_size, row.exact_type)
                    rows.append((row.block_id, row.rank, float(np.linalg.norm(a - block_of(row))), float(np.linalg.norm(a))))
                yield pd.DataFrame(rows, columns=["block_id", "rank", "error", "norm"])

        return self.low_rank_leaves().join(whole, ["t_off", "t_size", "s_off", "s_size"]).mapInPandas(run, "block_id long, rank int, error double, norm double")

    def ranks(self) -> DataFrame:
        """Leaves with their rank, -1 for dense ones."""
        return self.leaves.select("t_off", "t_size", "s_off", "s_size", "rank")

    def entries(self, mirror: bool = True) -> DataFrame:
        """``(i, j, val)`` of all stored entries in cluster numbering, for real matrices; the mirrored half if asked for."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.itertuples(index=False):
                    a = block_of(row)
                    i, j = np.indices(a.shape)
                    i, j, a = (i + row.t_off).ravel(), (j + row.s_off).ravel(), a.real.ravel()
                    yield pd.DataFrame({"i": i, "j": j, "val": a})
                    if mirror and row.mirror:
                        yield pd.DataFrame({"i": j, "j": i, "val": a})

        return self.leaves.mapInPandas(run, "i long, j long, val double")

    def frobenius(self) -> DataFrame:
        """``(norm, entries)``: the Frobenius norm and the number of entries, mirrored ones too, summed leaf by leaf inside the tasks."""
        stream = self.stream

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                squares, entries = [], 0
                for row in frame.itertuples(index=False) if stream is None else stream.rows(frame, "t"):
                    parts, twice = parts_of(row), 2 if row.mirror else 1
                    # |U V|^2 = sum of (U* U) o (V V*)^T, so that a low-rank leaf is not multiplied out
                    own = np.vdot(parts[0], parts[0]) if len(parts) == 1 else ((parts[0].conj().T @ parts[0]) * (parts[1] @ parts[1].conj().T).T).sum()
                    squares.append(twice * own.real)
                    entries += twice * row.t_size * row.s_size
                yield pd.DataFrame({"squares": [math.fsum(squares)], "entries": [entries]})

        sums = (self.leaves if stream is None else stream.table(self.leaves.sparkSession)).mapInPandas(run, "squares double, entries long")
        return sums.agg(F.sqrt(F.sum("squares")).alias("norm"), F.sum("entries").alias("entries"))

    def diagonal(self) -> DataFrame:
        """``(pos, val)`` of the diagonal."""
        near = (F.col("t_off") < F.col("s_off") + F.col("s_size")) & (F.col("s_off") < F.col("t_off") + F.col("t_size"))
        return replace(self, leaves=self.leaves.filter(near), stream=None).entries(False).filter("i = j").select(F.col("i").alias("pos"), "val")

    def to_numpy(self, user: bool = False) -> np.ndarray:
        """The whole matrix on the driver; for small ones."""
        m, n = self.shape
        if 16 * m * n > 8 * BROADCAST_BYTES:
            raise ValueError("too large to be collected")
        rows = self.leaves.collect()
        out = np.zeros((m, n), complex if any(r.dtype == "complex" for r in rows) else float)
        for r in rows:
            a = block_of(r)
            out[r.t_off : r.t_off + r.t_size, r.s_off : r.s_off + r.s_size] = a
            if r.mirror:
                out[r.s_off : r.s_off + r.s_size, r.t_off : r.t_off + r.t_size] = a.conj().T if self.options.symmetry == "H" else a.T
        if user:
            t, s = (np.array([r.point_id for r in tree.permutation().orderBy("pos").collect()]) for tree in (self.target, self.source))
            out = out[np.argsort(t, kind="stable")][:, np.argsort(s, kind="stable")]
        return out

    def scale(self, a: float) -> HMatrix:
        if self.stream is not None:
            return self._streamed(self.stream.then(lambda parts: [parts[0] * float(a), *parts[1:]]))
        times = lambda c: F.transform(c, lambda x: x * float(a))
        smaller = F.col("t_size") <= F.col("s_size")
        return replace(self, leaves=self.leaves.withColumns({"dense": times("dense"), "u": F.when(smaller, times("u")).otherwise(F.col("u")), "v": F.when(smaller, F.col("v")).otherwise(times("v"))}))

    def recompress(self, eps: float | None = None) -> HMatrix:
        """Round every low-rank leaf."""
        tol = self.options.eps if eps is None else eps
        if self.stream is not None:
            return self._streamed(self.stream.then(lambda parts: list(recompress(*parts, tol)) if len(parts) == 2 else parts))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                frame = frame.copy()
                for k, row in enumerate(frame.itertuples(index=False)):
                    if row.storage == "lowrank":
                        u, v = recompress(unpack(row.u, row.t_size, row.rank, row.dtype), unpack(row.v, row.rank, row.s_size, row.dtype), tol)
                        for c, value in (("u", pack(u)), ("v", pack(v)), ("rank", u.shape[1])):
                            frame.iat[k, frame.columns.get_loc(c)] = value
                yield frame

        return replace(self, leaves=durable(self.leaves.mapInPandas(run, SCHEMA)))

    def _streamed(self, stream: Stream) -> HMatrix:
        return replace(self, leaves=stream.filled(self.leaves.sparkSession), stream=stream)

    def restricted(self, owner: int | None = None, diagonal: bool = False) -> HMatrix:
        """Rows of one owner, or only the blocks whose rows and columns have the same owner."""
        leaves = self.leaves if owner is None else self.leaves.filter(F.col("owner") == owner)
        stream = self.stream and replace(self.stream, owner=self.stream.owner if owner is None else owner, diagonal=diagonal or self.stream.diagonal)
        return replace(self, leaves=leaves.filter("owner = s_owner") if diagonal else leaves, stream=stream)

    def save(self, path: str) -> None:
        self.leaves.write.mode("overwrite").parquet(path)

    def load(self, path: str) -> HMatrix:
        return replace(self, leaves=self.leaves.sparkSession.read.parquet(path), stream=None)


def _never(entries, m: int, n: int, eps: float, rank: int) -> None:
    """A compressor that leaves every block dense."""


def _numbers(values, many: bool, is_complex: bool) -> np.ndarray:
    """Rows of right sides; complex ones from their interleaved parts."""
    a = np.stack([np.asarray(v, float) for v in values]) if many else np.asarray(values, float)[:, None]
    return np.ascontiguousarray(a).view(complex) if is_complex else a


def _times(column: str, k: complex) -> Column:
    """An array times a number; for a complex one the array has interleaved complex numbers."""
    if not isinstance(k, complex):
        return F.transform(column, lambda v: v * float(k))
    part = lambda i, j: F.get(column, 2 * i + j)
    both = lambda i: F.array(part(i, 0) * k.real - part(i, 1) * k.imag, part(i, 0) * k.imag + part(i, 1) * k.real)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.size(column) / 2).cast("int") - 1), both))


def _widen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of two intervals that begin at one place."""
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    out = np.array(long, dtype=np.result_type(a, b))
    out[: len(short)] += short
    return out


def block_of(row) -> np.ndarray:
    if row.storage == "dense":
        return unpack(row.dense, row.t_size, row.s_size, row.dtype)
    return unpack(row.u, row.t_size, row.rank, row.dtype) @ unpack(row.v, row.rank, row.s_size, row.dtype)
