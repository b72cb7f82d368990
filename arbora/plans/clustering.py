"""Cluster trees over point clouds: points -> clusters and permutation.

Two phases. Nodes of over ``LOCAL`` points are split level by level with Spark: means,
covariances and boxes are grouped aggregates, a level's order is one range sort of all
points (no task holds a node), and only the nodes' statistics come to the driver.
Smaller nodes are finished as whole subtrees, one task each.

Order is by projection and then point id, and directions have a canonical sign, so
that the tree is a function of the points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.sources.storage import durable

#: Points of a node that one task splits to its leaves.
LOCAL = 50_000


@dataclass(frozen=True)
class Clustering:
    """``direction``: pca or box; ``split``: regular or geometric; ``axes``: split along several axes at once."""

    children: int = 2
    leaf: int = 10
    direction: str = "pca"
    split: str = "regular"
    axes: bool = False
    complete: bool = False
    owners: int = 1

    def __post_init__(self) -> None:
        if self.direction not in ("pca", "box") or self.split not in ("regular", "geometric") or self.children < 2 or self.leaf < 1:
            raise ValueError("direction is pca or box, split is regular or geometric, at least two children and a leaf of one point")


@dataclass
class Node:
    """A contiguous interval of the permutation; ``owner`` is -1 above the partition."""

    offset: int
    size: int
    depth: int
    center: np.ndarray
    radius: float
    owner: int = -1
    counter: int = 0
    on_partition: bool = False
    children: list[Node] = field(default_factory=list)
    #: Whether the node is split further, above the partition always.
    split: bool = True

    def preorder(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += reversed(node.children)


def center_and_radius(x: np.ndarray, radius: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    center = (weight[:, None] * x).sum(axis=0) / weight.sum()
    return center, float((np.sqrt(((x - center) ** 2).sum(axis=1)) + radius).max())


def canonical(vectors: np.ndarray) -> np.ndarray:
    """Columns with their largest component positive."""
    at = np.abs(vectors).argmax(axis=0)
    sign = np.sign(vectors[at, np.arange(vectors.shape[1])])
    return vectors * np.where(sign == 0, 1, sign)


def axes_of(kind: str, covariance: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions (columns) and their extents, largest first."""
    if kind == "box":
        order = np.argsort(-(high - low), kind="stable")
        return np.eye(len(low))[:, order], (high - low)[order]
    values, vectors = np.linalg.eigh(covariance)
    return canonical(vectors[:, ::-1]), np.sqrt(np.maximum(values[::-1], 0))


def cut(along: np.ndarray, n: int, how: str) -> list[int]:
    """Ends of the n parts of points sorted along a direction; an empty list if a part would be empty."""
    size = len(along)
    if how == "regular":
        return [*(size // n * (k + 1) for k in range(n - 1)), size] if size >= n else []
    ends, begin = [], 0
    for k in range(n - 1):
        # equal lengths of what is left, from the first point of this part
        limit = along[begin] + (along[-1] - along[begin]) / (n - k)
        end = int(np.searchsorted(along, limit, side="right"))
        if end <= begin or end >= size:
            return []
        ends.append(end)
        begin = end
    return [*ends, size]


def factorisations(n: int, d: int) -> list[tuple[int, ...]]:
    return [f for f in product([k for k in range(1, n + 1) if n % k == 0], repeat=d) if np.prod(f) == n]


def parts(x: np.ndarray, ids: np.ndarray, weight: np.ndarray, how: Clustering, n: int) -> list[np.ndarray]:
    """Index arrays of the children, in order; an empty list if the split fails."""
    center = (weight[:, None] * x).sum(axis=0) / weight.sum()
    u = x - center
    vectors, extent = axes_of(how.direction, (weight[:, None] * u).T @ u, x.min(axis=0), x.max(axis=0))

    def along(own: np.ndarray, axis: int, k: int) -> list[np.ndarray]:
        p = x[own] @ vectors[:, axis]
        order = np.lexsort((ids[own], p))
        ends = cut(p[order], k, how.split)
        return [own[order[a:b]] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    plan = (n,)
    if how.axes:
        real = int((extent > 10 * np.finfo(float).eps).sum()) or 1
        # the most even boxes
        plan = min(factorisations(n, real), key=lambda f: (max(e / k for e, k in zip(extent, f, strict=False)) / max(1e-300, min(e / k for e, k in zip(extent, f, strict=False))), f))
    groups = [np.arange(len(x))]
    for axis, k in enumerate(plan):
        if k > 1:
            groups = [part for own in groups for part in along(own, axis, k)]
    if len(groups) != n:
        return parts(x, ids, weight, Clustering(how.children, how.leaf, how.direction, how.split), n) if how.axes else []
    return groups


def subtree(x: np.ndarray, ids: np.ndarray, radius: np.ndarray, weight: np.ndarray, how: Clustering, offset: int = 0, depth: int = 0, owner: int = -1, counter: int = 0, root: bool = True) -> tuple[Node, np.ndarray]:
    """The tree below a node and the order of its points."""
    levels, _ = partition_levels(how)
    order = np.arange(len(x))

    def grow(begin: int, size: int, depth: int, owner: int, counter: int, split: bool) -> Node:
        own = order[begin : begin + size]
        node = Node(offset + begin, size, depth, *center_and_radius(x[own], radius[own], weight[own]), owner, counter, owner >= 0 and depth == levels)
        above = how.owners > 1 and depth < levels
        if not (split or above):
            return node
        n = width(how, depth, counter)
        groups = parts(x[own], ids[own], weight[own], how, n) if size >= n else []
        if len(groups) != n or any(not len(g) for g in groups):
            return node
        order[begin : begin + size] = own[np.concatenate(groups)]
        large = any(len(g) > how.leaf for g in groups)
        for k, g in enumerate(groups):
            number = counter * how.children + k
            mine = owner if not above or depth < levels - 1 else number
            go_on = len(g) > how.leaf or how.complete and large
            node.children.append(grow(begin, len(g), depth + 1, mine, number, go_on))
            begin += len(g)
        return node

    top = grow(0, len(x), depth, 0 if owner < 0 and how.owners == 1 else owner, counter, root)
    return top, order


def width(how: Clustering, depth: int, counter: int) -> int:
    """How many children a node gets; those above the partition lead to one node an owner, the last of them takes the surplus."""
    levels, surplus = partition_levels(how)
    above = how.owners > 1 and depth < levels
    n = how.children if not above or levels > 1 else how.owners
    return n + (surplus if above and depth == levels - 1 and levels > 1 and counter == how.children ** (levels - 1) - 1 else 0)


def partition_levels(how: Clustering) -> tuple[int, int]:
    """Depth of the partition, and the children that its last node has more than the others."""
    if how.owners <= 1:
        return 0, 0
    if how.owners < how.children:
        return 1, 0
    levels = 0
    while how.children ** (levels + 1) <= how.owners:
        levels += 1
    return levels, how.owners - how.children**levels


@dataclass
class ClusterTree:
    """The nodes, and the permutation as a table ``(pos, point_id, coords, radius, weight)``."""

    root: Node
    points: DataFrame
    how: Clustering

    @property
    def size(self) -> int:
        return self.root.size

    def nodes(self) -> DataFrame:
        """``clusters`` as a table, with parents and places among siblings."""
        spark = self.points.sparkSession
        rows, stack = [], [(self.root, None, 0)]
        while stack:
            node, parent, k = stack.pop()
            own = len(rows)
            rows.append((own, parent, node.depth, k, node.owner, node.offset, node.size, node.counter, node.radius, node.center.tolist(), node.on_partition, not node.children))
            stack += [(c, own, i) for i, c in reversed(list(enumerate(node.children)))]
        return spark.createDataFrame(rows, "node_id long, parent_id long, depth int, child_index int, owner int, offset long, size long, counter long, radius double, center array<double>, on_partition boolean, is_leaf boolean")

    def part(self, owner: int) -> tuple[int, int]:
        """``(offset, size)`` of an owner's points in cluster numbering."""
        for node in self.root.preorder():
            if node.on_partition and node.owner == owner:
                return node.offset, node.size
        raise ValueError(f"no part has the owner {owner}")

    def permutation(self) -> DataFrame:
        return self.points.select("pos", "point_id")

    def to_user(self, values: DataFrame) -> DataFrame:
        """``(pos, ...)`` in cluster numbering to ``(point_id, ...)``."""
        return values.join(self.permutation(), "pos").drop("pos")

    def to_cluster(self, values: DataFrame) -> DataFrame:
        return values.join(self.permutation(), "point_id").drop("point_id")

    def at_depth(self, depth: int) -> DataFrame:
        """Points with the node of that depth, or the leaf above it, that holds them."""
        cut_ = [(n.offset, n.size, i) for i, n in enumerate(n for n in self.root.preorder() if n.depth == depth or n.depth < depth and not n.children)]
        spark = self.points.sparkSession
        table = spark.createDataFrame(cut_, "offset long, size long, cluster int")
        return self.points.join(table, (F.col("pos") >= F.col("offset")) & (F.col("pos") < F.col("offset") + F.col("size"))).drop("offset", "size")


_POINTS = "pos long, point_id long, coords array<double>, radius double, weight double"


def with_defaults(points: DataFrame) -> DataFrame:
    """radius 0 and weight 1 where the columns are missing."""
    extra = {"radius": 0.0, "weight": 1.0}
    return points.select("point_id", "coords", *[(F.col(c).cast("double") if c in points.columns else F.lit(v)).alias(c) for c, v in extra.items()])


def statistics(cloud: DataFrame, *by: str) -> DataFrame:
    """``(by..., n, weight, center, covariance, low, high)`` of the points ``(coords, weight)`` of each group: one aggregation.

    ``covariance`` is the weighted sum of the outer products about the center, as rows.
    """
    d = cloud.select(F.size("coords")).first()[0]
    c = lambda k: F.col("coords")[k]
    sums = cloud.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"), *[F.sum(F.col("weight") * c(k)).alias(f"s{k}") for k in range(d)],
        *[F.sum(F.col("weight") * c(i) * c(j)).alias(f"q{i}_{j}") for i in range(d) for j in range(i + 1)],
        *[f(c(k)).alias(f"{name}{k}") for k in range(d) for f, name in ((F.min, "lo"), (F.max, "hi"))],
    )
    center = lambda k: F.col(f"s{k}") / F.col("weight")
    about = lambda i, j: F.col(f"q{max(i, j)}_{min(i, j)}") - F.col("weight") * center(i) * center(j)
    return sums.select(
        *by, "n", "weight", F.array(*[center(k) for k in range(d)]).alias("center"), F.array(*[F.array(*[about(i, j) for j in range(d)]) for i in range(d)]).alias("covariance"),
        F.array(*[F.col(f"lo{k}") for k in range(d)]).alias("low"), F.array(*[F.col(f"hi{k}") for k in range(d)]).alias("high"),
    )


def reach(center: Column, coords: Column, radius: Column) -> Column:
    """Distance of a point's far end from a center; its largest value in a cluster is the cluster's radius."""
    return F.sqrt(F.aggregate(F.zip_with(coords, center, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)) + radius


def radii(cloud: DataFrame, *by: str) -> DataFrame:
    """``statistics`` with the ``radius`` of each group; the centers are joined back, so the points are read twice."""
    per = statistics(cloud, *by)
    own = cloud.join(per.select(*by, "center"), list(by)) if by else cloud.crossJoin(F.broadcast(per.select("center")))
    wide = own.groupBy(*by).agg(F.max(reach(F.col("center"), F.col("coords"), F.col("radius"))).alias("radius"))
    return per.join(wide, list(by)) if by else per.crossJoin(F.broadcast(wide))


def build(points: DataFrame, how: Clustering = Clustering(), local: int = LOCAL, partition: DataFrame | None = None) -> ClusterTree:
    """Cluster ``points(point_id, coords[, radius, weight])``.

    ``partition`` ``(point_id, owner)`` gives the parts, numbered from 0; then the root has a child for each of them,
    in their order, which is clustered on its own. Without it ``how.owners`` parts are made.
    """
    # rank orders the points of a node that is not split any more: by its parent's direction, or by id if it has none
    cloud = durable(with_defaults(points).withColumns({"offset": F.lit(0).cast("long"), "rank": F.lit(0).cast("long")}))
    n = cloud.count()
    if not n:
        raise ValueError("a cluster tree needs at least one point")
    if cloud.filter("coords IS NULL OR exists(coords, x -> x IS NULL OR isnan(x))").limit(1).count():
        raise ValueError("coordinates must not be null or NaN")
    levels, _ = partition_levels(how)
    root = Node(0, n, 0, np.zeros(0), 0.0, 0 if how.owners == 1 and partition is None else -1)
    root.on_partition = root.owner >= 0
    open_, placed = [root], cloud
    if partition is not None:
        if how.owners > 1:
            raise ValueError("owners are given by the partition or made, not both")
        levels = 1
        open_, placed = _by_partition(cloud, root, partition, how)
    if max(node.size for node in open_) > local and (how.split != "regular" or how.axes):
        raise ValueError("clouds of over LOCAL points are split regularly along one axis")
    while any(node.size > local and node.split for node in open_):
        open_, placed = _split_level(placed, open_, how, local, levels)
    return _finish(placed, root, open_, how)


def from_ranges(points: DataFrame, ranges: list[tuple[int, int]], how: Clustering = Clustering(), local: int = LOCAL) -> ClusterTree:
    """Cluster with a partition into ranges ``(offset, size)`` of the points' own numbers ``point_id``, which go from 0 without a gap."""
    ends = np.cumsum([size for _, size in ranges])
    if [off for off, _ in ranges] != [0, *ends[:-1].tolist()]:
        raise ValueError("the ranges follow each other from 0")
    owner = reduce(lambda c, k: F.when(F.col("point_id") < int(ends[k]), F.lit(k)).otherwise(c), range(len(ranges) - 1, -1, -1), F.lit(None).cast("int"))
    return build(points, how, local, points.select("point_id", owner.alias("owner")))


def _by_partition(cloud: DataFrame, root: Node, partition: DataFrame, how: Clustering) -> tuple[list[Node], DataFrame]:
    """The root's children by the given owners; every point has one, and owners are 0, 1, ... without a gap."""
    owned = durable(cloud.drop("offset").join(partition.select("point_id", F.col("owner").cast("int").alias("owner")), "point_id", "left"))
    counts = {r.owner: r["count"] for r in owned.groupBy("owner").count().collect()}
    if sorted(counts, key=lambda o: -1 if o is None else o) != list(range(len(counts))):
        raise ValueError("each point needs an owner, numbered from 0 without a gap")
    begin = 0
    for owner in range(len(counts)):
        large = any(c > how.leaf for c in counts.values())
        node = Node(begin, counts[owner], 1, np.zeros(0), 0.0, owner, owner, True, split=counts[owner] > how.leaf or how.complete and large)
        root.children.append(node)
        begin += node.size
    all_ = radii(owned.withColumn("one", F.lit(0)), "one").first()
    root.center, root.radius = np.array(all_.center), all_.radius
    at = owned.sparkSession.createDataFrame([(c.owner, c.offset) for c in root.children], "owner int, offset long")
    return list(root.children), durable(owned.join(F.broadcast(at), "owner").drop("owner"))


def _split_level(cloud: DataFrame, open_: list[Node], how: Clustering, local: int, levels: int) -> tuple[list[Node], DataFrame]:
    """One level for all nodes over ``local`` that are split: aggregates, one range sort, new offsets."""
    spark, large = cloud.sparkSession, {n.offset: n for n in open_ if n.size > local and n.split}
    named = spark.createDataFrame([(k,) for k in large], "offset long")
    axes = []
    for r in radii(cloud.join(F.broadcast(named), "offset"), "offset").collect():
        vectors, _ = axes_of(how.direction, np.array(r.covariance), np.array(r.low), np.array(r.high))
        axes.append((r.offset, vectors[:, 0].tolist()))
        large[r.offset].center, large[r.offset].radius = np.array(r.center), r.radius
    axis = spark.createDataFrame(axes, "offset long, axis array<double>")
    dot = F.aggregate(F.zip_with("coords", "axis", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    aimed = cloud.join(F.broadcast(axis), "offset", "left").withColumn("along", F.coalesce(dot, F.lit(0.0)))
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = durable(aimed.drop("axis").repartitionByRange(shuffles, "offset", "along", "point_id").sortWithinPartitions("offset", "along", "point_id").withColumn("at", F.monotonically_increasing_id()))
    counts = {r[0]: r[1] for r in ordered.groupBy(F.shiftright("at", 33)).count().collect()}
    before = np.concatenate([[0], np.cumsum([counts[k] for k in sorted(counts)])])
    first = spark.createDataFrame([(int(k), int(b)) for k, b in zip(sorted(counts), before, strict=False)], "part long, before long")
    pos = ordered.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(first), "part").withColumn("pos", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    out, moved = [n for n in open_ if n.offset not in large], []
    for node in large.values():
        k = width(how, node.depth, node.counter)
        above = how.owners > 1 and node.depth < levels
        ends = cut(np.arange(node.size), k, "regular")
        begin = 0
        for i, end in enumerate(ends):
            number = node.counter * how.children + i
            owner = node.owner if not above or node.depth < levels - 1 else number
            child = Node(node.offset + begin, end - begin, node.depth + 1, np.zeros(0), 0.0, owner, number, owner >= 0 and node.depth + 1 == levels)
            node.children.append(child)
            out.append(child)
            moved.append((node.offset, child.offset, child.offset + child.size))
            begin = end
        most = max(child.size for child in node.children)
        for child in node.children:
            child.split = child.size > how.leaf or how.complete and most > how.leaf
            # nodes above the partition are split whatever their size
            child.split = child.split or how.owners > 1 and child.depth < levels
    table = spark.createDataFrame(moved, "offset long, new long, stop long")
    joined = pos.join(F.broadcast(table), (pos["offset"] == table["offset"]) & (F.col("pos") >= F.col("new")) & (F.col("pos") < F.col("stop")), "left")
    rank = F.when(F.col("new").isNull(), pos["rank"]).otherwise(F.col("pos"))
    placed = joined.select("point_id", "coords", "radius", "weight", F.coalesce("new", pos["offset"]).alias("offset"), rank.alias("rank"))
    return out, durable(placed)


def _finish(cloud: DataFrame, root: Node, open_: list[Node], how: Clustering) -> ClusterTree:
    """Whole subtrees of the open nodes, a task each; their nodes come to the driver, their points stay."""
    start = {n.offset: (n.depth, n.owner, n.counter, n.split, n.on_partition) for n in open_}
    schema = _POINTS + ", nodes binary"

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        import pickle

        offset = int(key[0])
        frame = frame.sort_values(["rank", "point_id"], kind="stable")
        x = np.stack(frame["coords"].to_list()).astype(float)
        depth, owner, counter, split, on_partition = start[offset]
        top, order = subtree(x, frame["point_id"].to_numpy(), frame["radius"].to_numpy(float), frame["weight"].to_numpy(float), how, offset, depth, owner, counter, split)
        top.on_partition = on_partition
        frame = frame.iloc[order]
        nodes = [None] * len(frame)
        nodes[0] = pickle.dumps(top)
        return pd.DataFrame({"pos": offset + np.arange(len(frame)), "point_id": frame["point_id"], "coords": frame["coords"], "radius": frame["radius"], "weight": frame["weight"], "nodes": nodes})

    done = durable(cloud.groupBy("offset").applyInPandas(run, schema))
    import pickle

    at = {n.offset: n for n in open_}
    for r in done.filter("nodes IS NOT NULL").select("pos", "nodes").collect():
        made, node = pickle.loads(bytes(r["nodes"])), at[r["pos"]]
        node.center, node.radius, node.children, node.on_partition, node.owner = made.center, made.radius, made.children, made.on_partition, made.owner
    return ClusterTree(root, done.drop("nodes"), how)
