"""Trees and blocks as files: Parquet for reuse, CSV and DOT for other tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.operators.hmatrix import HMatrix
from arbora.plans.clustering import Clustering, ClusterTree, Node


def save_tree(tree: ClusterTree, path: str) -> None:
    tree.nodes().write.mode("overwrite").parquet(f"{path}/clusters")
    tree.points.write.mode("overwrite").parquet(f"{path}/points")


def load_tree(spark, path: str, how: Clustering = Clustering()) -> ClusterTree:
    import numpy as np

    made: dict[int, Node] = {}
    root = None
    for r in spark.read.parquet(f"{path}/clusters").orderBy("node_id").collect():
        made[r.node_id] = Node(r.offset, r.size, r.depth, np.array(r.center), r.radius, r.owner, r.counter, r.on_partition)
        if r.parent_id is None:
            root = made[r.node_id]
        else:
            made[r.parent_id].children.append(made[r.node_id])
    return ClusterTree(root, spark.read.parquet(f"{path}/points"), how)


def tree_lines(tree: ClusterTree) -> DataFrame:
    """One line a depth: ``children|rank|offset|size|radius|counter|on_partition|center...`` of each node."""
    kids = tree.nodes().groupBy(F.col("parent_id").alias("_p")).agg(F.count(F.lit(1)).alias("children"))
    rows = tree.nodes().join(kids, F.col("node_id") == F.col("_p"), "left").na.fill(0, ["children"])
    cell = F.concat_ws("|", "children", "owner", "offset", "size", "radius", "counter", F.col("on_partition").cast("int"), F.array_join(F.transform("center", lambda x: x.cast("string")), "|"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", cell.alias("cell")))), lambda s: s["cell"]), ",")
    return rows.groupBy("depth").agg(line.alias("line"))


def save_ranks(h: HMatrix, path: str) -> None:
    """CSV of ``t_off,t_size,s_off,s_size,rank``, rank -1 for dense leaves."""
    h.ranks().orderBy("t_off", "s_off").write.mode("overwrite").option("header", True).csv(path)


def dot_lines(h: HMatrix) -> DataFrame:
    """Graphviz lines of the leaves, dense ones red, low-rank ones green."""
    name = F.concat_ws("_", "t_off", "t_size", "s_off", "s_size")
    colour = F.when(F.col("storage") == "dense", F.lit("red")).otherwise(F.lit("green"))
    return h.leaves.select(F.format_string('"%s" [label="%d x %d, rank %d", fillcolor=%s, style=filled];', name, "t_size", "s_size", "rank", colour).alias("value"))


def dot_tree_lines(h: HMatrix) -> DataFrame:
    """Graphviz lines of the whole block tree: a node a block, an edge from each block to its children."""
    name = lambda b: f"{b.t.offset}_{b.t.size}_{b.s.offset}_{b.s.size}_{b.depth}"
    colour = {"dense": "red", "lowrank": "green", "tree": "white"}
    lines = []
    for b in h.plan.walk():
        lines.append(f'"{name(b)}" [label="{b.t.size} x {b.s.size}", fillcolor={colour[b.storage]}, style=filled];')
        lines += [f'"{name(b)}" -> "{name(c)}";' for c in b.children]
    return h.leaves.sparkSession.createDataFrame([(k, x) for k, x in enumerate(["digraph {", *lines, "}"])], "line long, value string")


def level_table(h: HMatrix) -> DataFrame:
    """Every block with its depth: ``(depth, t_off, t_size, s_off, s_size, storage)``."""
    return h.leaves.sparkSession.createDataFrame(h.plan.levels(), "depth int, t_off long, t_size long, s_off long, s_size long, storage string")


def save_levels(h: HMatrix, path: str) -> None:
    level_table(h).orderBy("depth", "t_off", "s_off").write.mode("overwrite").option("header", True).csv(path)


def save_properties(tree: ClusterTree, path: str) -> None:
    """CSV of ``key,value``: how the tree was made, its size and depths."""
    leaves = [n for n in tree.root.preorder() if not n.children]
    rows = {"size": tree.size, "dimension": len(tree.root.center), "children": tree.how.children, "leaf": tree.how.leaf, "direction": tree.how.direction, "split": tree.how.split, "owners": tree.how.owners, "depth_max": max(n.depth for n in leaves), "depth_min": min(n.depth for n in leaves)}
    tree.points.sparkSession.createDataFrame([(k, str(v)) for k, v in rows.items()], "key string, value string").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def clustered_geometry(tree: ClusterTree, depths: list[int]) -> DataFrame:
    """``(point_id, coords..., depth, cluster)``: every point with its cluster at each of the depths."""
    from functools import reduce

    each = [tree.at_depth(d).select("point_id", "coords", F.lit(d).alias("depth"), "cluster") for d in depths]
    return reduce(DataFrame.unionByName, each)


def save_infos(spark, infos: dict[str, str], path: str) -> None:
    """What a solver tells, as ``key = value`` lines."""
    spark.createDataFrame([(f"{k} = {v}",) for k, v in infos.items()], "value string").coalesce(1).write.mode("overwrite").text(path)
