"""Block tree: which pairs of clusters are compressed, which stay dense."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.functions import vectors
from arbora.plans.clustering import Node

Admissible = Callable[[Node, Node], bool]


def rjasanow_steinbach(eta: float) -> Admissible:
    def check(t: Node, s: Node) -> bool:
        gap = float(np.sqrt(((t.center - s.center) ** 2).sum())) - t.radius - s.radius
        return 2 * min(t.radius, s.radius) < eta * max(gap, 0.0)

    return check


def admissible_pairs(clusters: DataFrame, pairs: DataFrame, eta: float) -> DataFrame:
    """``pairs(t, s)`` with ``admissible``, for ``clusters(id, center, radius)``: the same predicate on tables."""
    side = lambda n: clusters.select(F.col("id").alias(n), F.col("center").alias(f"c{n}"), F.col("radius").alias(f"r{n}"))
    gap = vectors.norm2(vectors.minus(F.col("ct"), F.col("cs"))) - F.col("rt") - F.col("rs")
    near = 2 * F.least("rt", "rs") < eta * F.greatest(gap, F.lit(0.0))
    return pairs.join(side("t"), "t").join(side("s"), "s").select("t", "s", near.alias("admissible"))


@dataclass
class Block:
    """A pair of clusters; ``storage`` is dense, lowrank (admissible) or tree; ``mirror`` leaves stand for their transpose too."""

    t: Node
    s: Node
    depth: int
    storage: str
    symmetry: str = "N"
    children: list[Block] = field(default_factory=list)
    mirror: bool = False

    def leaves(self):
        stack = [self]
        while stack:
            block = stack.pop()
            if block.children:
                stack += reversed(block.children)
            elif block.storage != "tree":
                yield block


    def walk(self):
        """All blocks, parents first."""
        stack = [self]
        while stack:
            block = stack.pop()
            yield block
            stack += reversed(block.children)

    def holds(self, other: Block) -> bool:
        """Whether the other block lies within this one; both of one tree: whether this is its ancestor or itself."""
        inside = lambda a, b: a.offset <= b.offset and b.offset + b.size <= a.offset + a.size
        return inside(self.t, other.t) and inside(self.s, other.s) and self.depth <= other.depth

    def find(self, t_off: int, t_size: int, s_off: int, s_size: int) -> Block | None:
        """The block of exactly these rows and columns; of several the deepest, None if there is none."""
        found = None
        for block in self.walk():
            if (block.t.offset, block.t.size, block.s.offset, block.s.size) == (t_off, t_size, s_off, s_size):
                found = block
        return found

    def levels(self) -> list[tuple[int, int, int, int, int, str]]:
        """``(depth, t_off, t_size, s_off, s_size, storage)`` of all blocks."""
        return [(b.depth, b.t.offset, b.t.size, b.s.offset, b.s.size, b.storage) for b in self.walk()]


def same(t: Node, s: Node) -> bool:
    return t.offset == s.offset and t.size == s.size


def partition_clusters(node: Node) -> list[Node]:
    """The clusters below a node that own a part."""
    if node.owner >= 0:
        return [node]
    return [p for c in node.children for p in partition_clusters(c)]


def decider(admissible: Admissible, symmetry: str = "N", uplo: str = "N", owner: int | None = None, consistent: bool = True, min_depths: tuple[int, int] = (0, 0)) -> Callable[[Node, Node], tuple[str, list]]:
    """What becomes of a pair: ``(storage, pairs)`` with storage lowrank or dense, tree and the pairs it is split into, or nothing.

    A pair is compressed if it is admissible, deep enough, owned and not removed by
    symmetry; pairs of leaves are dense; else the side that has children is split, or
    both. ``owner`` keeps the rows of one partition only.
    """
    if (symmetry == "N") != (uplo == "N") or symmetry not in "NSH" or uplo not in "NLU":
        raise ValueError("symmetry N goes with uplo N, S and H with L or U")

    def decide(t: Node, s: Node) -> tuple[str, list]:
        # wholly on the side of the diagonal that is not stored
        removed = uplo == "L" and s.offset >= t.offset + t.size or uplo == "U" and t.offset >= s.offset + s.size
        if removed or owner is not None and t.owner >= 0 and t.owner != owner:
            return "nothing", []
        if admissible(t, s) and t.depth >= min_depths[0] and s.depth >= min_depths[1] and t.owner >= 0 and (not consistent or s.owner >= 0):
            return "lowrank", []
        if not t.children and not s.children:
            return "dense", []
        if not s.children:
            return "tree", [(c, s) for c in t.children]
        if not t.children:
            return "tree", [(t, c) for c in s.children]
        if consistent and (t.owner < 0) != (s.owner < 0):
            return "tree", [(p, s) for p in partition_clusters(t)] if t.owner < 0 else [(t, p) for p in partition_clusters(s)]
        if not consistent and t.owner < 0:
            return "tree", [(p, s) for p in partition_clusters(t)]
        if not consistent and t.size != s.size:
            return "tree", [(c, s) for c in t.children] if t.size > s.size else [(t, c) for c in s.children]
        return "tree", [(a, b) for a in t.children for b in s.children]

    return decide


def leaf(t: Node, s: Node, depth: int, storage: str, symmetry: str) -> Block:
    diagonal = storage == "dense" and symmetry != "N" and same(t, s)
    return Block(t, s, depth, storage, symmetry if diagonal else "N", mirror=symmetry != "N" and not diagonal)


def build(target: Node, source: Node, admissible: Admissible, symmetry: str = "N", uplo: str = "N", owner: int | None = None, consistent: bool = True, min_depths: tuple[int, int] = (0, 0)) -> Block:
    """Decide every pair, from the roots down."""
    decide = decider(admissible, symmetry, uplo, owner, consistent, min_depths)

    def grow(t: Node, s: Node, depth: int) -> Block | None:
        storage, pairs = decide(t, s)
        if storage == "nothing":
            return None
        if storage != "tree":
            return leaf(t, s, depth, storage, symmetry)
        block = Block(t, s, depth, "tree", symmetry if symmetry != "N" and same(t, s) else "N")
        block.children = [b for p in pairs if (b := grow(*p, depth + 1)) is not None]
        return block

    return grow(target, source, 0) or Block(target, source, 0, "tree")


def leaves_within(target: Node, source: Node, decide: Callable[[Node, Node], tuple[str, list]], symmetry: str, side: str, lo: int, hi: int) -> Iterator[Block]:
    """The leaves that ``build`` makes and whose first row (``side`` t) or column (s) is in [lo, hi), one at a time; no tree of blocks is kept."""
    stack = [(target, source, 0)]
    while stack:
        t, s, depth = stack.pop()
        node = t if side == "t" else s
        if node.offset >= hi or node.offset + node.size <= lo:
            continue
        storage, pairs = decide(t, s)
        if storage == "tree":
            stack += [(*p, depth + 1) for p in pairs]
        elif storage != "nothing" and lo <= node.offset:
            yield leaf(t, s, depth, storage, symmetry)
