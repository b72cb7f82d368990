"""Near-duplicate embeddings by a subspace pigeonhole join.

Vectors are scaled to length one, so that cosine >= t means a squared distance of at
most T = 2 - 2t, and turned by one fixed rotation. The turned coordinates are split
into low-dimensional blocks with budgets T * share, the shares in proportion to the
blocks' energy and adding up to one. Two vectors within T are within budget in at
least one block; so every block is range-joined on its own, and the
union of the candidates is verified by the exact cosine in double precision. A
linked pair counts in the first block within whose budget it is, hence once.

Equal vectors are collapsed first to classes with ids of their own and counted by multiplicity. For a block the
vectors are sorted by a k-d tree over its coordinates and packed into chunks with their bounding boxes, one row a chunk.
Chunks whose boxes are within budget meet as a nested loop that reads the chunks again and writes none of them, so the disk
holds one or two copies of the vectors at a time, however many chunks a vector meets. A meeting
returns the links of each class as a count and a spanning forest, never pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different length never link; rows that share
a vec_id, or have none, count as separate vectors, each with its own links; a component's id is its smallest
vec_id that is not null, and null if it has none; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from arbora.llm._shared import Forest, batches, components, durable

THRESHOLD = 0.9
#: Coordinates in a block at least, and blocks at most.
BLOCK = 8
BLOCKS = 8
#: Vectors in a chunk, and chunks in a partition; a task meets two partitions.
TILE_ROWS = 4096
TILES = 8
#: Rows that fit the block shares and the trees; they shape the work, never the result.
SAMPLE = 4096
#: Slack of distances in single precision, of terms that are at most one.
_ROUGH = 1e-5
_SLACK = 1e-9


def rotation(d: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(20240229 + d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def turned(unit: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """unit @ turn, summed in one order whatever the number of rows, so that equal rows give equal bits."""
    out = np.zeros_like(unit)
    for k in range(unit.shape[1]):
        out += unit[:, k : k + 1] * turn[k]
    return out


def unit_rows(stacked: np.ndarray) -> np.ndarray:
    return stacked / np.sqrt((stacked * stacked).sum(axis=1, keepdims=True))


def layout(d: int) -> list[slice]:
    size = max(BLOCK, -(-d // BLOCKS))
    return [slice(k, min(k + size, d)) for k in range(0, d, size)]


def budgets(unit: np.ndarray, d: int, threshold: float) -> np.ndarray:
    """Squared-distance budget of each block, in proportion to its energy about the mean."""
    spread = turned(unit, rotation(d)).var(axis=0) if len(unit) > 1 else np.ones(d)
    energy = np.array([spread[b].sum() for b in layout(d)]) + 1e-6
    return (2 - 2 * threshold) * energy / energy.sum()


def tree(block: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(axis, cut) of each inner node of a k-d tree, in heap order from 1."""
    axis, cut, at = np.zeros(1 << depth, np.int64), np.zeros(1 << depth), np.ones(len(block), np.int64)
    for level in range(depth):
        for node in range(1 << level, 2 << level):
            own = block[at == node]
            if len(own):
                axis[node] = own.var(axis=0).argmax()
                cut[node] = np.median(own[:, axis[node]])
        at = 2 * at + (block[np.arange(len(block)), axis[at]] > cut[at])
    return axis, cut


def leaves(block: np.ndarray, axis: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The leaf of the tree in which each row lies; neighbours have near numbers."""
    at = np.ones(len(block), np.int64)
    for _ in range(len(axis).bit_length() - 1):
        at = 2 * at + (block[np.arange(len(block)), axis[at]] > cut[at])
    return at


def scaled(stacked: np.ndarray) -> np.ndarray:
    """Rows of length one; divided by their largest component before, so that no square overflows or vanishes."""
    wide = stacked.astype(np.float64)
    return unit_rows(wide / np.abs(wide).max(axis=1, keepdims=True))


def meet(a: tuple, b: tuple, same: bool, d: int, block: int, limit: np.ndarray, threshold: float) -> pd.DataFrame:
    """Links between two chunks ``(reps, copies, vectors)``, or within one, that count in this block."""
    dims, turn = layout(d), rotation(d)
    reps = np.concatenate([a[0], b[0]])
    copies = np.concatenate([a[1], b[1]])
    full = scaled(np.concatenate([a[2], b[2]]))
    split, end = len(a[0]), len(reps)
    if same:
        reps, copies, full, end = reps[:split], copies[:split], full[:split], split
    part = (full @ turn[:, dims[block]]).astype(np.float32)
    square = (part * part).sum(axis=1, keepdims=True)
    one = np.ones_like(square)
    # the product of these is the squared distance
    left, right = np.hstack([part, square, one]), np.ascontiguousarray(np.hstack([-2 * part, one, square])[0 if same else split :].T)
    base = 0 if same else split
    links, forest, exact, known = np.zeros(end, np.int64), Forest(end), np.zeros((end, d)), np.zeros(end, bool)
    for start in range(0, split, 256):
        skip = start if same else 0
        apart = left[start : min(start + 256, split)] @ right[:, skip:]
        hit = np.flatnonzero(apart <= np.float32(limit[block] + _ROUGH))
        i, j = np.divmod(hit, apart.shape[1])
        i, j = i + start, j + skip + base
        if same:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 65_536):
            x, y = i[at : at + 65_536], j[at : at + 65_536]
            sure = (full[x] * full[y]).sum(axis=1) >= threshold
            x, y = x[sure], y[sure]
            fresh = np.unique(np.concatenate([x, y]))
            fresh = fresh[~known[fresh]]
            exact[fresh], known[fresh] = turned(full[fresh], turn), True
            gap = exact[x] - exact[y]
            within = np.stack([(gap[:, s] ** 2).sum(axis=1) for s in dims[: block + 1]], axis=1) <= limit[: block + 1] + _SLACK
            first = within[:, block] & ~within[:, :block].any(axis=1)
            x, y = x[first], y[first]
            np.add.at(links, x, copies[y])
            np.add.at(links, y, copies[x])
            forest.join(x, y)
    told = np.flatnonzero(links > 0)
    return pd.DataFrame({"node": reps[told], "links": links[told], "root": reps[forest.root[told]]})


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, a row for each input row."""
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    # single precision stays as it is, half the bytes
    single = vectors.schema["embedding"].dataType == ArrayType(FloatType(), vectors.schema["embedding"].dataType.containsNull)
    name, dtype = ("float", np.float32) if single else ("double", np.float64)
    raw = vectors.select("vec_id", F.transform(F.col("embedding").cast(f"array<{name}>"), lambda x: x + F.lit(0.0).cast(name)).alias("v"))
    sound = F.coalesce(
        (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0),
        F.lit(False),
    )
    # 128 bits of hash stand for a vector where it need not be carried
    keys = [F.xxhash64("v").alias("k1"), F.xxhash64(F.lit("second"), "v").alias("k2")]
    classes = raw.filter(sound).groupBy("v").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    once = durable(classes.select(F.monotonically_increasing_id().alias("rep"), "first_id", "copies", "v", F.size("v").alias("d"), *keys))
    del classes
    rows, plans, trees, chunks = TILE_ROWS, {}, {}, 0
    for row in once.groupBy("d").count().collect():
        seen = once.filter(F.col("d") == row.d).orderBy(F.xxhash64("v")).limit(SAMPLE).select("v").toPandas()
        unit, own = scaled(np.stack(seen["v"].to_list())), -(-row["count"] // rows)
        plans[row.d], turn = budgets(unit, row.d, threshold), turned(unit, rotation(row.d))
        trees[row.d] = [tree(turn[:, dims], min((own - 1).bit_length(), max(0, (len(unit) // 8).bit_length() - 1))) for dims in layout(row.d)]
        chunks += own
    parts = max(min(TILES, chunks), -(-chunks // TILES))

    def search(b: int) -> DataFrame:
        """Links that count in this block of each length's vectors."""

        def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches(frames):
                for d, part in frame.groupby("d"):
                    if b < len(layout(d)):
                        turn = scaled(np.stack(part["v"].to_list())) @ rotation(d)[:, layout(d)[b]]
                        yield part.assign(leaf=leaves(turn, *trees[d][b]))

        def packed(d: int, part: pd.DataFrame) -> dict:
            stacked = np.stack(part["v"].to_list()).astype(dtype)
            turn, reach = scaled(stacked) @ rotation(d)[:, layout(d)[b]], float(plans[d][b]) + _ROUGH
            return {"d": d, "reach": reach, "low": turn.min(axis=0), "high": turn.max(axis=0), "reps": part["rep"].to_numpy(np.int64).tobytes(), "copies": part["copies"].to_numpy(np.int64).tobytes(), "vectors": stacked.tobytes()}

        def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[int, pd.DataFrame] = {}
            for frame in batches(frames):
                for d, part in frame.groupby("d", sort=False):
                    held[d] = pd.concat([held[d], part]) if d in held else part
                    while len(held[d]) >= rows:
                        yield pd.DataFrame([packed(d, held[d].iloc[:rows])])
                        held[d] = held[d].iloc[rows:]
            for d, part in held.items():
                if len(part):
                    yield pd.DataFrame([packed(d, part)])

        def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches(frames):
                for r in frame.itertuples(index=False):
                    d = int(r.d_a)
                    a, b_side = ((np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), np.frombuffer(z, dtype).reshape(-1, d)) for x, y, z in ((r.reps_a, r.copies_a, r.vectors_a), (r.reps_b, r.copies_b, r.vectors_b)))
                    yield meet(a, b_side, r.id_a == r.id_b, d, b, plans[d], threshold)

        placed = once.select("rep", "copies", "v", "d").mapInPandas(place, f"rep long, copies long, v array<{name}>, d int, leaf long")
        # ranges divide a crowded leaf as well; few partitions, since each meets each
        dealt = placed.repartitionByRange(parts, "d", "leaf", F.xxhash64("rep")).coalesce(parts).sortWithinPartitions("d", "leaf")
        table = durable(dealt.mapInPandas(pack, "d int, reach double, low array<double>, high array<double>, reps binary, copies binary, vectors binary").withColumn("id", F.monotonically_increasing_id()))
        one, other = (table.toDF(*[f"{c}_{n}" for c in table.columns]) for n in "ab")
        minus = lambda x, y: F.zip_with(x, y, lambda p, q: p - q)
        gaps = F.zip_with(minus("low_a", "high_b"), minus("low_b", "high_a"), lambda p, q: F.greatest(p, q, F.lit(0.0)))
        near = F.aggregate(gaps, F.lit(0.0), lambda total, x: total + x * x) <= F.col("reach_a")
        # no equality among the terms, which would shuffle each chunk to all that it meets
        pairs = one.join(other.hint("shuffle_replicate_nl"), (F.col("id_a") <= F.col("id_b")) & (F.abs(F.col("d_a") - F.col("d_b")) < 1) & near)
        return durable(pairs.select("d_a", "id_a", "id_b", "reps_a", "copies_a", "vectors_a", "reps_b", "copies_b", "vectors_b").mapInPandas(compare, "node long, links long, root long"))

    found = once.sparkSession.createDataFrame([], "node long, links long, root long")
    for b in range(max((len(layout(d)) for d in plans), default=0)):
        found = found.unionByName(search(b))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("others"))
    told = durable(
        once.select("rep", "first_id", "copies", "k1", "k2")
        .join(counts, F.col("rep") == counts.node, "left")
        .drop("node")
        .join(groups, F.col("rep") == groups.node, "left")
        .select("k1", "k2", "first_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("group"))
    )
    smallest = told.groupBy("group").agg(F.min("first_id").alias("component_id"))
    by_vector = told.join(smallest, "group").select("k1", "k2", "n_links", "component_id", F.lit(True).alias("sound"))
    keyed = raw.select("vec_id", *[F.when(sound, k).alias(n) for k, n in zip(keys, ("k1", "k2"), strict=True)])
    component = F.when(F.col("sound"), F.col("component_id")).otherwise(F.col("vec_id"))
    return keyed.join(by_vector, ["k1", "k2"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
