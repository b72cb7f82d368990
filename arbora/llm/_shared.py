"""Pieces that several corpus operators share: table access, durable cut points,
bounded tile joins and connected components."""

from __future__ import annotations

import tempfile
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of one side of a comparison tile; no task ever holds more than two such sides.
TILE_ROWS = 4096
#: Rows of counts up to which a table of them is broadcast, a few MB.
BROADCAST_ROWS = 100_000
#: Edges up to which the components are found on the driver, 16 bytes each; above, in tables.
FEW_EDGES = 500_000
#: Seconds that lie at least between two collections of the driver's garbage.
SWEEP_S = 4.0
_swept = [0.0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table; only Spark touches the path, so any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share; set here only where it is unset, as in tests."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = folder or tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return folder or context._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder; it survives lost executors."""
    shared_folder(df.sparkSession)
    sweep(df.sparkSession)
    return df.checkpoint()


def sweep(spark: SparkSession) -> None:
    """Collect the driver's garbage now and then: only so Spark deletes the shuffle files and checkpoints that nothing refers to any more."""
    if time.monotonic() - _swept[0] >= SWEEP_S:
        spark.sparkContext._jvm.System.gc()
        _swept[0] = time.monotonic()


def bare(df: DataFrame) -> DataFrame:
    """A checkpoint without Spark's estimate of its size: a join's is the product of its sides', so that in loops of joins
    its digits double each round, until planning takes minutes and the driver's memory."""
    cut, spark = durable(df)._jdf, df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(cut.queryExecution().toRdd(), cut.schema(), False), spark)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of all rows that no model learns from; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Forest:
    """Union-find over 0..n-1 whose unions are applied many at a time."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n, dtype=np.int64)

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        while len(left):
            a, b = self.root[left], self.root[right]
            apart = a != b
            if not apart.any():
                return
            left, right, a, b = left[apart], right[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def tiles(members: DataFrame, keys: list[str], order: str, rows: int = TILE_ROWS) -> DataFrame:
    """Deal the members of each key to comparison tiles of bounded size.

    ``members`` has the key columns, ``home`` (boolean) and a payload. In every key
    each home row has to meet each row; so homes form a left list, all rows a right
    list, both are cut into chunks of about ``rows`` rows by a hash of ``order``,
    and one tile compares one left with one right chunk. A key that holds a third
    of all rows becomes many tiles of the usual size. Adds ``tile_i``, ``tile_j``
    and ``left`` (role of this copy of the row).
    """
    sizes = members.groupBy(*keys).agg(
        F.greatest(F.lit(1), F.ceil(F.sum(F.col("home").cast("long")) / rows)).cast("int").alias("n_left"),
        F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / rows)).cast("int").alias("n_right"),
    )
    sizes = durable(sizes)
    # a join by a hot key meets few tasks; the sizes of all keys are broadcast while they are few
    dealt = members.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes, keys)
    chunk = F.xxhash64(F.col(order), F.lit("chunk"))
    tile = lambda i, j, left: F.struct(i.cast("int").alias("tile_i"), j.cast("int").alias("tile_j"), F.lit(left).alias("left"))
    own_left, own_right = F.pmod(chunk, F.col("n_left")), F.pmod(chunk, F.col("n_right"))
    as_left = F.transform(F.sequence(F.lit(0), F.col("n_right") - 1), lambda j: tile(own_left, j, True))
    as_right = F.transform(F.sequence(F.lit(0), F.col("n_left") - 1), lambda i: tile(i, own_right, False))
    # both roles from one pass over the members, which are costly to make
    copies = F.when(F.col("home"), F.concat(as_left, as_right)).otherwise(as_right)
    return dealt.withColumn("copy", F.explode_outer(copies)).select(*members.columns, "copy.*")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, component)``.

    ``component`` is the smallest node reachable; nodes without an edge to another
    node are absent. Up to ``FEW_EDGES`` edges are merged on the driver. Above, each round hangs every node below its smallest neighbour, follows
    these pointers to their roots and contracts the graph to the roots, at most half of
    the nodes; hubs are pre-aggregated. All state
    stays in checkpointed tables.
    """
    edges = bare(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if edges.limit(FEW_EDGES + 1).count() <= FEW_EDGES:
        return _few_components(edges)
    labels = None
    while True:
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        hung = _to_roots(bare(ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("parent"))))
        if labels is None:
            labels = hung.select("node", F.col("parent").alias("component"))
        else:
            step = hung.select(F.col("node").alias("component"), "parent")
            labels = bare(labels.join(step, "component", "left").select("node", F.coalesce("parent", "component").alias("component")))
        up = hung.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        vp = hung.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        contracted = edges.join(up, "a").join(vp, "b").filter("pa <> pb")
        edges = bare(contracted.select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct())
        if edges.isEmpty():
            return labels


def _few_components(edges: DataFrame) -> DataFrame:
    """Components of a graph of few edges, by union-find on the driver."""
    ends = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).toArrow()
    a, b = (ends.column(k).to_numpy() for k in "ab")
    names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    forest = Forest(len(names))
    forest.join(place[: len(a)], place[len(a) :])
    # names are sorted, so the least place of a tree is its smallest node
    return bare(dealt_table(edges.sparkSession, pa.table({"node": pa.array(names, pa.int64()), "component": pa.array(names[forest.root], pa.int64())})))


def dealt_table(spark: SparkSession, rows: pa.Table) -> DataFrame:
    """An Arrow table of the driver as batches that tasks read. As Spark's local relation each row would be an object in the
    driver's heap, and every plan that selects from it would make them anew there."""
    threshold = "spark.sql.execution.arrow.localRelationThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "0")
    try:
        return spark.createDataFrame(rows)
    finally:
        spark.conf.set(threshold, before)


def _to_roots(hung: DataFrame) -> DataFrame:
    """Pointer jumping: every node below the root of its tree, in as many steps as the depth has bits."""
    while True:
        up = hung.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = bare(hung.join(up, "parent").select("node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")))
        if jumped.filter("moved").isEmpty():
            return hung
        hung = jumped.select("node", "parent")


#: Words of 64 bits in a sieve: its broadcast has at most so many rows, whatever the input.
SIEVE_WORDS = 1 << 16
#: The same for the sieve of all shared bands, which are many: 21 MB at most to broadcast.
BAND_WORDS = 1 << 19


def sieve(rows: DataFrame, column: str, keys: DataFrame, words: int = SIEVE_WORDS) -> DataFrame:
    """The rows whose ``column`` may be among ``keys``' one: a superset without any loss, to be joined exactly after.

    The keys' hashes set bits of a bitmap of fixed size, which is broadcast, so that
    most rows without a partner are left out before the shuffle.
    """
    def at(name: str):
        h = F.xxhash64(name, F.lit("sieve"))
        return F.pmod(h, F.lit(words)).cast("int"), F.pmod(F.shiftright(h, 40), F.lit(64)).cast("int")

    word, bit = at(keys.columns[0])
    bits = keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"))
    word, bit = at(column)
    marked = rows.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(bits), "_word")
    return marked.filter(F.expr("shiftright(_bits, _bit) & 1L = 1L")).drop("_word", "_bit", "_bits")


#: Rows of one band that are met by one copy of its other side.
BUCKET_ROWS = 2048
#: Nodes of a band from which on its hub is chosen with care.
CROWDED = 8
#: Nodes of a band up to which all its pairs are met at once, half as many a node at most.
MET = 64
#: Nodes that meet a whole band before its pairs do.
PIVOTS = 16
Test = Callable[[Column, Column], Column]
Verify = Callable[[DataFrame], DataFrame]


def band_members(sketched: DataFrame) -> DataFrame:
    """``(band, node, mark, n)`` of the bands that several nodes share, n of them, from ``(node, mark, bands)``."""
    rows = sketched.select("node", "mark", F.explode_outer("bands").alias("band"))
    # only the bands themselves are dealt here: they are many times the nodes, and most are in no other node
    shared = durable(rows.filter("band IS NOT NULL").groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    return durable(sieve(rows, "band", shared.select("band")).join(shared, "band"))


def spread(rows: DataFrame, column: str, name: str) -> tuple[list[Column], Column]:
    """A column as one column a field, if it is a struct, and what puts them together: rows that are dealt are smaller without the struct."""
    kind = rows.schema[column].dataType
    if not isinstance(kind, StructType):
        return [F.col(column).alias(name)], F.col(name)
    return [F.col(column)[x].alias(f"{name}_{x}") for x in kind.names], F.struct(*[F.col(f"{name}_{x}").alias(x) for x in kind.names])


def likely_pairs(sketched: DataFrame, likely: Test, likeness: Test) -> tuple[DataFrame, DataFrame]:
    """``(a, b, like)``: the likely pairs of all bands of up to ``MET`` nodes, and the members of larger bands that have a likely partner there.

    Most nodes that share a band do so by chance; their bands are dealt once, and nothing else is kept or read for them.
    ``sketched`` is ``(node, mark, bands)``.
    """
    rows = sketched.select("node", "mark", F.explode("bands").alias("band"))
    shared = durable(rows.select("band").groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    large = shared.filter(F.col("n") > MET)
    few_large = large.count() <= BROADCAST_ROWS
    # sixteen bits a band let few others through, as long as there are enough words
    words = min(BAND_WORDS, max(SIEVE_WORDS, 1 << (shared.count() // 4).bit_length()))
    passed = sieve(rows, "band", shared.filter(F.col("n") <= MET).select("band"), words)
    # what else the sieve lets through is alone in its band, but for large bands
    passed = passed.join(F.broadcast(large) if few_large else large, "band", "left_anti")
    (left, mark_a), (right, mark_b) = (spread(passed, "mark", f"mark_{n}") for n in "ab")
    one, other = (passed.select(F.col("band").alias(f"band_{n}"), F.col("node").alias(n), *fields) for n, fields in (("a", left), ("b", right)))
    meet = (F.col("band_a") == F.col("band_b")) & (F.col("a") < F.col("b")) & likely(mark_a, mark_b)
    pairs = durable(one.join(other, meet).select("a", "b", likeness(mark_a, mark_b).alias("like")).distinct())
    crowded = durable(rows.join(F.broadcast(large), "band") if few_large else sieve(rows, "band", large.select("band"), words).join(large, "band"))
    # every node is a component of its own; whichever is called the largest, the same are found
    alone = crowded.withColumns({"c": F.col("node"), "largest": F.lit(0).cast("long")})
    return pairs, partnered(alone, likely).drop("c", "largest")


def band_hubs(members: DataFrame) -> DataFrame:
    """``(band, first, hub)``: a node of each band and its mark, in crowded bands the one that meets most others in all its bands.

    Of near-copies this is one of the most typical, so that most of them are linked with it and not only with each other.
    """
    least = members.filter(F.col("n") < CROWDED).groupBy("band").agg(F.min(F.struct("node", "mark")).alias("of"))
    crowded = members.filter(F.col("n") >= CROWDED)
    meets = crowded.groupBy("node").agg(F.sum("n").alias("meets"))
    most = crowded.join(meets, "node").groupBy("band").agg(F.max(F.struct("meets", "node", "mark")).alias("of"))
    return least.select("band", "of.node", "of.mark").unionByName(most.select("band", "of.node", "of.mark")).toDF("band", "first", "hub")


def apart(pairs: DataFrame, merged: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` that do not lie in one component."""
    one, other = (merged.select(F.col("node").alias(n), F.col("component").alias(f"c{n}")) for n in "ab")
    return pairs.join(one, "a", "left").join(other, "b", "left").filter("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")


def band_components(
    members: DataFrame,
    likely: Test,
    likeness: Test,
    verifier: Callable[[DataFrame], Verify],
    known: DataFrame | None = None,
    signer: Callable[[DataFrame], tuple[DataFrame, Test, Verify]] | None = None,
) -> DataFrame:
    """``(node, component)`` of the nodes that are linked with another one of a band.

    ``likely`` judges two marks, ``verifier`` gets all pairs ``(a, b)`` that may come and returns what keeps the linked ones of some of them, ``known`` are links found before. Every node is first
    verified against its band's hub, beginning with the band where ``likeness`` is
    greatest; what this links is merged. Members without a likely partner of another component are left out. Where bands remain that are crowded by several components, about ``PIVOTS`` nodes of each
    outside its largest one are verified against all others, and what they link is merged. Then all pairs of a band that still lie in different components are met:
    the nodes outside the band's largest component on one side, all on the other, which is cut into parts.
    ``signer`` gets the nodes of these and returns their signs ``(node, sign)``, what rules out pairs by two signs while they meet,
    and what verifies the others.
    """
    hubs = band_hubs(members)
    near = members.join(hubs, "band").filter("node <> first").filter(likely(F.col("mark"), F.col("hub")))
    stars = durable(near.groupBy(F.col("node").alias("a"), F.col("first").alias("b")).agg(F.max(likeness(F.col("mark"), F.col("hub"))).alias("like")))
    best = durable(stars.groupBy("a").agg(F.max_by("b", F.struct("like", "b")).alias("b")))
    verified = verifier(stars.select("a", "b"))
    open_ = best if known is None else apart(best, components(known))
    links = durable(verified(open_) if known is None else verified(open_).unionByName(known))
    rest = durable(apart(stars.select("a", "b").join(best, ["a", "b"], "left_anti"), components(links)))
    if not rest.isEmpty():
        links = durable(links.unionByName(verified(rest)))
    merged = components(links)
    # nothing refers to the files of these tables any more, nor to the texts that were read for them
    del hubs, near, best, open_, rest, verified
    done = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    mixed = partnered(several(members, merged), likely)
    del members
    if signer is None:
        mixed, differ, check = mixed.withColumn("sign", F.lit(None)), None, lambda some: verifier(some)(some)
    else:
        signs, differ, check = signer(durable(mixed.select("node").distinct()))
        mixed = durable(mixed.join(signs, "node"))
    # a pair that shares several bands is met in the least of them only
    mixed = durable(mixed.join(mixed.groupBy("node").agg(F.collect_list("band").alias("bands")), "node"))

    parts = {n: [spread(mixed, x, f"{x}_{n}") for x in ("mark", "sign")] for n in "ab"}

    def met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        (mark_a, sign_a), (mark_b, sign_b) = ([whole for _, whole in parts[n]] for n in "ab")
        both = left.join(right, keys).filter("ca <> cb AND (main OR a < b)").filter(likely(mark_a, mark_b))
        if differ is not None:
            both = both.filter(differ(sign_a, sign_b))
        pairs = both.filter(F.array_min(F.array_intersect("bands_a", "bands_b")) == F.col("band")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return durable(pairs.distinct().join(done, ["a", "b"], "left_anti"))

    side = lambda n: [F.col("node").alias(n), F.col("c").alias(f"c{n}"), *(x for fields, _ in parts[n] for x in fields), F.col("bands").alias(f"bands_{n}")]
    work = mixed.groupBy("band").agg(F.first("n").alias("n"), F.first("most").alias("most")).agg(F.sum((F.col("n") - F.col("most")) * F.col("n")).alias("pairs"), F.sum("n").alias("rows")).first()
    if (work.pairs or 0) > PIVOTS * (work.rows or 0):
        # some nodes outside the largest component meet all others first: what they link needs no meeting in pairs
        chosen = mixed.filter((F.col("c") != F.col("largest")) & (F.pmod(F.xxhash64("node", F.lit("pivot")), F.col("n") - F.col("most")) < PIVOTS))
        first = met(chosen.select("band", *side("a")), mixed.select("band", *side("b"), F.lit(True).alias("main")), ["band"])
        links = durable(links.unionByName(check(first)))
        done, merged = done.unionByName(first), components(links)
        mixed = several(mixed, merged, 1)
    outside, every = facing(mixed, side("a"), side("b"))
    fresh = met(outside, every, ["band", "part"])
    more = durable(check(fresh))
    return merged if more.isEmpty() else components(links.unionByName(more))


def facing(mixed: DataFrame, left: list[Column], right: list[Column]) -> tuple[DataFrame, DataFrame]:
    """The nodes outside their band's largest component, in each part of the band, and all nodes, each in one part; ``main`` are those in the largest."""
    parts = F.ceil(F.col("n") / BUCKET_ROWS).cast("int")
    outside = mixed.filter("c <> largest").select("band", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), *left)
    every = mixed.select("band", F.pmod(F.xxhash64("node", F.lit("part")), parts).alias("part"), *right, (F.col("c") == F.col("largest")).alias("main"))
    return outside, every


def partnered(mixed: DataFrame, likely: Test) -> DataFrame:
    """The members that have a likely partner of another component in their band; no pair of others can be linked.

    Most nodes that share a band by chance have none, so that they are left out before anything is read or kept for them.
    """
    (left, mark_a), (right, mark_b) = (spread(mixed, "mark", f"mark_{n}") for n in "ab")
    side = lambda n, fields: [F.col("node").alias(n), F.col("c").alias(f"c{n}"), *fields]
    outside, every = facing(mixed, side("a", left), side("b", right))
    outside, every = outside.alias("l"), every.alias("r")
    meet = (F.col("l.band") == F.col("r.band")) & (F.col("l.part") == F.col("r.part")) & (F.col("ca") != F.col("cb")) & likely(mark_a, mark_b)
    ones = outside.join(every, meet, "left_semi").select("band", F.col("a").alias("node"))
    others = every.filter("main").join(outside, meet, "left_semi").select("band", F.col("b").alias("node"))
    # both ends of such a pair stay in every band they share
    return durable(mixed.join(durable(ones.distinct().unionByName(others)), ["band", "node"]))


def several(members: DataFrame, merged: DataFrame, met: int = 2) -> DataFrame:
    """The members of bands of more than ``met`` nodes that hold several components, with their component ``c``, the band's ``largest`` one, its ``most`` nodes and all ``n``.

    A band of two is its hub's pair, but no longer where members were left out: the hub may have been one of them.
    """
    own = members.select(*[x for x in members.columns if x not in ("c", "largest", "most", "n")])
    label = durable(own.join(merged.withColumnRenamed("node", "_of"), F.col("node") == F.col("_of"), "left").drop("_of").withColumn("c", F.coalesce("component", "node")).drop("component"))
    sizes = label.groupBy("band", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(F.max_by("c", F.struct("n", "c")).alias("largest"), F.max("n").alias("most"), F.sum("n").alias("n"))
    return durable(label.join(sizes.filter((F.col("most") < F.col("n")) & (F.col("n") > met)), "band"))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of a text, split at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def batches(arrays: Iterator) -> Iterator:
    """The non-empty pandas frames of a mapInPandas iterator."""
    return (frame for frame in arrays if len(frame))
