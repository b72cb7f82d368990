"""Near-duplicate documents by 64-bit SimHash, searched with a vantage-point tree.

Fingerprints are routed through a vantage-point tree: every node splits by the
Hamming distance to its vantage point, and the triangle inequality tells which
branches can hold a fingerprint within the radius. A fingerprint lives in one home
shard and visits each shard that its ball overlaps, only towards lower branches, so
that each pair meets exactly once. Inside a shard the same pruning goes on. The
result is exact: every pair of distinct fingerprints within ``radius`` bits is
found. The tree is fitted on a bounded sample (``sample``), which affects only the
balance of shards, never the result.

The pipeline stage has a wider rule, see ``keep_one``: what the tree cannot prune is found in bands of
least shingle hashes, and similarity is verified on the shingles.

Defined cases: null, empty or blank texts have fingerprint zero and are linked like
any other; repeated rows share a fingerprint and a component; an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.llm._shared import Forest, band_components, band_members, batches, components, durable, sieve, tiles, words_of

SHINGLE = 3
RADIUS = 3
SAMPLE = 65_536
#: Distinct fingerprints wanted in one shard.
SHARD = 8192
#: Fingerprints on one side of a comparison tile: eight bytes each, so twice a usual shard is small.
TILE = 16_384

#: The pipeline stage: shingles of five words, similar from 0.8 of exact Jaccard similarity.
STAGE_SHINGLE = 5
SIMILARITY = 0.8
#: Bits that may differ in 64, and in the further prints. At 0.8 about 10 and 39 do, in tiny texts 12 and 48.
STAGE_RADIUS = 22
WIDE_PRINTS = 4
WIDE_RADIUS = 72
#: Least hashes of a text, one a bin, and how many of them make a band: at 0.8 of similarity 99.7 % of pairs share one of the eight bands.
BINS = 24
BAND = 3


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit k is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    words = words_of(text)
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, 42) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 65_536):
        block = hashes[start : start + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)``, a row for each document; fp is the fingerprint's bits as a long."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames):
            prints = np.array([fingerprint(t, shingle) for t in frame["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "fp": prints.view(np.int64)})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, fp long")


def build_tree(points: np.ndarray, leaves: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, split distance, lower, upper); a child below zero is shard -child-1."""
    nodes: list[tuple[int, int, int, int]] = []
    shards = 0

    def grow(own: np.ndarray, want: int) -> int:
        nonlocal shards
        if want > 1 and len(own) > 1:
            vantage = own[len(own) // 2]
            far = np.bitwise_count(own ^ vantage)
            split = int(np.median(far))
            if far.max() <= split:
                split -= 1
            lower = far <= split
            if lower.any() and not lower.all():
                at = len(nodes)
                nodes.append((0, 0, 0, 0))
                nodes[at] = (int(vantage), split, grow(own[lower], want // 2), grow(own[~lower], want - want // 2))
                return at
        shards += 1
        return -shards

    grow(np.unique(points), leaves)
    return nodes


def route(prints: np.ndarray, nodes: list[tuple[int, int, int, int]], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, shard, home) for every shard in which a fingerprint lives or which it has to visit."""
    n = len(prints)
    if not nodes:
        return np.arange(n), np.zeros(n, np.int64), np.ones(n, bool)
    out: list[tuple[np.ndarray, int, bool]] = []
    stack = [(0, np.arange(n), True)]
    while stack:
        at, own, home = stack.pop()
        if not len(own):
            continue
        if at < 0:
            out.append((own, -at - 1, home))
            continue
        vantage, split, lower, upper = nodes[at]
        far = np.bitwise_count(prints[own] ^ np.uint64(vantage)).astype(np.int64)
        below = far <= split
        if home:
            stack += [(lower, own[below], True), (upper, own[~below], True), (lower, own[~below & (far - radius <= split)], False)]
        else:
            stack += [(lower, own[far - radius <= split], False), (upper, own[far + radius > split], False)]
    return (
        np.concatenate([o for o, _, _ in out]) if out else np.zeros(0, np.int64),
        np.concatenate([np.full(len(o), s) for o, s, _ in out]) if out else np.zeros(0, np.int64),
        np.concatenate([np.full(len(o), h) for o, _, h in out]) if out else np.zeros(0, bool),
    )


def close_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (left, right) within radius, in blocks; prunes by vantage points as far as that pays."""
    stack = [(np.arange(len(left)), np.arange(len(right)))]
    while stack:
        a, b = stack.pop()
        if not len(a) or not len(b):
            continue
        if len(a) > 256:
            vantage = left[a[len(a) // 2]]
            far_a = np.bitwise_count(left[a] ^ vantage).astype(np.int64)
            far_b = np.bitwise_count(right[b] ^ vantage).astype(np.int64)
            split = int(np.median(far_a))
            low = far_a <= split
            if low.any() and not low.all():
                stack += [(a[low], b[far_b <= split + radius]), (a[~low], b[far_b > split - radius])]
                continue
        for start in range(0, len(a), 256):
            own = a[start : start + 256]
            for begin in range(0, len(b), 8192):
                other = b[begin : begin + 8192]
                i, j = np.nonzero(np.bitwise_count(left[own][:, None] ^ right[other][None, :]) <= radius)
                if len(i):
                    yield own[i], other[j]


def linked(prints: DataFrame, radius: int = RADIUS, sample: int = SAMPLE) -> DataFrame:
    """Spanning edges ``(a, b)`` of all links between distinct fingerprints ``prints(fp)``."""
    n = prints.count()
    leaves = 1 << max(0, int(np.ceil(np.log2(max(1, n / SHARD)))))
    wanted = min(sample, 16 * leaves)
    seen = prints.orderBy(F.xxhash64("fp"), "fp").limit(wanted) if leaves > 1 else prints.limit(0)
    points = np.array([r.fp for r in seen.collect()], np.int64).view(np.uint64)
    nodes = build_tree(points, leaves)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames):
            own = frame["fp"].to_numpy(np.int64)
            index, shard, home = route(own.view(np.uint64), nodes, radius)
            yield pd.DataFrame({"shard": shard, "fp": own[index], "home": home})

    members = prints.mapInPandas(deal, "shard long, fp long, home boolean")

    def compare(_: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own, is_left = frame["fp"].to_numpy(np.int64), frame["left"].to_numpy(bool)
        ids, place = np.unique(own, return_inverse=True)
        left, right = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        bits, forest = own.view(np.uint64), Forest(len(ids))
        for i, j in close_pairs(bits[left], bits[right], radius):
            forest.join(place[left[i]], place[right[j]])
        child = np.flatnonzero(forest.root != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[child], "b": ids[forest.root[child]]})

    dealt = tiles(members, ["shard"], "fp", TILE)
    return dealt.groupBy("shard", "tile_i", "tile_j").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, a row for each document."""
    prints = durable(fingerprints(docs, shingle))
    first = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    groups = components(linked(first.select("fp"), radius))
    group = F.coalesce(F.col("component"), F.col("fp"))
    named = durable(first.join(groups, first.fp == groups.node, "left").select("fp", "first_doc", group.alias("group")))
    smallest = named.groupBy("group").agg(F.min("first_doc").alias("component_id"))
    by_print = named.join(smallest, "group").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def majority(hashes: np.ndarray) -> np.uint64:
    """Bit k is set if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 65_536):
        block = hashes[start : start + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]


def shingle_set(text: str | None, shingle: int = STAGE_SHINGLE) -> np.ndarray:
    """The distinct word shingles' hashes; a text of fewer words is one shingle."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    grams = {b" ".join(words)} if len(words) < shingle else set(map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64))


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hashes under the k-th of several independent hash functions."""
    x = hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def banded(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the bands: of each ``BAND`` successive minima, one a bin; in texts with empty bins, which do not count, of any successive ones."""
    if not len(hashes):
        return np.zeros(1, np.int64)
    least = np.full(BINS, np.iinfo(np.uint64).max)
    x = mixed(hashes, WIDE_PRINTS)
    np.minimum.at(least, (x % np.uint64(BINS)).astype(np.int64), x)
    own = least[least != np.iinfo(np.uint64).max]
    at = np.arange(0, len(own), BAND if len(own) == BINS else 1)
    code = np.zeros(len(at), np.uint64)
    for k in range(BAND):
        code = mixed(code ^ own[(at + k) % len(own)], k)
    return np.unique(code.view(np.int64))


_MARK = ("n", "fp", *(f"w{k}" for k in range(WIDE_PRINTS)))
_SKETCH = "node long, " + ", ".join(f"{c} long" for c in _MARK) + ", bands array<long>"


def sketches(docs: DataFrame) -> DataFrame:
    """``(node, mark, bands)`` for each distinct text; node is its hash, the mark has the number of its shingles and its prints."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames):
            sets = [shingle_set(t) for t in frame["text"]]
            out = {"node": frame["node"], "n": [len(x) for x in sets], "fp": np.array([majority(x) for x in sets], np.uint64).view(np.int64)}
            for k in range(WIDE_PRINTS):
                out[f"w{k}"] = np.array([majority(mixed(x, k)) for x in sets], np.uint64).view(np.int64)
            yield pd.DataFrame(out | {"bands": [banded(x) for x in sets]})

    made = docs.select(F.xxhash64("text").alias("node"), "text").mapInPandas(run, _SKETCH)
    # equal texts have equal sketches, so the short rows are deduplicated instead of the texts
    return made.dropDuplicates(["node"]).select("node", F.struct(*_MARK).alias("mark"), "bands")


def shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, grams)`` of the texts whose hashes are among ``nodes(node)``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames):
            yield pd.DataFrame({"node": frame["node"], "grams": [shingle_set(t).view(np.int64) for t in frame["text"]]})

    texts = sieve(docs.select(F.xxhash64("text").alias("node"), "text"), "node", nodes).join(nodes, "node")
    return texts.groupBy("node").agg(F.first("text").alias("text")).mapInPandas(run, "node long, grams array<long>")


def bits_apart(a: Column, b: Column, prints: tuple[str, ...]) -> Column:
    return reduce(Column.__add__, [F.bit_count(a[p].bitwiseXOR(b[p])) for p in prints])


def likely(a: Column, b: Column) -> Column:
    """False for marks of texts that are not similar: by their sizes, which is exact, or by far too many differing bits."""
    sizes = F.least(a["n"], b["n"]) >= SIMILARITY * F.greatest(a["n"], b["n"]) - 1e-6
    return sizes & (bits_apart(a, b, _MARK[1:2]) <= STAGE_RADIUS) & (bits_apart(a, b, _MARK[2:]) <= WIDE_RADIUS)


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose shingle sets have an exact Jaccard similarity of ``SIMILARITY`` at least."""
    left, right = (sets.select(F.col("node").alias(n), F.col("grams").alias(f"grams_{n}")) for n in "ab")
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("grams_a", "grams_b"))
    return both.filter(common >= SIMILARITY * (F.size("grams_a") + F.size("grams_b") - common) - 1e-6).select("a", "b")


def similar_groups(docs: DataFrame) -> DataFrame:
    """``(node, component)`` of the text hashes that are similar to another text.

    The vantage-point tree first links texts whose prints of five-word shingles differ in ``RADIUS`` bits at most.
    At 0.8 of similarity prints differ in ten bits and more, a ball that overlaps every shard; so the others meet
    in bands of least shingle hashes, in which prints and sizes sort out pairs. Every link is verified on the shingles.
    """
    known = durable(sketches(docs))
    prints = durable(known.groupBy("mark.fp").agg(F.min("node").alias("first")))
    by_print = known.select("node", F.col("mark.fp").alias("of")).join(prints, F.col("of") == F.col("fp")).filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    one, other = (prints.select(F.col("fp").alias(f"fp_{n}"), F.col("first").alias(n)) for n in "ab")
    edges = linked(prints.select("fp")).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))
    close = durable(edges.join(one, "fp_a").join(other, "fp_b").select("a", "b").unionByName(by_print))
    members = band_members(known)
    asked = reduce(DataFrame.unionByName, [members.select("node"), *(close.select(F.col(n).alias("node")) for n in "ab")])
    sets = durable(shingle_sets(docs, durable(asked.distinct())))
    links = durable(similar(close, sets))
    return band_components(members, likely, lambda a, b: -bits_apart(a, b, _MARK[1:]), lambda _: lambda pairs: similar(pairs, sets), links)


def keep_one(docs: DataFrame) -> DataFrame:
    """Pipeline stage: of each group of similar documents one row stays.

    Similar are documents with a Jaccard similarity of five-word shingles of ``SIMILARITY``
    at least (the query of this module has its own contract); empty texts are equal.
    The row with the smallest id stays, null after all others, among rows of one id by the
    hashes of text and row. Rows are grouped by their texts only, so that rows of one id, or
    without one, stay if their texts differ. Columns may have any names.
    """
    groups = similar_groups(docs)
    boxed = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("text").alias("version"), F.xxhash64(*docs.columns).alias("hash"))
    order = F.struct(F.col("row")["doc_id"].isNull().alias("none"), F.col("row")["doc_id"].alias("id"), F.col("version"), F.col("hash"))
    placed = boxed.join(groups, F.col("version") == F.col("node"), "left").select("row", F.coalesce("component", "version").alias("group"), order.alias("order"))
    first = placed.groupBy("group").agg(F.min("order").alias("first")).withColumnRenamed("group", "of")
    stays = placed.join(first, (F.col("group") == F.col("of")) & F.col("order").eqNullSafe(F.col("first")))
    # what is left of a group are exact repeats of one row
    return stays.dropDuplicates(["group"]).select(*[F.col("row")[c].alias(c) for c in docs.columns])
