"""Mixing sources to target weights by the cube method.

Every document is expected to enter the mix ``target / source size`` times, at most
twice. The whole part is taken for certain; the fraction is an inclusion probability
that the cube method turns into 0 or 1: a flight moves the probabilities of a few
documents at a time within the null space of the balancing constraints (number of
documents and number of words), until each is fixed; only a small landing problem
remains, at most sixteen documents a source, which is settled by enumeration. Flights run
over salted buckets of a source, larger documents first, and again over what
the buckets leave open, until that fits one bucket a source; so neither a source nor its remainder meets one task.

Targets: sources by code point, null last, weigh 5, 2, 1 repeating and share
``share`` (150 %) of all words; a target stops at twice its source's size and the
excess is reshared by weight until none is above.

Defined cases: null and empty texts have size 0, are taken 0 words; repeated rows
count each on their own; all draws are seeded by the row, so reruns agree; an empty
table gives an empty result; other columns are ignored by the report and kept by the
pipeline stage, those named like one of its own under their name with ``_in`` added.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm._shared import durable

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Fractional documents of one flight.
BUCKET = 20_000
#: Fractional documents, spread over the sizes, that are kept for the landing.
RESERVE = 14
#: Times the mean size above which a document is settled before the others.
LARGE = 5
_EPS = 1e-9


def sizes(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size, version, uid)``; repeated rows get different uids."""
    n_words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    plain = docs.select("doc_id", "source", n_words.alias("size"), F.xxhash64("text").alias("version"))
    same = Window.partitionBy("doc_id", "version", "source", "size").orderBy("doc_id")
    return plain.withColumn("_n", F.row_number().over(same)).select("doc_id", "source", "size", "version", F.xxhash64("doc_id", "version", "source", "_n").alias("uid"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``(source, source_size, target)``; one row a source, null included.

    A source is at its limit if the water level (target per weight) reaches
    ``most * size / weight``; sorted by that ratio, the level follows from running
    sums of whole numbers.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    ratio = F.col("source_size") * most / F.col("w")
    by_ratio = every.orderBy("ratio", F.col("source").isNull(), F.encode("source", "utf-8"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    weighed = per.withColumn("w", weight).withColumn("ratio", ratio)
    summed = (
        weighed.withColumn("total", F.sum("source_size").over(every))
        .withColumn("full", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most)
        .withColumn("open", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("level", (F.col("total") * share - F.col("full")) / F.col("open"))
    )
    # the first source whose own limit lies above the level it would get sets the level
    final = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(every)["level"]
    target = F.coalesce(F.least(final * F.col("w"), F.col("source_size") * float(most)), F.col("source_size") * float(most))
    return summed.select("source", "source_size", target.cast("double").alias("target"))


def fly(p: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """One flight over the units in order; at most two probabilities stay fractional."""
    p = p.copy()
    rng = np.random.default_rng(seed)
    draws = rng.random(len(p) + 1)
    held: list[int] = []
    for i in range(len(p)):
        if not _EPS < p[i] < 1 - _EPS:
            p[i] = round(p[i])
            continue
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        # null space of the rows (1, 1, 1) and (size): the cross product
        u = (float(size[c] - size[b]), float(size[a] - size[c]), float(size[b] - size[a]))
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(held, u, strict=True) if x)
        down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(held, u, strict=True) if x)
        step = up if draws[i] * (up + down) < down else -down
        for k, x in zip(held, u, strict=True):
            p[k] = min(1.0, max(0.0, p[k] + step * x))
            if p[k] <= _EPS or p[k] >= 1 - _EPS:
                p[k] = round(p[k])
        held = [k for k in held if 0 < p[k] < 1]
    return p


def settle_large(p: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Fix documents far above the mean size first, each balanced by all others at once.

    A few small documents could not make up for a large one at the landing; so its
    steps run in the null space over the whole bucket, the others moving in proportion
    to their room p (1 - p).
    """
    p, rng = p.copy(), np.random.default_rng(seed)
    large = np.flatnonzero(size > LARGE * size.mean())
    for k in large[np.argsort(-size[large], kind="stable")]:
        for _ in range(32):
            free = (p > _EPS) & (p < 1 - _EPS)
            if not free[k] or free.sum() < 4:
                break
            room = np.where(free, p * (1 - p), 0.0)
            room[k] = 0.0
            s = size / size.max()
            normal = np.array([[room.sum(), room @ s], [room @ s, room @ (s * s)]])
            weights = np.linalg.lstsq(normal, np.array([1.0, s[k]]), rcond=None)[0]
            u = -room * (weights[0] + weights[1] * s)
            u[k] = 1.0
            with np.errstate(divide="ignore", invalid="ignore"):
                up = np.where(u > 0, (1 - p) / u, np.where(u < 0, p / -u, np.inf)).min()
                down = np.where(u > 0, p / u, np.where(u < 0, (1 - p) / -u, np.inf)).min()
            p = np.clip(p + (up if rng.random() * (up + down) < down else -down) * u, 0, 1)
            p = np.where((p <= _EPS) | (p >= 1 - _EPS), np.round(p), p)
    return p


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The rounding of the last fractions whose words and documents come nearest to those expected."""
    left = np.flatnonzero((p > 0) & (p < 1))
    if not len(left):
        return p
    choices = (np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1).astype(np.float64)
    words = np.abs(choices @ size[left].astype(float) - p[left] @ size[left])
    count = np.abs(choices.sum(axis=1) - p[left].sum())
    out = p.copy()
    out[left] = choices[np.argmin(words / max(1.0, float(size[left].mean())) + 0.1 * count)]
    return out


def _flight(frame: pd.DataFrame, last: bool) -> pd.DataFrame:
    """Fly all but ``RESERVE`` units spread over the sizes, which the landing needs; land if it is the last."""
    frame = frame.sort_values(["size", "uid"], ascending=[False, True], kind="stable").reset_index(drop=True)
    size, p = frame["size"].to_numpy(np.int64), frame["p"].to_numpy(float).copy()
    seed = int(frame["uid"].iloc[0]) & (2**63 - 1)
    p = settle_large(p, size, seed)
    spare = np.zeros(len(p), bool)
    spare[np.unique(np.linspace(0, len(p) - 1, RESERVE).astype(int))] = True
    p[~spare] = fly(p[~spare], size[~spare], seed)
    return pd.DataFrame({"uid": frame["uid"], "source": frame["source"], "size": size, "p": land(p, size) if last else p})


_UNITS = "uid long, source string, size long, p double"


def choose(units: DataFrame) -> DataFrame:
    """``(uid, extra)``: 0 or 1 for each fractional unit ``(uid, source, size, p)``."""
    settled = []
    for turn in count():
        per = durable(units.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / BUCKET).cast("int").alias("buckets")))
        if per.filter("buckets > 1").isEmpty():
            break
        salt = F.pmod(F.xxhash64("uid", F.lit("bucket"), F.lit(turn)), F.col("buckets"))
        salted = units.alias("u").join(per.alias("s"), F.col("u.source").eqNullSafe(F.col("s.source"))).select("u.*", salt.alias("bucket"))
        # a bucket leaves a few units open
        flown = durable(salted.groupBy("source", "bucket").applyInPandas(lambda f: _flight(f, False), _UNITS))
        settled.append(flown.filter("p = 0 OR p = 1"))
        units = flown.filter("p > 0 AND p < 1")
    landed = units.groupBy("source").applyInPandas(lambda f: _flight(f, True), _UNITS)
    return reduce(DataFrame.unionByName, [*settled, landed]).select("uid", F.col("p").cast("long").alias("extra"))


def mix(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, times)``, a row for each document."""
    return drawn(docs).select("doc_id", "size", "source_size", "target", "taken", "times")


def drawn(docs: DataFrame) -> DataFrame:
    """The mix with ``uid`` for each row and ``version`` for its text."""
    sized = durable(sizes(docs))
    goal = durable(targets(sized))
    joined = sized.alias("d").join(goal.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = joined.select("doc_id", "d.source", "size", "version", "uid", "source_size", "target", rate.alias("rate")).withColumn("whole", F.floor("rate"))
    open_ = rated.filter("rate > whole AND size > 0").select("uid", "source", "size", (F.col("rate") - F.col("whole")).alias("p"))
    extra = choose(open_).withColumnRenamed("uid", "_uid")
    times = F.col("whole") + F.coalesce("extra", F.lit(0))
    return rated.join(extra, F.col("uid") == F.col("_uid"), "left").select(
        "doc_id", "source", "version", "uid", "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"), times.cast("int").alias("times")
    )


def take(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the mix takes, with ``size``, ``source_size``, ``target``, ``taken`` and ``times``.

    A document taken twice is one row with ``times`` 2; documents taken no time go.
    Equal rows (doc_id, source, text) share what they are taken together as evenly as whole numbers allow,
    the first one most.
    """
    own = ["size", "source_size", "target", "taken", "times"]
    plan = drawn(docs)
    order = Window.partitionBy("doc_id", "version", "source").orderBy(F.col("times").desc())
    ranked = plan.withColumn("n", F.row_number().over(order)).select(F.col("doc_id").alias("doc"), F.col("version").alias("of"), F.col("source").alias("from"), "n", *own)
    boxed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("text").alias("version"), "source")
    numbered = boxed.withColumn("m", F.row_number().over(Window.partitionBy("doc_id", "version", "source").orderBy(F.lit(0))))
    matched = numbered.join(ranked, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("version") == F.col("of")) & F.col("source").eqNullSafe(F.col("from")) & (F.col("m") == F.col("n")))
    names = [*own]
    for c in docs.columns:
        name = c
        while name in names or name != c and name in docs.columns:
            name += "_in"
        names.append(name)
    kept = [F.col("row")[c].alias(n) for c, n in zip(docs.columns, names[len(own) :], strict=True)]
    return matched.filter("times > 0").select(*kept, *own)
