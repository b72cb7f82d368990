"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

Texts are sequences of lower-cased words (letters and digits; single characters of scripts without blanks). Fixed masks select
some of successive words and ignore the others, so that a seed survives
substitutions at ignored places. Seeds of all benchmark items are joined with those
of all training documents by hash. A hit names a diagonal (document position minus
item position); along it the whole item is aligned with the document. A document is
contaminated by an item if of ``WINDOW`` successive words of the item ``MIN_SCORE`` are
equal, for shorter items ``SHORT`` of their words. The masks hit every such
alignment, wherever its substitutions are (a test goes through all). So it is, too,
if its best segment, a match counting 1 and a substitution ``-PENALTY``, scores as much; ``score``
is that of this segment.

Seed table and hit join: the seeds are broadcast only if their number is within
``BROADCAST_ROWS``, else joined by shuffle. Texts are verified whole.

Defined cases: documents without a doc_id are searched and reported like others; null, empty and blank texts have no words; items of fewer words than
the longest mask spans are searched as they are, without substitutions, those of fewer
than ``MIN_WORDS`` words not at all; repeated items and documents are reported
once for each pair of ids; empty tables give an empty report; other columns are kept
by the stage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.llm._shared import durable, table

#: 1: the word counts, 0: it is ignored.
MASKS = ("11101", "100111")
PENALTY = 2
MIN_SCORE = 12
WINDOW = 15
MIN_WORDS = 3
SHORT = 0.8
BROADCAST_ROWS = 200_000


#: Scripts that put no blanks between words: each of their characters counts as a word.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]"


def words(text: Column) -> Column:
    spaced = F.when(text.rlike(UNSPACED), F.regexp_replace(text, "(" + UNSPACED + ")", " $1 ")).otherwise(text)
    return F.filter(F.split(F.lower(spaced), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def seeds(w: Column, mask: str) -> Column:
    """The mask's hash at every position where it fits."""
    offsets = [k for k, c in enumerate(mask) if c == "1"]
    fits = F.when(F.size(w) >= len(mask), F.sequence(F.lit(0), F.size(w) - len(mask))).otherwise(F.array().cast("array<int>"))
    return F.transform(fits, lambda i: F.xxhash64(F.lit(mask), *[F.get(w, i + k) for k in offsets]))


def _seed_rows(tokens: DataFrame, masks: tuple[str, ...], *keep: str) -> DataFrame:
    """``(keep..., pos, seed)`` for all masks; seeds of different masks differ by their hash."""
    each = F.array(*[seeds(F.col("w"), m) for m in masks])
    # outer: a plain explode would have the optimizer filter by the arrays' sizes, and compute them twice for that
    masks = tokens.select(*keep, each.alias("each")).select(*keep, F.explode_outer("each").alias("one"))
    return masks.select(*keep, F.posexplode_outer("one").alias("pos", "seed")).filter("seed IS NOT NULL")


def matches(doc: Column, item: Column, diagonal: Column) -> Column:
    """1 for each word of the item that is equal to the aligned one, else 0."""
    return F.transform(item, lambda w, k: F.when((k + diagonal >= 0) & (F.get(doc, k + diagonal) == w), F.lit(1)).otherwise(F.lit(0)))


def _best_run(gain: Column, floor: int | None) -> Column:
    """The largest running sum; with a floor, the sum starts anew when it falls below."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, g: Column) -> Column:
        run = acc["run"] + g if floor is None else F.greatest(F.lit(floor), acc["run"] + g)
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(gain, start, step, lambda acc: acc["best"])


def best_segment(equal: Column) -> Column:
    """Best score of a run of aligned words: +1 a match, -PENALTY a substitution."""
    return _best_run(F.transform(equal, lambda x: F.when(x == 1, F.lit(1)).otherwise(F.lit(-PENALTY))), 0)


def best_window(equal: Column) -> Column:
    """Most matches among ``WINDOW`` successive words, or among all of a shorter item."""
    return _best_run(F.transform(equal, lambda x, k: x - F.coalesce(F.get(equal, k - WINDOW), F.lit(0))), None)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, version, item_id, score, n_words)``: verified overlaps, the best of each document and item."""
    texts = docs.filter("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("version"), "text")
    items = benchmark.filter("text IS NOT NULL").select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") >= MIN_WORDS)
    short = F.size("w") < max(map(len, MASKS))
    sizes = sorted(r.n for r in items.filter(short).select(F.size("w").alias("n")).distinct().collect())
    whole = tuple("1" * n for n in sizes)
    parts = [_seed_rows(items.filter(~short), MASKS, "item_id"), *(_seed_rows(items.filter(F.size("w") == len(m)), (m,), "item_id") for m in whole)]
    own = durable(reduce(DataFrame.unionByName, parts).select("item_id", F.col("pos").alias("item_pos"), "seed").distinct())
    if own.count() <= BROADCAST_ROWS:
        own = F.broadcast(own)
    tokens = texts.select("doc_id", "version", words(F.col("text")).alias("w"))
    found = _seed_rows(tokens, MASKS + whole, "doc_id", "version").join(own, "seed")
    hits = durable(found.select("doc_id", "version", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct())
    named = hits.withColumnsRenamed({"doc_id": "_doc", "version": "_version"})
    hit_docs = texts.join(hits.select(F.col("doc_id").alias("_doc"), F.col("version").alias("_version")).distinct(), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("version") == F.col("_version")), "left_semi")
    tokened = hit_docs.groupBy("doc_id", "version").agg(F.first("text").alias("text")).select("doc_id", "version", words(F.col("text")).alias("w"))
    asked = items.select(F.col("item_id").alias("_item"), F.col("w").alias("v")).distinct()
    # items first, where only numbers travel; then the words of the document
    pairs = named.join(asked, F.col("item_id") == F.col("_item"))
    both = pairs.join(tokened, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("version") == F.col("_version")))
    aligned = both.select("doc_id", "version", "item_id", F.size("v").alias("n_words"), matches(F.col("w"), F.col("v"), F.col("diagonal")).alias("equal"))
    scored = aligned.select("doc_id", "version", "item_id", "n_words", best_segment(F.col("equal")).alias("score"), best_window(F.col("equal")).alias("matched"))
    share = F.when(F.col("n_words") < max(map(len, MASKS)), F.col("n_words").cast("double")).otherwise(F.ceil(F.col("n_words") * SHORT).cast("double"))
    enough = F.least(F.lit(float(MIN_SCORE)), share)
    return scored.filter(F.greatest("score", "matched") >= enough).groupBy("doc_id", "version", "item_id").agg(F.max("score").alias("score"), F.max("n_words").alias("n_words"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, score, n_words)``, a row for each contaminated document and item."""
    return overlaps(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("n_words").alias("n_words"))


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that overlap a benchmark item go; columns may have any names."""
    bad = overlaps(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("bad"), F.col("version").alias("of")).distinct()
    boxed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("text").alias("version"))
    kept = boxed.join(bad, F.col("doc_id").eqNullSafe(F.col("bad")) & (F.col("version") == F.col("of")), "left_anti")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
