"""Fuzzy line deduplication by MinHash, in DataFrame operations only.

Lines (trimmed, lower-cased for comparison; blank lines do not take part and always
stay) are sketched by one-permutation MinHash over the same character shingles that are
compared in the end: each of ``BINS`` bins keeps its least hash, and ``BAND``
successive minima form a band, beginning at every other bin; in lines with several empty bins, which do not count, at every one. Lines that agree
in a band, and in ``AGREE`` of their bins, are candidates. Of independent minima at similarity 0.8, 97.4 % of
all pairs meet in a band, at 0.85 99.3 %; shorter bands would meet more, but also lines that have little in common, as the square of their number. Long lines are sketched on those shingles whose hashes are small,
which hold nearly all minima, so the work a line is bounded and lines of any length meet.
A candidate pair is linked if the exact Jaccard similarity of
*all* character shingles of length ``SHINGLE`` is at least ``SIMILARITY``. Connected
lines form a component, of which the first line (by doc_id, then line number) stays.

The candidates of bands of up to 64 lines are found as the bands are dealt; of these pairs the
likeliest of each line is verified first, then those that still lie apart. Texts are read once, for lines that have a candidate.
Within a larger band every line is first verified against a typical line of the band, beginning with
the band where this one agrees best; what this
links is merged. Then every pair of lines of one band that still lie in different
components is met: the lines outside the band's largest component on one side, all of them
on the other, so that a band of thousands of near-copies costs a check or two a line,
and no candidate that could merge components is skipped. Where pairs outnumber their lines, parities of the lines'
shingles first rule out most pairs that cannot reach the similarity, and none that can.

Defined cases: null and empty texts have no lines; repeated rows (equal doc_id and
text) get the same decision; rows without a doc_id count after all others; lines shorter than a shingle are one shingle; an
empty table gives an empty result; the stage keeps other columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.llm._shared import apart, band_components, components, durable, likely_pairs, sieve

SHINGLE = 5
SIMILARITY = 0.8
BINS = 20
BAND = 4
#: Shingles that a long line's sketch takes at least, if so many are distinct.
SAMPLED = 64
#: Share of their bins in which two lines agree at least to be compared (0.8 is expected at the least similarity, with 20 bins
#: one such pair in 400 is below), and bins from which on this is asked.
AGREE = 0.55
JUDGED = 12
#: Words of 64 bits of a line's parities, and pairs a line from which on these are worth making.
PARITIES = 16
CROWD = 2
_WORDS = tuple(f"w{w}" for w in range((BINS + 6) // 7))
_BLANKS = " \t\r\x0b\x0c"


def lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, version, pos, line, h1, h2)`` of all lines that are not blank."""
    split = docs.filter("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("version"), F.posexplode_outer(F.split(F.lower("text"), "\n")).alias("pos", "raw"))
    # trimming by a set walks through the whole line, so it is left to lines with a blank at an end
    edges = reduce(Column.__or__, [F.startswith("raw", F.lit(c)) | F.endswith("raw", F.lit(c)) for c in _BLANKS])
    line = F.when(edges, F.btrim("raw", F.lit(_BLANKS))).otherwise(F.col("raw"))
    normal = split.select("doc_id", "version", "pos", line.alias("line")).filter("line <> ''")
    return normal.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64("line", F.lit("second")))


def minima(all_lines: DataFrame) -> DataFrame:
    """``(h1, m0, m1, ...)``: the least hash in each bin, null where there is none."""
    # a line of few different words has few different shingles, however long it is
    distinct = F.least(F.char_length("line"), 8 * F.size(F.array_distinct(F.split("line", " "))))
    level = F.when(F.char_length("line") < 2 * SAMPLED, 0).otherwise(F.greatest(F.lit(0), F.floor(F.log2(distinct / SAMPLED)))).cast("int")
    # four bytes a character, so that a shingle is found by its place
    wide = all_lines.select("h1", F.encode("line", "UTF-32").alias("wide"), level.alias("level"))
    every = F.sequence(F.lit(1), F.greatest(F.length("wide") - (4 * SHINGLE - 1), F.lit(1)), F.lit(4))
    each = wide.select("h1", "wide", F.expr(f"shiftright({2**63 - 1}L, level)").alias("top"), F.explode_outer(every).alias("at"))
    hashed = each.select("h1", "top", F.shiftrightunsigned(F.xxhash64(F.substring("wide", F.col("at"), F.lit(4 * SHINGLE))), 1).alias("g"))
    small = hashed.filter("g <= top").select("h1", "g", (F.col("g") % BINS).cast("int").alias("bin"))
    # a minimum of values that are never null costs less
    none = F.lit(2**63 - 1)
    least = small.groupBy("h1").agg(*[F.min(F.when(F.col("bin") == k, F.col("g")).otherwise(none)).alias(f"m{k}") for k in range(BINS)])
    return least.select("h1", *[F.nullif(F.col(f"m{k}"), none).alias(f"m{k}") for k in range(BINS)])


def sketched(all_lines: DataFrame) -> DataFrame:
    """``(h1, mark, bands)`` for each line: seven bits a bin (zero: empty), and the hashes of its bands."""
    least = [F.col(f"m{k}") for k in range(BINS)]
    bits = lambda m: F.coalesce(F.pmod(F.shiftright(m, 24), F.lit(127)) + 1, F.lit(0)).cast("long")
    words = [reduce(Column.bitwiseOR, [F.shiftleft(bits(m), 8 * k) for k, m in enumerate(least[w : w + 7])]) for w in range(0, BINS, 7)]
    rows = minima(all_lines).select("h1", F.struct(*[x.alias(f"w{w}") for w, x in enumerate(words)]).alias("mark"), *least)
    hashed = lambda at: F.when(reduce(Column.__and__, [x.isNotNull() for x in at]), F.xxhash64(*at))  # noqa: E731  a band that holds an empty bin is none
    every = F.array(*[hashed([least[(i + j) % BINS] for j in range(BAND)]) for i in range(0, BINS, 2)])
    held = F.array_compact(F.array(*least))
    packed = F.transform(F.sequence(F.lit(0), F.size(held) - 1), lambda i: hashed([F.get(held, F.pmod(i + j, F.size(held))) for j in range(BAND)]))
    count = reduce(Column.__add__, [x.isNotNull().cast("int") for x in least])
    bands = F.when(count < BINS - BAND, packed).otherwise(every)
    return rows.select("h1", "mark", F.array_compact(F.array_distinct(bands)).alias("bands"))


def _zeros(x: Column) -> Column:
    """How many of the seven lower bytes, none above 127, are zero."""
    high = F.lit(0x80808080808080)
    return F.bit_count((high - x).bitwiseAND(high))


def likeness(a: Column, b: Column) -> Column:
    """Number of bins in which two marks are equal, among all places of their words."""
    return reduce(Column.__add__, [_zeros(a[w].bitwiseXOR(b[w])) for w in _WORDS])


def agree(a: Column, b: Column) -> Column:
    """Whether two marks agree in enough of the bins that hold a shingle of either; few bins are not judged."""
    none = reduce(Column.__add__, [_zeros(a[w].bitwiseOR(b[w])) for w in _WORDS])
    held = 7 * len(_WORDS) - none
    return (likeness(a, b) - none >= F.lit(AGREE) * held) | (held < JUDGED)


def shingles(line: Column) -> Column:
    """The set of the line's character shingles, hashed to 64 bits; a line shorter than one is one."""
    # the struct keeps the bytes from being encoded anew for each shingle
    wide = F.struct(F.encode(line, "UTF-32").alias("bytes"))
    every = lambda w: F.sequence(F.lit(1), F.greatest(F.length(w["bytes"]) - (4 * SHINGLE - 1), F.lit(1)), F.lit(4))
    cut = lambda w: F.transform(every(w), lambda i: F.xxhash64(F.substring(w["bytes"], i, F.lit(4 * SHINGLE))))
    return F.array_distinct(F.get(F.transform(F.array(wide), cut), 0))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of line hashes whose lines are similar enough."""
    left = texts.select(F.col("h1").alias("a"), F.col("line").alias("line_a"))
    right = texts.select(F.col("h1").alias("b"), F.col("line").alias("line_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", shingles(F.col("line_a")).alias("s"), shingles(F.col("line_b")).alias("t"))
    common = F.size(F.array_intersect("s", "t"))
    return both.filter(common >= SIMILARITY * (F.size("s") + F.size("t") - common)).select("a", "b")


def parities(texts: DataFrame) -> DataFrame:
    """``(h1, n, p0, p1, ...)``: how many shingles a line has, and for each of 64 times ``PARITIES`` places whether an odd number of them fall there."""
    each = texts.select("h1", F.explode(shingles(F.col("line"))).alias("g"))
    word, bit = F.pmod(F.shiftright("g", 32), F.lit(PARITIES)), F.expr("shiftleft(1L, cast(g & 63 as int))")
    return each.groupBy("h1").agg(F.count(F.lit(1)).alias("n"), *[F.bit_xor(F.when(word == k, bit)).alias(f"p{k}") for k in range(PARITIES)])


def signs(texts: DataFrame) -> DataFrame:
    """``(node, sign)``: a line's number of shingles and its parities in one column."""
    own = durable(parities(texts))
    return own.select(F.col("h1").alias("node"), F.struct("n", *[F.coalesce(f"p{k}", F.lit(0).cast("long")).alias(f"p{k}") for k in range(PARITIES)]).alias("sign"))


def may_agree(x: Column, y: Column) -> Column:
    """Whether the signs of two lines leave it open that they are similar enough; true for all that are.

    Places where two lines' parities differ are at most as many as the shingles that only one of them has, and of these
    similar lines have at most (1 - s) / (1 + s) of the sum of both numbers.
    """
    differ = reduce(Column.__add__, [F.bit_count(x[f"p{k}"].bitwiseXOR(y[f"p{k}"])) for k in range(PARITIES)])
    most = (1 - SIMILARITY) / (1 + SIMILARITY) * (x["n"] + y["n"]) + 1e-6
    return (F.abs(x["n"] - y["n"]) <= most) & (differ <= most)


def close(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs without most of those that are not similar enough; none that is gets lost."""
    own = signs(texts)
    of = lambda n: own.select(F.col("node").alias(n), F.col("sign").alias(f"of_{n}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").filter(may_agree(F.col("of_a"), F.col("of_b"))).select("a", "b")


def read_again(all_lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(h1, line)`` of the lines whose hashes are ``nodes(h1)``."""
    # an inner join: a semi join would be moved below the sieve
    return durable(sieve(all_lines.select("h1", "line"), "h1", nodes).join(nodes, "h1").groupBy("h1").agg(F.first("line").alias("line")))


def checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that are similar enough; where they outnumber their lines, parities rule out most others first."""
    nodes = durable(pairs.select(F.explode(F.array("a", "b")).alias("h1")).distinct())
    if pairs.count() > CROWD * nodes.count():
        return verified(durable(close(pairs, texts.join(nodes, "h1"))), texts)
    return verified(pairs, texts)


def signer(texts: DataFrame, nodes: DataFrame) -> tuple[DataFrame, Callable[[Column, Column], Column], Callable[[DataFrame], DataFrame]]:
    """The signs of the lines ``nodes(node)``, what two of them tell, and what verifies pairs of these lines."""
    return signs(texts.join(nodes.withColumnRenamed("node", "h1"), "h1")), may_agree, lambda some: verified(some, texts)


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that connect what all similar ones of ``pairs(a, b, like)`` do: the likeliest of each line, then those that lie apart still."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "like"))
    likeliest = both.groupBy("a").agg(F.max(F.struct("like", "b")).alias("of")).select(F.least("a", "of.b").alias("a"), F.greatest("a", "of.b").alias("b"))
    best = durable(likeliest.distinct())
    links = durable(verified(best, texts))
    rest = durable(apart(pairs.select("a", "b").join(best, ["a", "b"], "left_anti"), components(links)))
    return links if rest.isEmpty() else durable(links.unionByName(checked(rest, texts)))


def groups(all_lines: DataFrame, own: DataFrame) -> DataFrame:
    """``(node, component)`` over the hashes of lines that are linked with another line; ``own`` are the sketches."""
    pairs, crowded = likely_pairs(own.select(F.col("h1").alias("node"), "mark", "bands"), agree, likeness)
    del own
    asked = pairs.select(F.explode(F.array("a", "b")).alias("h1")).unionByName(crowded.select(F.col("node").alias("h1")))
    texts = read_again(all_lines, durable(asked.distinct()))
    links = linked(pairs, texts)
    return band_components(crowded, agree, likeness, lambda _: lambda some: checked(some, texts), links, signer=lambda nodes: signer(texts, nodes))


def decide(docs: DataFrame) -> DataFrame:
    """``(doc_id, version, pos, first_doc, first_pos)`` of the lines that go; ``first_*`` names the line that stays."""
    texts = lines(docs)
    merged = groups(texts, durable(sketched(texts)))
    # after the search, whose files need not lie beside these rows
    own = durable(texts.select("doc_id", "version", "pos", "h1", "h2"))
    where = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("version"), F.col("pos"))
    seen = own.groupBy("h1", "h2").agg(F.min(where).alias("at"), F.count(F.lit(1)).alias("n"))
    joined = seen.join(merged, F.col("h1") == F.col("node"), "left")
    # lines that are alone need no decision
    known = durable(joined.filter("n > 1 OR component IS NOT NULL").select("h1", "h2", "at", F.when(F.col("component").isNotNull(), F.struct("component", F.lit(0).cast("long").alias("x"))).otherwise(F.struct(F.col("h1").alias("component"), F.col("h2").alias("x"))).alias("group")))
    first = known.groupBy("group").agg(F.min("at").alias("stays"))
    stays = durable(known.join(first, "group").select("h1", "h2", "stays"))
    return (
        sieve(own, "h1", stays.select("h1"))
        .join(stays, ["h1", "h2"])
        .filter(~where.eqNullSafe(F.col("stays")))
        .select("doc_id", "version", "pos", F.col("stays.doc_id").alias("first_doc"), F.col("stays.pos").alias("first_pos"))
    )


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, kept_doc_id, kept_line_no)``: every line that goes and the line that stays for it; numbers start at 0."""
    return decide(docs).select("doc_id", F.col("pos").alias("line_no"), F.col("first_doc").alias("kept_doc_id"), F.col("first_pos").alias("kept_line_no")).distinct()


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the documents without the lines that go; a document that keeps no line stays with an empty text."""
    gone = decide(docs).groupBy(F.col("doc_id").alias("doc"), F.col("version").alias("of")).agg(F.collect_set("pos").alias("gone"))
    boxed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("text").alias("version"))
    joined = boxed.join(gone, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("version") == F.col("of")), "left")
    split = F.split(F.col("row")["text"], "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("gone"))
    # the array keeps the text from being split anew for each line
    kept = F.get(F.transform(F.array(F.struct(split.alias("lines"))), lambda x: F.array_join(F.transform(stay, lambda i: F.get(x["lines"], i)), "\n")), 0)
    out = {"text": kept}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.char_length(kept).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[F.when(F.col("gone").isNull(), F.col("row")[n]).otherwise(out[n]).alias(n) if n in out else F.col("row")[n].alias(n) for n in docs.columns])
