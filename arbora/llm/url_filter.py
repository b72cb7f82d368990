"""URL filter: rules first, then a ratio of character language models.

Rules allow or block a host with all its subdomains below a path; the longest rule
that fits decides. The URLs that rules accept and reject train one variable-order
Markov model each (characters, contexts of up to ``ORDER - 1``, Witten-Bell
smoothing down to a uniform model). Other URLs are judged by their length-normalised
log-likelihood difference against a threshold calibrated on the ruled URLs.

All counts cover all ruled rows; the model is a table that grows with the input and
is joined, never collected. Only a histogram of ``BINS`` bins a class comes to the driver.

Defined cases: null urls and urls without ``://`` have empty host and path, fit no
rule and are judged by the model on the empty string; if a class has no example, no model
can tell and the verdict is ``allow``; repeated rows get one verdict; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.llm._shared import durable

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ORDER = 5
ALPHABET = 256
BINS = 400
_START, _END = "\u0002", "\u0003"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, own_host, own_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own_host) | F.endswith(host, F.lit("." + own_host))) & F.startswith(path, F.lit(own_path))
        rule, verdict = F.when(fits, F.lit(own_host + own_path)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _grams(s: Column) -> Column:
    """The ORDER-gram that ends at each character of s and at its end mark."""
    padded = F.concat(F.lit(_START * (ORDER - 1)), s, F.lit(_END))
    return F.transform(F.sequence(F.lit(1), F.char_length(s) + 1), lambda i: F.substr(padded, i, F.lit(ORDER)))


def model(trained: DataFrame, judged: DataFrame) -> DataFrame:
    """``(gram, ratio)``: log of P(last | rest) for accepted over rejected URLs, for every gram in ``judged``.

    ``trained(gram, allow, block)`` has the counts; ``judged(gram)`` the grams to be scored.
    """
    tables = {ORDER: durable(judged.join(trained, "gram", "left").na.fill(0, ["allow", "block"]))}
    seen = {ORDER: trained}
    for k in range(ORDER - 1, 0, -1):
        seen[k] = seen[k + 1].groupBy(F.right("gram", F.lit(k)).alias("gram")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        wanted = tables[k + 1].select(F.right("gram", F.lit(k)).alias("gram")).distinct()
        seen[k] = durable(seen[k])
        tables[k] = wanted.join(seen[k], "gram", "left").na.fill(0, ["allow", "block"])
    below = None
    for k in range(1, ORDER + 1):
        context = seen[k].groupBy(F.left("gram", F.lit(k - 1)).alias("context")).agg(
            *[F.sum(c).alias(f"n_{c}") for c in ("allow", "block")],
            *[F.sum((F.col(c) > 0).cast("long")).alias(f"u_{c}") for c in ("allow", "block")],
        )
        own = tables[k].withColumn("context", F.left("gram", F.lit(k - 1))).join(context, "context", "left").na.fill(0)
        if below is None:
            own = own.withColumn("b_allow", F.lit(1.0 / ALPHABET)).withColumn("b_block", F.lit(1.0 / ALPHABET))
        else:
            own = own.withColumn("_lower", F.right("gram", F.lit(k - 1))).join(below, F.col("_lower") == F.col("_gram"))
        p = {c: F.when(F.col(f"n_{c}") > 0, (F.col(c) + F.col(f"u_{c}") * F.col(f"b_{c}")) / (F.col(f"n_{c}") + F.col(f"u_{c}"))).otherwise(F.col(f"b_{c}")) for c in ("allow", "block")}
        below = durable(own.select(F.col("gram").alias("_gram"), p["allow"].alias("b_allow"), p["block"].alias("b_block")))
    return below.select(F.col("_gram").alias("gram"), F.log(F.col("b_allow") / F.col("b_block")).alias("ratio"))


def threshold(scored: DataFrame) -> float:
    """The score from which ruled URLs are better taken for accepted: least sum of the two error rates."""
    ends = scored.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    if ends.lo is None or ends.lo == ends.hi:
        return 0.0
    width = (ends.hi - ends.lo) / BINS
    at = F.least(F.lit(BINS - 1), F.floor((F.col("score") - ends.lo) / width).cast("int"))
    rows = scored.groupBy(at.alias("bin")).agg(F.sum("n_allow").alias("a"), F.sum("n_block").alias("b")).collect()
    a, b = [0] * (BINS + 1), [0] * (BINS + 1)
    for r in rows:
        a[r.bin], b[r.bin] = r.a, r.b
    all_a, all_b = max(1, sum(a)), max(1, sum(b))
    best, cut, under_a, under_b = None, 0, 0, 0
    for k in range(BINS + 1):
        wrong = under_a / all_a + (sum(b) - under_b) / all_b
        # of equal cuts the one nearest to even odds
        if best is None or (wrong, abs(ends.lo + k * width)) < best:
            best, cut = (wrong, abs(ends.lo + k * width)), k
        under_a, under_b = under_a + a[k], under_b + b[k]
    return ends.lo + cut * width


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)``, a row for each page."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("rule", rule).withColumn("_says", verdict).withColumn("_s", F.concat("host", "path"))
    # one row for each different string; the rules see only that string
    urls = durable(
        parsed.groupBy("_s").agg(
            F.sum((F.col("_says") == "allow").cast("long")).alias("n_allow"), F.sum((F.col("_says") == "block").cast("long")).alias("n_block")
        ).na.fill(0, ["n_allow", "n_block"])
    )
    ends = urls.agg(F.sum("n_allow"), F.sum("n_block")).first()
    if not ends[0] or not ends[1]:
        return parsed.select("page_id", "host", "path", "rule", F.coalesce("_says", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    spread = urls.select("_s", "n_allow", "n_block", F.explode(_grams(F.col("_s"))).alias("gram"))
    counts = durable(spread.groupBy("gram").agg(F.sum("n_allow").alias("allow"), F.sum("n_block").alias("block")))
    ratios = model(counts.filter("allow > 0 OR block > 0"), counts.select("gram"))
    summed = spread.select("_s", "gram").join(ratios, "gram").groupBy("_s").agg(F.avg("ratio").alias("score"))
    scored = durable(urls.join(summed, "_s").select(F.col("_s").alias("_u"), "n_allow", "n_block", F.round("score", 12).alias("score")))
    cut = threshold(scored.filter("n_allow > 0 OR n_block > 0"))
    says = F.when(F.col("score") >= cut, F.lit("allow")).otherwise(F.lit("block"))
    return parsed.join(scored.select("_u", "score"), F.col("_s") == F.col("_u")).select("page_id", "host", "path", "rule", F.coalesce("_says", says).alias("verdict"), "score")
