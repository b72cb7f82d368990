"""Secret scan with a trigram index, in DataFrame operations only.

From each rule's regular expression a Boolean query over trigrams is derived: an OR
of ANDs that every match has to satisfy. The index holds, for the trigrams of all
queries, the lower-cased documents in which they occur; postings are intersected per
clause, and only the documents that satisfy a clause are verified with the rule's
expression. A rule without mandatory trigrams scans every text.

Spans are code points, end exclusive, leftmost and non-overlapping per kind; a kind
whose match is too short is dropped after matching, as its rule says.

Defined cases: null texts count as empty; empty texts have no span and the digest
of the empty string; repeated rows are scanned alike; an empty table gives an empty
result; other columns are ignored; texts of any length are scanned whole.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.llm._shared import durable


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    any_case: bool = False
    #: Least length of ``group``; shorter matches are dropped.
    group: int = 0
    least: int = 0

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + self.pattern


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    # maximal runs: the length can be asked for while matching
    Rule("hex", r"[0-9a-f]{32,}", least=32),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE + MORE
#: Strings that an expression may stand for before its exact set is given up.
_MOST = 24

Query = frozenset[frozenset[str]]
_ANY: Query = frozenset({frozenset()})


def _grams(s: str) -> frozenset[str]:
    return frozenset(s[k : k + 3] for k in range(len(s) - 2))


def _of_strings(strings: set[str]) -> Query:
    clauses = {_grams(s) for s in strings}
    # a clause that holds another one's trigrams and more adds nothing
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _both(a: Query, b: Query) -> Query:
    if a == _ANY or b == _ANY:
        return b if a == _ANY else a
    if len(a) * len(b) > _MOST:
        return min(a, b, key=len)
    return frozenset(x | y for x in a for y in b)


def trigram_query(pattern: str) -> Query:
    """OR of ANDs of lower-case trigrams that the lower-cased text of every match contains."""

    def walk(nodes) -> tuple[set[str] | None, Query]:
        """Exact strings of the sequence, or None and a query for it."""
        query, run = _ANY, {""}
        for op, arg in nodes:
            exact, own = node(op, arg)
            if exact is not None and len(run) * len(exact) <= _MOST:
                run = {a + b for a in run for b in exact}
            elif exact is not None:
                query, run, all_exact[-1] = _both(query, _of_strings(run)), exact, False
            else:
                query, run, all_exact[-1] = _both(_both(query, _of_strings(run)), own), {""}, False
        return (run, _of_strings(run)) if all_exact[-1] else (None, _both(query, _of_strings(run)))

    all_exact: list[bool] = []

    def sequence(nodes) -> tuple[set[str] | None, Query]:
        all_exact.append(True)
        try:
            return walk(nodes)
        finally:
            all_exact.pop()

    def node(op, arg) -> tuple[set[str] | None, Query]:
        if op is sre.LITERAL:
            return {chr(arg).lower()}, _ANY
        if op is sre.IN:
            chars: set[str] = set()
            for kind, value in arg:
                if kind is sre.LITERAL:
                    chars.add(chr(value).lower())
                elif kind is sre.RANGE and value[1] - value[0] < _MOST:
                    chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    return None, _ANY
            return (chars, _ANY) if len(chars) <= 8 else (None, _ANY)
        if op is sre.SUBPATTERN:
            return sequence(arg[3])
        if op is sre.BRANCH:
            parts = [sequence(p) for p in arg[1]]
            if all(e is not None for e, _ in parts) and sum(len(e) for e, _ in parts) <= _MOST:
                return set().union(*[e for e, _ in parts]), _ANY
            queries = [_of_strings(e) if e is not None else q for e, q in parts]
            return None, _ANY if _ANY in queries else frozenset().union(*queries)
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            exact, own = sequence(body)
            if exact is not None and high <= 1:
                return exact | ({""} if low == 0 else set()), _ANY
            if low == 0:
                return None, _ANY
            return None, _of_strings(exact) if exact is not None else own
        return None, _ANY

    # the common prefix of a branch is factored out by the parser; walking handles it
    exact, query = sequence(parser.parse(pattern))
    query = _of_strings(exact) if exact is not None else query
    return _ANY if frozenset() in query else query


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, rank, end, kind>> of one rule's matches."""
    rank = [r.kind for r in RULES].index(rule.kind)
    found = F.regexp_extract_all(text, F.lit(rule.java), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(rule.java), F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, rule.java, -1)
    both = F.arrays_zip(found.alias("m"), sized.alias("g"), F.slice(gaps, 1, F.greatest(F.lit(1), F.size(found))).alias("gap"))
    empty = F.array().cast("array<struct<start:long,rank:int,end:long,kind:string>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.char_length(x["gap"])
        end = begin + F.char_length(x["m"])
        one = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        out = F.when(F.char_length(x["g"]) >= rule.least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(both, start, step, lambda acc: acc["out"])).otherwise(empty)


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """``(trigram, doc_id, version)``: the index, for the trigrams that queries ask for."""
    low = texts.select("doc_id", "version", F.lower("text").alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("doc_id", "version", F.explode_outer(present).alias("trigram")).filter("trigram IS NOT NULL")


def candidates(texts: DataFrame) -> DataFrame:
    """``(doc_id, version, kinds)``: the indexed rules whose query a document satisfies."""
    rows = [(r.kind, n, sorted(c)) for r in RULES if (q := trigram_query(r.pattern)) != _ANY for n, c in enumerate(sorted(q, key=sorted))]
    spark = texts.sparkSession
    asked = spark.createDataFrame([(k, n, t, len(c)) for k, n, c in rows for t in c], "kind string, clause int, trigram string, wanted int")
    index = postings(texts, sorted({t for _, _, c in rows for t in c}))
    # the queries are as many as the rules' trigrams, a fixed number
    met = index.join(F.broadcast(asked), "trigram").groupBy("doc_id", "version", "kind", "clause", "wanted").agg(F.count_distinct("trigram").alias("n"))
    return met.filter("n = wanted").groupBy("doc_id", "version").agg(F.collect_set("kind").alias("kinds"))


def find(docs: DataFrame) -> DataFrame:
    """``(doc_id, found)``: all spans of each document, by start and then kind."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("version", F.xxhash64("text"))
    named = durable(candidates(texts)).withColumnsRenamed({"doc_id": "_doc", "version": "_version"})
    joined = texts.join(named, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("version") == F.col("_version")), "left")
    empty = F.array().cast("array<struct<start:long,rank:int,end:long,kind:string>>")
    each = []
    for rule in RULES:
        ask = F.lit(True) if trigram_query(rule.pattern) == _ANY else F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))
        each.append(F.when(ask & F.col("text").rlike(rule.java), spans(F.col("text"), rule)).otherwise(empty))
    return joined.select("doc_id", F.array_sort(F.concat(*each)).alias("found"))


def report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)``, a row for each document."""
    line = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return find(docs).select(
        "doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("found")).alias("spans")
    )
