"""Toxicity by weak supervision.

Voters look at a text and vote toxic, vote clean or abstain: lexicons of words and word stems (one
of general insults, others mined for either class) and surface patterns of either class. A generative
label model estimates by expectation maximisation how often each voter votes on texts of
either class, hence its accuracy, and the
correlation of the voters given the class, by which correlated voters share their weight; how often a voter
abstains in either class is part of the model. Its posteriors from the votes are the soft labels of a sparse linear classifier on hashed
words and word stems, which scores every text.

Human labels are no term of these targets. On four fifths of the learning texts (by a hash of the text) they are used to mine
lexicons and are a voter of estimated accuracy while the others' are estimated, which keeps the classes in place; on the other fifth they only calibrate the classifier's
scores by a logistic curve of two numbers. Only ``text`` is an input of a score; labels are learnt only outside the held-out
fifth, on at most ``SAMPLE`` labelled texts. Defined cases: null and empty texts
have no feature and get the score of the bias; repeated rows are scored alike;
without labels of both classes the general lexicon alone decides; an empty table gives an empty result;
other columns are ignored; texts are scored whole, whatever their length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm._shared import batches, durable, held_out, table

#: English insults that any general lexicon holds.
LEXICON = frozenset("idiot moron stupid dumb loser scum trash garbage clown worthless pathetic disgusting imbecile retard bastard bitch whore slut asshole shithead fuck fucking cunt vermin subhuman".split())
#: Labelled learning texts that voters and classifier are fitted on, chosen by a hash of the text.
SAMPLE = 12_000
#: Mined lexicons for either class, and entries of one.
TOXIC_LEXICONS, CLEAN_LEXICONS, ENTRIES = 24, 12, 4
#: Log-odds that an entry has at least, as its lower bound.
LEAST_ODDS = 1.0
BUCKETS = 1 << 20
STEMS = (4, 5, 6)
EPOCHS = 4
#: One learning text of so many serves for calibration only.
CALIBRATION = 5
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def buckets_of(word: str) -> list[int]:
    """Hashed features of one word: the word, and its first letters if it is longer."""
    data = word.encode("utf-8", "surrogatepass")
    out = [zlib.crc32(b"w" + data) & (BUCKETS - 1)]
    for n in STEMS:
        if len(word) >= n:
            out.append(zlib.crc32(b"s%d" % n + word[:n].encode("utf-8", "surrogatepass")) & (BUCKETS - 1))
    return out


def features(text: str | None) -> np.ndarray:
    return np.unique(np.array([b for w in words(text) for b in buckets_of(w)], np.int32))


_LEXICON_BUCKETS = np.array(sorted(buckets_of(w)[0] for w in LEXICON), np.int32)


_QUOTED = re.compile(r"[\"\u201c\u201e\u00ab][^\"\u201d\u201c\u00bb]{3,}[\"\u201d\u201c\u00bb]")
_LINK = re.compile(r"https?://|www\.|\S@\S+\.\w")
_MASKED = re.compile(r"\b\w[*#@$%!]{2,}\w*\b")
_STRETCHED = re.compile(r"([^\W\d_])\1{3,}")
_DIGITS_IN = re.compile(r"[^\W\d_][0134578][^\W\d_]")
_YOU = re.compile(r"\byou(?:'re| are)\b|\bdu bist\b|\btu es\b|\beres\b", re.IGNORECASE)
#: Which way each pattern votes: 1 toxic, 0 clean.
PATTERNS = (1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0)


def patterns(text: str | None) -> list[bool]:
    """Surface voters, in the order of ``PATTERNS``; one that does not hold abstains."""
    if not text:
        return [False] * len(PATTERNS)
    n = len(text)
    letters, upper = sum(map(str.isalpha, text)), sum(map(str.isupper, text))
    tokens = text.split()
    different = len(set(tokens))
    stops = text.count(".")
    return [
        letters > 20 and upper > 0.6 * letters, text.count("!") > 0.1 * len(tokens) + 2, len(tokens) > 20 and different < 0.1 * len(tokens), "!!" in text or "?!" in text,
        bool(_MASKED.search(text)), bool(_STRETCHED.search(text)), bool(_DIGITS_IN.search(text)), bool(_YOU.search(text)),
        bool(_QUOTED.search(text)), bool(_LINK.search(text)), n > 0 and sum(map(str.isdigit, text)) > 0.02 * n, len(tokens) > 50 and stops > 3 and "!" not in text, text.count("\n") > 5, len(tokens) > 30 and different > 0.85 * len(tokens),
    ]


#: Features that are worked on at once, so that the driver needs little beside the sample itself.
CHUNK = 1 << 20


def counted(flat: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """How often each bucket occurs among the chosen features."""
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(flat), CHUNK):
        out += np.bincount(flat[at : at + CHUNK][chosen[at : at + CHUNK]], minlength=BUCKETS)
    return out


def mine(flat: np.ndarray, of: np.ndarray, rest: np.ndarray, n: int, m: int, lexicons: int) -> np.ndarray:
    """Lexicon of each bucket, -1 for none: those whose presence speaks for the ``n`` texts whose features are ``of``, against ``m`` others, by the lower bound of its log-odds."""
    with_, without = counted(flat, of), counted(flat, rest)
    odds = np.log((with_ + 0.5) / (n - with_ + 0.5)) - np.log((without + 0.5) / (m - without + 0.5))
    sure = odds - 1.64 * np.sqrt(1 / (with_ + 0.5) + 1 / (without + 0.5))
    at = np.flatnonzero((with_ >= 4) & (sure > LEAST_ODDS))
    best = at[np.argsort(-sure[at], kind="stable")][: lexicons * ENTRIES]
    out = np.full(BUCKETS, -1, np.int8)
    # dealt in turn, so that every lexicon holds strong entries and weak ones
    out[best] = np.arange(len(best)) % lexicons
    return out


class LabelModel:
    """P(vote | class) of every voter, the class balance, and the shared weight of correlated voters.

    The labels of the texts for mining are one more voter, on those only, whose own accuracy is estimated
    with the others'; it keeps the two classes in their places and is left out of ``posterior``.
    """

    def __init__(self, voted: np.ndarray, polarity: np.ndarray, marks: np.ndarray, mining: np.ndarray, rounds: int = 25) -> None:
        self.label_on, self.label_off = 0.9, 0.05
        q = np.where(mining & marks, 0.9, 0.05)
        for step in range(rounds):
            # the first round learns from the texts that have labels, the others from all
            own = mining if step == 0 else np.ones(len(voted), bool)
            p, v = q[own], voted[own]
            self.prior = float(np.clip(p.mean(), 1e-3, 0.5))
            self.on = np.clip((v.T @ p + 0.02) / (p.sum() + 1), 1e-5, 1 - 1e-5)
            self.off = np.clip((v.T @ (1 - p) + 0.02) / ((1 - p).sum() + 1), 1e-5, 1 - 1e-5)
            rest = v - (p[:, None] * self.on + (1 - p[:, None]) * self.off)
            spread = np.sqrt((rest**2).mean(axis=0)) + 1e-9
            self.correlation = (rest.T @ rest) / len(v) / np.outer(spread, spread)
            shared = np.where(np.abs(self.correlation) > 0.3, np.abs(self.correlation), 0)
            np.fill_diagonal(shared, 1)
            self.weight = 1 / shared.sum(axis=1)
            if step:
                a, b = q[mining], marks[mining]
                self.label_on = float(np.clip((a[b].sum() + 1) / (a.sum() + 2), 0.02, 0.98))
                self.label_off = float(np.clip(((1 - a)[b].sum() + 1) / ((1 - a).sum() + 2), 0.02, 0.98))
            trust = np.where(marks, np.log(self.label_on / self.label_off), np.log((1 - self.label_on) / (1 - self.label_off)))
            q = self.posterior(voted, np.where(mining, trust, 0.0))
        share = np.where(polarity == 1, self.prior, 1 - self.prior)
        right, wrong = np.where(polarity == 1, self.on, self.off), np.where(polarity == 1, self.off, self.on)
        #: How often a vote is right.
        self.accuracy = right * share / (right * share + wrong * (1 - share))

    def posterior(self, voted: np.ndarray, trust: np.ndarray | float = 0.0) -> np.ndarray:
        says, silent = np.log(self.on / self.off), np.log((1 - self.on) / (1 - self.off))
        logit = np.log(self.prior / (1 - self.prior)) + voted @ (self.weight * says) + (1 - voted) @ (self.weight * silent) + trust
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def calibrated(logit: np.ndarray, marks: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits the marks best, by damped Newton steps with a little ridge."""
    x = np.stack([logit, np.ones(len(logit))], axis=1)
    w = np.array([1.0, 0.0])
    cost = lambda w: float(np.logaddexp(0, np.where(marks, -1, 1) * (x @ w)).sum() + 0.5 * ((w - (1, 0)) ** 2).sum())
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - marks) + w - (1, 0)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), grad)
        size = 1.0
        while size > 1e-6 and cost(w - size * step) >= cost(w):
            size /= 2
        if size <= 1e-6:
            break
        w = w - size * step
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def classifier(flat: np.ndarray, ends: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by follow-the-regularised-leader; sparse weights and a bias."""
    alpha, l1, l2 = 0.3, 0.8, 0.05
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    penal = np.full(BUCKETS + 1, l1)
    penal[BUCKETS] = 0

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        return np.where(np.abs(own) <= penal[at], 0.0, -(own - np.sign(own) * penal[at]) / ((1 + np.sqrt(n[at])) / alpha + l2))

    begin = np.concatenate([[0], ends[:-1]])
    order = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for i in order.permutation(len(ends)):
            at = np.append(flat[begin[i] : ends[i]], BUCKETS)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - target[i]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    return w[:BUCKETS].astype(np.float32), float(w[BUCKETS])


def learn(flat: np.ndarray, ends: np.ndarray, shown: np.ndarray, marks: np.ndarray, mining: np.ndarray) -> dict:
    """The model of texts whose buckets are ``flat`` up to ``ends``, with their patterns and labels, and whether they are for mining."""
    if not marks[mining].any() or marks[mining].all():
        weights = np.zeros(BUCKETS, np.float32)
        weights[_LEXICON_BUCKETS] = 4.0
        return {"weights": weights, "bias": -2.0}
    row = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))
    toxic, clean = (mining & marks)[row], (mining & ~marks)[row]
    n, m = int((mining & marks).sum()), int((mining & ~marks).sum())
    votes = []
    for lexicon, k in ((mine(flat, toxic, clean, n, m, TOXIC_LEXICONS), TOXIC_LEXICONS), (mine(flat, clean, toxic, m, n, CLEAN_LEXICONS), CLEAN_LEXICONS)):
        voted = np.zeros((len(ends), k))
        at = np.flatnonzero(lexicon[flat] >= 0)
        voted[row[at], lexicon[flat[at]]] = 1
        votes.append(voted)
    general, insult = np.zeros((len(ends), 1)), np.zeros(BUCKETS, bool)
    insult[_LEXICON_BUCKETS] = True
    general[row[insult[flat]]] = 1
    voted = np.hstack([*votes, general, shown])
    polarity = np.array([1] * TOXIC_LEXICONS + [0] * CLEAN_LEXICONS + [1, *PATTERNS])
    model = LabelModel(voted, polarity, marks, mining)
    weights, bias = classifier(flat, ends, model.posterior(voted))
    logit = np.full(len(ends), bias)
    for at in range(0, len(flat), CHUNK):
        logit += np.bincount(row[at : at + CHUNK], weights[flat[at : at + CHUNK]], minlength=len(ends))
    slope, shift = calibrated(logit[~mining], marks[~mining]) if (~mining).any() else (1.0, 0.0)
    return {"weights": (weights * slope).astype(np.float32), "bias": bias * slope + shift, "prior": model.prior, "accuracy": model.accuracy, "votes": voted.sum(axis=0), "polarity": polarity, "correlation": model.correlation}


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Weights of the linear classifier, with the label model's estimates for inspection."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).filter("_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    # the sample is found by hashes alone; then at most SAMPLE ids fetch their texts, a bound that allows a broadcast
    hashed = docs.filter("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("k")).join(known, F.col("doc_id") == F.col("_id"))
    keys = durable(hashed.groupBy("k").agg(F.min(F.struct("doc_id", "toxic")).alias("one")).orderBy("k").limit(SAMPLE).select(F.col("one.doc_id").alias("_id"), F.col("one.toxic").alias("toxic"), "k"))
    labelled = docs.select("doc_id", "text").join(F.broadcast(keys), (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("k")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames):
            yield pd.DataFrame({"k": frame["k"], "toxic": frame["toxic"], "f": [features(t).tobytes() for t in frame["text"]], "p": [bytes(patterns(t)) for t in frame["text"]]})

    # as Arrow: one buffer of all features, not an object a row
    sample = labelled.select("k", "toxic", "text").mapInPandas(run, "k long, toxic int, f binary, p binary").toArrow().sort_by("k")
    keys_, first = np.unique(sample["k"].to_numpy(), return_index=True)
    sample = sample.take(first).combine_chunks()
    parts = [np.frombuffer(x.as_buffer() or b"", np.int32) for x in sample["f"]]
    ends = np.cumsum([len(x) for x in parts], dtype=np.int64)
    flat = np.concatenate([np.zeros(0, np.int32), *parts])
    shown = np.array([list(x.as_py()) for x in sample["p"]], float).reshape(len(ends), len(PATTERNS))
    marks = sample["toxic"].to_numpy().astype(bool)
    del sample, parts
    pa.default_memory_pool().release_unused()
    return learn(flat, ends, shown, marks, (keys_ // 2) % CALIBRATION != 0)


def scored(texts: DataFrame, model: dict) -> DataFrame:
    """``(key, score)`` for each row of ``texts(key, text)``; key is a long."""
    at = np.flatnonzero(model["weights"])
    weight_of, bias = dict(zip(at.tolist(), model["weights"][at].tolist(), strict=True)), model["bias"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told: dict[str, tuple[int, ...]] = {}
        for frame in batches(frames):
            scores = []
            for text in frame["text"]:
                hits: set[int] = set()
                for word in words(text):
                    own = told.get(word)
                    if own is None:
                        if len(told) > 300_000:
                            told.clear()
                        own = told[word] = tuple(b for b in buckets_of(word) if b in weight_of)
                    if own:
                        hits.update(own)
                logit = bias + sum(weight_of[b] for b in sorted(hits))
                scores.append(1 / (1 + np.exp(-min(30.0, max(-30.0, logit)))))
            yield pd.DataFrame({"key": frame["key"], "score": scores})

    return texts.select("key", "text").mapInPandas(run, "key long, score double")


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, a row for each document."""
    out = scored(docs.select(F.col("doc_id").alias("key"), "text"), model)
    return out.select(F.col("key").alias("doc_id"), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return predict(docs, fit(docs, labels))


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose text is scored as toxic go, with or without a doc_id; columns may have any names."""
    texts = docs.select(F.xxhash64("text").alias("key"), "text")
    bad = scored(texts, fit(docs, table(spark, sf_dir, "labels"))).filter("score >= 0.5").select("key").distinct()
    boxed = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("text").alias("version"))
    return boxed.join(bad, F.col("version") == F.col("key"), "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
