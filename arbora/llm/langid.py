"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are TF-IDF weights of hashed character n-grams (``ORDERS``) of the
lower-cased text, term frequency as a share of the text's n-grams. Document
frequencies count over all learning documents. The regression is trained with
follow-the-regularised-leader (per-coordinate rates, elastic net) on at most
``SAMPLE`` distinct texts a language, and its logits are calibrated by one
temperature on a disjoint part of that sample.

Only ``text`` is an input of a prediction; only text and ``lang`` of documents
outside the held-out fifth are learnt from. Defined cases: null texts and texts
without a letter give ``und`` with score 0; repeated rows are scored alike; without
any labelled row every text is ``und``; an empty table gives an empty result; other
columns are ignored; texts of any length are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm._shared import batches, durable, held_out

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
#: Distinct learning texts of each language that the regression is fitted on.
SAMPLE = 1500
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
UNKNOWN = "und"


def ngrams(text: str) -> np.ndarray:
    """Buckets of all n-grams of the lower-cased text; white space and digits are one blank each."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    code = np.where((code <= 32) | ((code >= 48) & (code <= 57)), np.uint64(32), code)
    out, rolled = [], np.zeros(0, np.uint64)
    for order in range(1, max(ORDERS) + 1):
        rolled = code + np.uint64(1) if order == 1 else rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + code[order - 1 :] + np.uint64(1)
        if order in ORDERS and len(rolled):
            mixed = (rolled + np.uint64(order)) * np.uint64(0xD6E8FEB86659FD93)
            out.append((mixed >> np.uint64(48)).astype(np.int64) % BUCKETS)
    return np.concatenate(out)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def _document_frequency(learn: DataFrame) -> tuple[np.ndarray, int]:
    """Learning documents in which each bucket occurs, summed on the executors before it is gathered."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for frame in batches(frames):
            for text in frame["text"]:
                seen = np.zeros(BUCKETS, bool)
                seen[ngrams(text)] = True
                total += seen
                n += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(total[at], n)})

    rows = learn.select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS, np.int64)
    real = rows["bucket"] >= 0
    df[rows["bucket"][real]] = rows["n"][real]
    return df, int(rows["n"][~real].sum())


def _sparse(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    grams = ngrams(text)
    at, count = np.unique(grams, return_counts=True)
    return at.astype(np.int32), (count / len(grams) * idf[at]).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, k: int) -> np.ndarray:
    """FTRL-proximal over the rows; weights of shape (BUCKETS + 1, k), the last row is the bias."""
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, value = np.append(rows[i][0], BUCKETS), np.append(rows[i][1] * SCALE, 1.0)
            w = weights(at)
            logit = value @ w
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = value[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(BUCKETS + 1))


#: Term frequencies are shares; this brings a typical row to length about one.
SCALE = 8.0


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, from a geometric grid."""

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), labels]).mean())

    return min(np.geomspace(0.05, 20, 61), key=loss) if len(labels) else 1.0


def fit(docs: DataFrame) -> dict:
    """The model: languages, a weight for each bucket and language (idf folded in), temperature."""
    lettered = F.col("text").rlike(r"\p{L}")
    learn = docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & lettered)
    df, n = _document_frequency(learn)
    idf = np.log((1 + n) / (1 + df)) + 1
    key = durable(learn.select("lang", F.xxhash64("text").alias("k")).distinct())
    langs = sorted(r.lang for r in key.select("lang").distinct().collect())
    if not langs:
        return {"langs": [], "weights": np.zeros((BUCKETS + 1, 0), np.float32), "t": 1.0}

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames):
            rows = [_sparse(t, idf) for t in frame["text"]]
            yield pd.DataFrame({"lang": frame["lang"], "k": frame["k"], "at": [a.tobytes() for a, _ in rows], "v": [v.tobytes() for _, v in rows]})

    picked = None
    for lang in langs:
        own = key.filter(F.col("lang") == lang).orderBy("k").limit(SAMPLE)
        picked = own if picked is None else picked.unionByName(own)
    chosen = durable(picked)
    texts = learn.withColumn("k", F.xxhash64("text")).join(chosen, ["lang", "k"], "left_semi").groupBy("lang", "k").agg(F.min("text").alias("text"))
    rows = texts.mapInPandas(features, "lang string, k long, at binary, v binary").toPandas().sort_values(["k", "lang"])
    sparse = [(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32)) for a, v in zip(rows["at"], rows["v"], strict=True)]
    labels = np.array([langs.index(x) for x in rows["lang"]])
    part = np.arange(len(sparse)) % 10 == 9
    weights = train([r for r, p in zip(sparse, part, strict=True) if not p], labels[~part], len(langs))
    logits = np.array([(v * SCALE) @ weights[a] + weights[BUCKETS] for (a, v), p in zip(sparse, part, strict=True) if p]).reshape(-1, len(langs))
    folded = weights.copy()
    folded[:BUCKETS] *= idf[:, None] * SCALE
    return {"langs": langs, "weights": folded.astype(np.float32), "t": temperature(logits, labels[part])}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, a row for each document."""
    langs, weights, t = model["langs"], model["weights"], model["t"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames):
            names, scores = [], []
            for text in frame["text"]:
                if not langs or not has_letter(text):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                count = np.bincount(ngrams(text), minlength=BUCKETS)
                at = np.flatnonzero(count)
                logit = ((count[at] / count.sum()) @ weights[at].astype(np.float64) + weights[BUCKETS]) / t
                p = np.exp(logit - logit.max())
                best = int(p.argmax())
                names.append(langs[best])
                scores.append(float(p[best] / p.sum()))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "lang_pred": names, "score": scores})

    out = docs.select("doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))
