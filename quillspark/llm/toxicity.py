"""Toxicity by multiple-instance learning: sentences are the instances, documents the bags.

A sentence's probability is logistic in its words and their prefixes; a document's is the leaky
noisy-or of its sentences, 1 - (1 - leak) * prod(1 - p). Weights are trained from document labels
alone, on a bounded sample, and then point to the offending sentences.

Defined cases: null and empty texts have no sentence and score ``leak``; null ids and repeated rows
are scored like any other; very long texts are scored whole; without usable labels of both kinds every
score is ``leak``; an empty table gives an empty result; columns but the id and the text (labels, lang,
source, others of any name) are never inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, labelled, sliced, table, training_sample

#: Bounds of the training sample: labelled rows and characters. A text's features are bounded by them.
MAX_ROWS, MAX_CHARS = 8_000, 10_000_000
#: Documents of this score or more are called toxic, and sentences of this probability offending.
CUT = 0.3
#: A feature's least number of documents, and how far (in standard deviations) it must lean to the label.
MIN_DOCS, MIN_Z = 3, 3.0
LEAK = 0.02
PREFIXES = (4, 5, 6)
TOKEN = re.compile(r"\w+|[.!?\n]")
#: Remembered word weights of a task.
CACHE = 500_000


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def bag(text: str) -> list[list[str]]:
    """The sentences of a text as lists of lower-cased words; sentences without words are none."""
    out: list[list[str]] = [[]]
    for t in TOKEN.findall(text.lower()):
        if t in ".!?\n":
            out.append([])
        else:
            out[-1].append(t)
    return [s for s in out if s]


def train(sample: list[tuple[str, int]], epochs: int = 200, rate: float = 0.08, l2: float = 1e-5, l1: float = 2e-5, leak: float = LEAK) -> dict:
    """Weights by feature, bias and leak, by full-batch Adam on the noisy-or's likelihood."""
    none = {"bias": -50.0, "leak": leak, "weights": {}}
    y = np.array([v for _, v in sample], np.float64)
    if not len(y) or y.min() == y.max():
        return none
    bags = [bag(t) for t, _ in sample]
    seen: Counter = Counter()
    hot: Counter = Counter()
    for b, v in zip(bags, y, strict=True):
        own = {f for s in b for w in s for f in features(w)}
        seen.update(own)
        if v:
            hot.update(own)
    rate1 = y.mean()
    # a bag is positive for what it holds, so only features found there beyond chance can matter
    z = {f: (hot[f] - n * rate1) / np.sqrt(n * rate1 * (1 - rate1)) for f, n in seen.items() if n >= MIN_DOCS}
    chosen = sorted((f for f in z if z[f] >= MIN_Z), key=lambda f: (-z[f], f))
    index = {f: i for i, f in enumerate(chosen)}
    col, row, doc = [], [], []
    for d, b in enumerate(bags):
        for s in b:
            k = [index[f] for w in s for f in features(w) if f in index]
            col.extend(k)
            row.extend([len(doc)] * len(k))
            doc.append(d)
    col, row, doc = np.array(col, np.int64), np.array(row, np.int64), np.array(doc, np.int64)
    n, m, k = len(doc), len(y), len(chosen)
    w, bias = np.full(k, 0.1), -5.0
    mw, vw, mb, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
    for step in range(1, epochs + 1):
        x = bias + np.bincount(row, w[col], n)
        p = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        clear = (1 - leak) * np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), m))
        dirty = np.maximum(1 - clear, 1e-9)
        g = np.where(y[doc] == 1, -clear[doc] / dirty[doc], 1.0) * p
        gw = np.bincount(col, g[row], k) / m + l2 * w + l1
        gb = g.sum() / m
        mw, vw = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        a, b2 = 1 - 0.9**step, 1 - 0.999**step
        w = np.maximum(w - rate * (mw / a) / (np.sqrt(vw / b2) + 1e-8), 0)
        bias -= rate * (mb / a) / (np.sqrt(vb / b2) + 1e-8)
    # the bias moves up as long as the cut then parts the training documents better
    x = np.bincount(row, w[col], n)
    best = (-1.0, bias)
    for shift in np.linspace(0, 2, 9):
        odds = np.logaddexp(0, np.clip(x + bias + shift, -50, 50))
        hit = -np.expm1(np.log1p(-leak) - np.bincount(doc, odds, m)) >= CUT
        best = max(best, (hit[y == 1].mean() - hit[y == 0].mean(), -abs(shift), bias + shift)[::2], key=lambda b: b[0])
    bias = best[1]
    return {"bias": float(bias), "leak": leak, "weights": {f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-3}}


class _Weights(dict):
    """A word's weight: of itself and its prefixes, remembered; a mark that ends a sentence has none."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if word in ".!?\n":
            value = np.nan
        else:
            value = sum(self.weights.get(f, 0.0) for f in features(word))
        if len(self) > CACHE:
            self.clear()
        self[word] = value
        return value


def _logits(text: str, known: _Weights, bias: float) -> np.ndarray:
    """One logit for each sentence with words. Features count once a word, as often as it stands."""
    tokens = TOKEN.findall(text.lower())
    if not tokens:
        return np.zeros(0)
    x = np.fromiter(map(known.__getitem__, tokens), np.float64, len(tokens))
    stop = np.isnan(x)
    sentence = np.cumsum(stop)
    words = ~stop
    if not words.any():
        return np.zeros(0)
    s = np.bincount(sentence[words], x[words])
    n = np.bincount(sentence[words])
    return bias + s[n > 0]


def noisy_or(logits: np.ndarray, leak: float) -> float:
    return float(-np.expm1(np.log1p(-leak) - np.logaddexp(0, np.clip(logits, -50, 50)).sum()))


def offending(logits: np.ndarray, score: float) -> np.ndarray:
    """Numbers of the sentences at CUT or more; the likeliest one of a toxic document that has none."""
    hot = np.flatnonzero(logits >= np.log(CUT / (1 - CUT)))
    return hot if len(hot) or score < CUT or not len(logits) else np.array([int(np.argmax(logits))])


def score(spark: SparkSession, docs: DataFrame, model: dict, located: bool = True) -> DataFrame:
    """doc_id, score, n_offending and offending (text and probability of those sentences)."""
    sent = spark.sparkContext.broadcast(model)  # bounded by the sample's bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        known, bias, leak = _Weights(m["weights"]), m["bias"], m["leak"]
        for b in sliced(batches, 1024):
            scores, counts, found = [], [], []
            for t in b.column(1).to_pylist():
                x = _logits(t or "", known, bias)
                scores.append(min(max(noisy_or(x, leak), 0.0), 1.0))
                hot = offending(x, scores[-1])
                counts.append(len(hot))
                found.append(_locate(t, hot, x) if located and len(hot) else [])
            cols = [b.column(0), pa.array(scores, pa.float64()), pa.array(counts, pa.int64())]
            names = ["doc_id", "score", "n_offending"]
            if located:
                cols.append(pa.array(found, pa.list_(pa.struct([("text", pa.string()), ("p", pa.float64())]))))
                names.append("offending")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, score double, n_offending long" + (", offending array<struct<text: string, p: double>>" if located else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _locate(text: str, hot: np.ndarray, logits: np.ndarray) -> list[dict]:
    sentences = [s for s in re.split(r"[.!?\n]", text) if re.search(r"\w", s)]
    return [{"text": sentences[i].strip(), "p": float(1 / (1 + np.exp(-logits[i])))} for i in hot if i < len(sentences)]


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    return train(training_sample(docs, labels, MAX_ROWS, MAX_CHARS))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, labelled(spark, sf_dir, "toxic"))
    scored = score(spark, docs, model)
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "n_offending", "offending"
    )
