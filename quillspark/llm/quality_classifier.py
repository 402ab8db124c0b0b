"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Words hash into a fixed number of slots. Each slot has a sparse ternary index vector; a slot's word
vector is the sum of the index vectors of its neighbours over all documents (random indexing), a
table of fixed size that tasks add up and Spark sums. A document pools its words' vectors: mean,
spread and the agreement of neighbours. A two-layer numpy network, fitted on a bounded labelled
sample, and a temperature fitted on a part of it that the network did not see, give probabilities.

Defined cases: null and empty texts pool to zeros and are scored like any other; null ids and
repeated rows are kept; without labels of both kinds every score is the labels' mean (0.5 if there
are none); an empty table gives an empty result; labels, lang, source and ids are never inputs.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, labelled, sliced, table, training_sample

SLOTS, WIDTH, NONZERO, WINDOW = 1 << 14, 32, 2, 2
#: Bounds of the labelled sample: rows and characters.
MAX_ROWS, MAX_CHARS = 8_000, 20_000_000
HIDDEN = 24
TOKEN = re.compile(r"\w+|[^\w\s]+")
CACHE = 100_000
#: Tokens counted at once; the sums are the same for any number.
BATCH = 1 << 17


class Slots(dict):
    """A token's slot: by its lower case, and apart for words in capitals; remembered."""

    def __missing__(self, token: str) -> int:
        key = "\x01" + token if len(token) > 1 and token.isupper() else token.lower()
        slot = zlib.crc32(key.encode("utf-8", "replace")) % SLOTS
        if len(self) > CACHE:
            self.clear()
        self[token] = slot
        return slot

    def of(self, text: str | None) -> np.ndarray:
        tokens = TOKEN.findall(text or "")
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))


def index_vectors(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero elements of every slot's index vector."""
    r = np.random.default_rng(seed)
    places = np.argsort(r.random((SLOTS, WIDTH)), axis=1)[:, :NONZERO]
    return places, r.choice(np.array([-1.0, 1.0]), (SLOTS, NONZERO))


def _add_contexts(total: np.ndarray, ids: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Adds neighbours' index vectors of a run of slots (-1 between documents) to ``total``."""
    for o in range(1, WINDOW + 1):
        a, b = ids[:-o], ids[o:]
        ok = (a >= 0) & (b >= 0)
        if o > 1:
            ok &= ids[1:-1] >= 0
        a, b = a[ok], b[ok]
        for x, y in ((a, b), (b, a)):
            for j in range(NONZERO):
                total += np.bincount(x * WIDTH + places[y, j], signs[y, j], total.size)


def contexts(docs: DataFrame) -> DataFrame:
    """(slot, c0, c1, ...): the word vectors summed over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, total = Slots(), np.zeros(SLOTS * WIDTH)
        places, signs = index_vectors()
        gap, held, size = np.array([-1], np.int64), [], 0
        for b in sliced(batches):
            for t in b.column(0).to_pylist():
                ids = slots.of(t)
                held += [ids, gap]
                size += len(ids)
                if size >= BATCH:
                    _add_contexts(total, np.concatenate(held), places, signs)
                    held, size = [], 0
        if held:
            _add_contexts(total, np.concatenate(held), places, signs)
        m = total.reshape(SLOTS, WIDTH).astype(np.int64)
        used = np.flatnonzero(m.any(axis=1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(m[used, i]) for i in range(WIDTH))], names)

    names = ["slot", *(f"c{i}" for i in range(WIDTH))]
    each = docs.select("text").mapInArrow(run, ", ".join(f"{n} long" for n in names))
    return each.groupBy("slot").agg(*(F.sum(n).alias(n) for n in names[1:]))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of word vectors, each of length one (zero for slots never seen)."""
    t = contexts(docs).toArrow()  # SLOTS rows at most, whatever the corpus
    m = np.zeros((SLOTS, WIDTH), np.float64)
    if t.num_rows:
        m[t.column(0).to_numpy()] = np.stack([t.column(i + 1).to_numpy() for i in range(WIDTH)], axis=1)
    m = np.sign(m) * np.log1p(np.abs(m))
    return (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pool(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of a document's vectors, agreement of neighbours, variety and size."""
    n = len(ids)
    if not n:
        return np.zeros(2 * WIDTH + 4, np.float32)
    s, sq, near = np.zeros(WIDTH), np.zeros(WIDTH), 0.0
    for at in range(0, n, 1 << 16):  # memory stays bounded for very long texts
        v = vectors[ids[at : at + (1 << 16)]]
        s += v.sum(0, dtype=np.float64)
        sq += np.einsum("ij,ij->j", v, v)
        near += float(np.einsum("ij,ij->", v[1:], v[:-1]))
    mean = s / n
    spread = np.sqrt(np.maximum(sq / n - mean**2, 0))
    same = float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0
    variety = len(np.unique(ids)) / n**0.8
    return np.concatenate([mean, spread, [near / n, same, variety, np.log1p(n) / 5]]).astype(np.float32)


def _forward(m: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh((x - m["mu"]) / m["sd"] @ m["w1"] + m["b1"])
    return h, h @ m["w2"] + m["b2"]


def fit_network(x: np.ndarray, y: np.ndarray, epochs: int = 300, rate: float = 0.01, l2: float = 1e-4, seed: int = 5) -> dict:
    """Two layers by Adam on four fifths of the rows, then a temperature on the rest."""
    r = np.random.default_rng(seed)
    base = float(y.mean()) if len(y) else 0.5
    m = {"mu": np.zeros(x.shape[1]), "sd": np.ones(x.shape[1]), "base": base, "constant": True}
    if len(y) < 10 or y.min() == y.max():
        return m
    order = r.permutation(len(y))
    cut = len(y) // 5
    val, trn = order[:cut], order[cut:]
    m |= {"constant": False, "mu": x[trn].mean(0), "sd": x[trn].std(0) + 1e-6}
    m |= {"w1": r.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": r.normal(0, 0.2, HIDDEN), "b2": 0.0}
    keys = ["w1", "b1", "w2", "b2"]
    mom, var = {k: 0.0 for k in keys}, {k: 0.0 for k in keys}
    xs, t, step = (x - m["mu"]) / m["sd"], y.astype(float), 0
    for _ in range(epochs):
        for part in np.array_split(r.permutation(trn), max(1, len(trn) // 512)):
            step += 1
            h, z = _forward(m, x[part])
            d = (1 / (1 + np.exp(-z)) - t[part]) / len(part)
            dh = np.outer(d, m["w2"]) * (1 - h**2)
            g = {"w2": h.T @ d + l2 * m["w2"], "b2": d.sum(), "w1": xs[part].T @ dh + l2 * m["w1"], "b1": dh.sum(0)}
            for k in keys:
                mom[k] = 0.9 * mom[k] + 0.1 * g[k]
                var[k] = 0.999 * var[k] + 0.001 * g[k] ** 2
                m[k] = m[k] - rate * (mom[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)
    z = _forward(m, x[val])[1]
    temps = np.geomspace(0.25, 8, 81)
    loss = [np.logaddexp(0, np.where(t[val] == 1, -z, z) / k).mean() for k in temps]
    m["temperature"] = float(temps[int(np.argmin(loss))])
    return m


def probabilities(m: dict, x: np.ndarray) -> np.ndarray:
    if m["constant"]:
        return np.full(len(x), m["base"])
    return 1 / (1 + np.exp(-np.clip(_forward(m, x)[1] / m["temperature"], -50, 50)))


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    vectors = word_vectors(docs)
    sample = training_sample(docs, labels, MAX_ROWS, MAX_CHARS)
    slots = Slots()
    x = np.array([pool(slots.of(t), vectors) for t, _ in sample], np.float32).reshape(-1, 2 * WIDTH + 4)
    return {"vectors": vectors, "net": fit_network(x, np.array([v for _, v in sample]))}


def score(spark: SparkSession, docs: DataFrame, model: dict, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns of ``docs`` (or those in ``keep``) and ``name``, the probability of good quality."""
    sent = spark.sparkContext.broadcast(model)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, slots = sent.value, Slots()
        for b in sliced(batches, 1024):
            x = np.array([pool(slots.of(t), m["vectors"]) for t in b.column(at).to_pylist()], np.float32)
            p = probabilities(m["net"], x.reshape(-1, 2 * WIDTH + 4))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in held), pa.array(p, pa.float64())], names)

    keep = docs.columns if keep is None else keep
    at, held, names = docs.columns.index("text"), [docs.columns.index(c) for c in keep], [*keep, name]
    return docs.mapInArrow(run, docs.select(*keep, F.lit(0.0).alias(name)).schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, labelled(spark, sf_dir, "quality"))
    scored = score(spark, docs, model, ["doc_id"])  # the text does not come back from Python
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
