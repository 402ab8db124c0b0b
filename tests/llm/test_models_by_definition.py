"""Scores of the trained models against plain loops over their definitions."""

import math
import re
from collections import Counter

import numpy as np

from quillspark.llm import quality_classifier as qc
from quillspark.llm import toxicity

from .conftest import make


def test_noisy_or_of_sentences(spark, nasty):
    model = {"bias": -3.0, "leak": 0.02, "weights": {"ba*": 0.0, "bara*": 0.7, "cat": 2.5, "dog": 1.0, "s": 0.2, "one": 4.0}}
    out = toxicity.score(spark, nasty, model).collect()
    want, located = Counter(), {}
    for r in nasty.collect():
        clear, found = 1 - model["leak"], []
        for s in re.split(r"[.!?\n]", r["text"] or ""):
            words = re.findall(r"\w+", s.lower())
            if words:
                x = model["bias"] + sum(model["weights"].get(f, 0) for w in words for f in [w, *(w[:n] + "*" for n in (4, 5, 6) if len(w) > n)])
                p = 1 / (1 + math.exp(-x))
                clear *= 1 - p
                found.append((p, s.strip()))
        want[r["doc_id"], round(1 - clear, 6)] += 1
        hot = [s for p, s in found if p >= toxicity.CUT] or ([max(found, key=lambda f: f[0])[1]] if found and 1 - clear >= toxicity.CUT else [])
        located[r["doc_id"], r["text"]] = hot
    assert Counter((r["doc_id"], round(r["score"], 6)) for r in out) == want
    got = {r["doc_id"]: [s["text"] for s in r["offending"]] for r in out}
    for (d, _), hot in located.items():
        if d is not None and d != 7:
            assert got[d] == hot
    assert all(r["n_offending"] >= 1 and len(r["offending"]) == r["n_offending"] for r in out if r["score"] >= toxicity.CUT)


def test_pool():
    r = np.random.default_rng(3)
    vectors = r.normal(size=(qc.SLOTS, qc.WIDTH)).astype(np.float32)
    for ids in ([], [5], [7, 7, 9], r.integers(0, 50, 300).tolist()):
        got = qc.pool(np.array(ids, np.int64), vectors)
        v = [vectors[i].astype(float) for i in ids]
        n = len(ids)
        if not n:
            assert not got.any()
            continue
        mean = sum(v) / n
        spread = np.sqrt(np.maximum(sum(x * x for x in v) / n - mean**2, 0))
        near = sum(float(a @ b) for a, b in zip(v, v[1:])) / n  # noqa: B905
        same = sum(a == b for a, b in zip(ids, ids[1:])) / (n - 1) if n > 1 else 0  # noqa: B905
        want = [*mean, *spread, near, same, len(set(ids)) / n**0.8, math.log1p(n) / 5]
        assert np.allclose(got, want, atol=2e-3)


def test_forward_pass_and_temperature():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 6))
    y = (x[:, 0] + 0.3 * r.normal(size=400) > 0).astype(int)
    m = qc.fit_network(x, y, epochs=30)
    p = qc.probabilities(m, x)
    for i in range(0, 400, 37):
        h = [math.tanh(sum((x[i, a] - m["mu"][a]) / m["sd"][a] * m["w1"][a, b] for a in range(6)) + m["b1"][b]) for b in range(qc.HIDDEN)]
        z = sum(h[b] * m["w2"][b] for b in range(qc.HIDDEN)) + m["b2"]
        assert abs(p[i] - 1 / (1 + math.exp(-z / m["temperature"]))) < 1e-9
    # the temperature is the best of its grid on the rows that the network did not see
    val = np.random.default_rng(5).permutation(400)[:80]
    z = qc._forward(m, x[val])[1]
    loss = lambda t: sum(math.log1p(math.exp(-(a if b else -a) / t)) for a, b in zip(z, y[val], strict=True))
    assert loss(m["temperature"]) <= min(map(loss, np.geomspace(0.25, 8, 81))) + 1e-9
    assert ((p >= 0.5) == y).mean() > 0.8  # the labels are noisy


def test_held_out_toxicity_of_invented_texts(spark):
    from .test_text_operators import labelled_texts

    model = toxicity.train(labelled_texts(5, 500))
    fresh = labelled_texts(6, 300)
    out = {r["doc_id"]: r for r in toxicity.score(spark, make(spark, [(i, t) for i, (t, _) in enumerate(fresh)]), model).collect()}
    caught = [out[i]["score"] >= toxicity.CUT for i, (_, y) in enumerate(fresh) if y]
    assert sum(caught) >= 0.9 * len(caught)
