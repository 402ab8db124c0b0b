import random

from pyspark.sql import functions as F

from quillspark.llm import near_dedup

from .conftest import make


def group(seed, n, most, shared=()):
    """Copies of one text, each with up to ``most`` words changed: to new ones, or to some of ``shared``."""
    r = random.Random(seed)
    base = [f"w{seed}x{r.randrange(400)}" for _ in range(150)]
    out = []
    for i in range(n):
        copy = list(base)
        for at in r.sample(range(150), r.randrange(most + 1)):
            copy[at] = r.choice(shared) if shared else f"n{seed}x{i}x{at}"
        out.append(" ".join(copy))
    return out


def parts(n, near):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min(label[j] for j in range(n) if near[i][j])
            changed |= low < label[i]
            label[i] = min(low, label[i])
    return label


def test_large_groups_of_near_copies_meet_without_a_square(spark, monkeypatch):
    texts = group(1, 300, 14) + group(2, 120, 20, ("one", "two", "three")) + ["", "a b", "a b c d e f"]
    docs = make(spark, list(enumerate(texts)))
    sizes, real = {}, near_dedup.written

    def counted(spark, df, name):
        out = real(spark, df, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "written", counted)
    got = {r["doc_id"]: r["root"] for r in near_dedup.near_duplicates(spark, docs, similarity=0.8).collect()}
    sets, fp = [set(near_dedup.shingles(t).tolist()) for t in texts], [near_dedup.fingerprint(t) for t in texts]
    near = [[(fp[i] ^ fp[j]).bit_count() <= 3 or len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    want = parts(len(texts), near)
    assert len(set(want)) > 50
    same = {}
    for i, w in enumerate(want):
        assert same.setdefault(w, got[i]) == got[i]
    assert len(set(same.values())) == len(same)
    assert max(sizes["pairs"]) < 20 * len(texts) and sum(sizes["pairs"]) < 30 * len(texts)


def test_prefixes_miss_no_pair(spark):
    r = random.Random(3)
    sets = []
    for _ in range(25):
        base = r.sample(range(300), r.randrange(1, 40))
        for _ in range(8):
            own = {x for x in base if r.random() > 0.08} | set(r.sample(range(300), r.randrange(4)))
            sets.append(sorted(own))
    rows = [(i, i % 7, s) for i, s in enumerate(sets) if s]
    df = spark.createDataFrame(rows, "th long, root long, s array<long>")
    for t in (0.5, 0.8, 1.0):
        got = {(x["a"], x["b"]) for x in near_dedup.apart(spark, df, t).collect()}
        alike = lambda a, b: len(set(a) & set(b)) >= t * len(set(a) | set(b))  # noqa: E731, B023
        want = {(i, j) for i, a, s in rows for j, b, u in rows if i < j and a != b and alike(s, u)}
        assert want <= got and all(rows and i < j for i, j in got) and (t == 1.0 or len(want) > 20)
    assert near_dedup.apart(spark, df.filter(F.col("th") < 0), 0.8).count() == 0
