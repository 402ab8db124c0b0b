import random

from quillspark.llm import near_dedup

from .conftest import make


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_stage_drops_near_copies_beyond_three_bits(spark, tmp_path):
    import corpus_pipeline as c

    r = random.Random(8)
    words = [f"{a}{b}{x}" for a in ("ba", "ko", "ti", "mu") for b in ("ra", "lo", "xe") for x in ("s", "m", "tu", "n")]
    rows, far = [], 0
    for i in range(60):
        base = [r.choice(words) for _ in range(300)]
        copy = list(base)
        for at in r.sample(range(300), 4 + i % 3 if i % 3 < 2 else 40):
            copy[at] = f"new{r.randrange(999)}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
        bits = (near_dedup.fingerprint(rows[-1][1]) ^ near_dedup.fingerprint(rows[-2][1])).bit_count()
        far += bits > 3 and jaccard(rows[-2][1], rows[-1][1]) >= 0.8
    assert far > 10
    # a chain: each alike its neighbours only
    chain = [r.choice(words) for _ in range(300)]
    for i in range(12):
        rows.append((900 + i, " ".join(chain)))
        chain = chain[24:] + [r.choice(words) for _ in range(24)]
    left = {x["doc_id"] for x in c.unlike(spark, make(spark, rows), str(tmp_path)).collect()}
    texts = dict(rows)
    for i in range(60):
        close = jaccard(texts[2 * i], texts[2 * i + 1]) >= 0.8
        assert 2 * i in left and (2 * i + 1 in left) != close
    assert [d for d in sorted(left) if d >= 900] == [900]
