"""Operators over texts against brute force, on nulls, empty, repeated, odd and very long texts."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import byte_bpe, exact_dedup, license_scan, near_dedup, packing, quality_classifier, quality_rules, toxicity

from .conftest import make

SPACE = r"[\x20\x09-\x0D]"


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_base_counts(spark, nasty, nothing):
    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)

    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = quality_rules.base_counts(nasty).select("doc_id", *cols).collect()
    want = Counter((d, *brute(t)) for d, t in pairs(nasty))
    assert Counter(map(tuple, got)) == want
    assert quality_rules.base_counts(nothing).count() == 0


@pytest.mark.parametrize("orders", [(1,), (1, 2)])
def test_llr(spark, orders):
    r = random.Random(1)
    good = [(i, " ".join(r.choice(["the", "of", "and", "tree", "house"]) + str(r.randrange(30)) for _ in range(80))) for i in range(60)]
    bad = [(100 + i, " ".join(r.choice(["win", "$$$", "click"]) + str(r.randrange(30)) for _ in range(80))) for i in range(20)]
    docs = make(spark, good + bad + [(200, None), (201, "")])
    trusted = spark.createDataFrame([(i,) for i in range(30)], "doc_id long")
    out = {x["doc_id"]: x for x in quality_rules.judge(spark, docs, trusted, orders=orders, buckets=512).collect()}
    assert all(out[i]["kept"] for i, _ in good) and not any(out[i]["kept"] for i, _ in bad)
    assert out[200]["base_failed"] and out[200]["llr"] == 0 and out[200]["n_words"] == 0
    assert quality_rules.judge(spark, docs, trusted, orders=orders, buckets=512).filter("kept").count() == 60  # a filter above stays cheap
    if orders == (1,):
        counts = {r["b"]: (r["raw"], r["target"]) for r in quality_rules.bucket_counts(docs, trusted, (1,), 512).collect()}
        n = sum(len((t or "").split()) for _, t in pairs(docs))
        assert sum(a for a, _ in counts.values()) == n and sum(b for _, b in counts.values()) == 30 * 80
    assert quality_rules.judge(spark, docs.limit(0), trusted.limit(0), orders=orders, buckets=512).count() == 0


def test_llr_by_brute_force(spark, nasty):
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    word = lambda w: signed(xxhash.xxh64_intdigest(w.encode(), 42))
    seeded = lambda h, seed: xxhash.xxh64_intdigest(struct.pack("<q", h), seed)
    trusted = spark.createDataFrame([(1,), (8,), (12,), (None,)], "doc_id long")

    def grams(t, n):
        h = [word(w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        return [x % n for x in h] + [signed(seeded(b, seeded(a, 42))) % n for a, b in zip(h, h[1:])]  # noqa: B905

    rows = pairs(nasty)
    total = sum(len(grams(t, 8)) for _, t in rows)
    n = 1024
    while n < quality_rules.BUCKETS and n * quality_rules.GRAMS < total:
        n *= 2
    raw = Counter(g for _, t in rows for g in grams(t, n))
    good = Counter(g for d, t in rows if d in (1, 8, 12) for g in grams(t, n))
    ratio = {}
    for b, r in raw.items():
        p = r / total
        ratio[b] = round(math.log((good[b] + quality_rules.PRIOR * n * p) / (sum(good.values()) + quality_rules.PRIOR * n) / p), 4)
    want = Counter((d, round(sum(map(ratio.get, g)) / len(g), 6) if g else 0.0) for d, t in rows for g in [grams(t, n)])
    got = quality_rules.judge(spark, nasty, trusted).collect()
    assert Counter((r["doc_id"], round(r["llr"], 6)) for r in got) == want
    assert all(r["kept"] == (not r["base_failed"] and r["llr"] >= quality_rules.THRESHOLD) for r in got)


def test_near_dedup(spark, nasty, nothing):
    got = near_dedup.near_duplicates(spark, nasty).collect()
    rows = pairs(nasty)
    fp = [near_dedup.fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min(label[j] for j in range(len(rows)) if (fp[i] ^ fp[j]).bit_count() <= 3) for i in range(len(rows))]
    comp = defaultdict(list)
    for i, k in enumerate(label):
        comp[k].append(rows[i][0])
    want = Counter((d, f"{fp[i]:016x}", min((x for x in comp[label[i]] if x is not None), default=None)) for i, (d, _) in enumerate(rows))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    assert near_dedup.near_duplicates(spark, nothing).count() == 0


def test_fingerprint_by_definition():
    import xxhash

    for t in ("", "One", "A b", "The cat sat on THE mat É"):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        assert near_dedup.fingerprint(t) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_golay_keys_meet():
    r = np.random.default_rng(3)
    a = r.integers(0, 2**63, 3000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in r.choice(64, r.integers(0, 4), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    t = near_dedup.golay_tables()
    assert t[2].sum() == 2048 + 8855 and t[2].min() == 1
    left, right = defaultdict(set), defaultdict(set)
    for at, key, out in (*((*x, left) for x in zip(*near_dedup.keys(a.view(np.int64), t, False), strict=True)), *((*x, right) for x in zip(*near_dedup.keys(b.view(np.int64), t, True), strict=True))):
        out[at].add(key)
    assert all(left[i] & right[i] for i in range(len(a)))


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_dedup(spark, nasty, nothing, bits):
    # three bits give many chunks a common key, so the digests decide
    got = exact_dedup.deduplicate(spark, nasty, bits=bits).collect()
    groups = defaultdict(list)
    for d, t in pairs(nasty):
        groups[re.sub(SPACE, "", t or "")].append((-len(t or ""), math.inf if d is None else d, d))
    want = Counter()
    for n, g in groups.items():
        keep = min(g, key=lambda x: x[:2])[2]
        for _, _, d in g:
            want[d, keep, len(g), hashlib.sha256(n.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    stay = Counter(r["text_sha256"] for r in got if r["kept"])
    assert len(stay) == len(groups) and set(stay.values()) == {1}  # one row a group, null and repeated ids too
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact_dedup.deduplicate(spark, nothing, bits=bits).count() == 0


def test_exact_dedup_ties(spark):
    rows = [(None, "a b"), (None, "a c"), (None, "a b"), (4, "ab "), (5, "a b"), (7, "x"), (7, "y"), (-(2**63), "z"), (1, "z")]
    got = exact_dedup.deduplicate(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["keep_id"]) for r in got if r["kept"]) == Counter([(4, 4), (None, None), (7, 7), (7, 7), (-(2**63), -(2**63))])


def test_chunks_follow_content(spark):
    r = random.Random(9)
    prose = "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(60_000))
    hanzi = "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(20_000))
    texts = [prose, prose[:20_000] + "inserted" + prose[20_000:], hanzi, "x" * 50_000, "", "é"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", exact_dedup.chunks_of(F.col("t")).alias("c"))
    c = {x["i"]: x["c"] for x in d.collect()}
    for i, t in enumerate(texts):
        assert "".join(c[i]).replace(" ", "").replace("\n", "") == t
        assert all(len(re.sub("[ \n]", "", x)) <= 128 * 128 for x in c[i]) and all(len(re.sub("[ \n]", "", x)) >= 8 * 25 for x in c[i][:-1])
    assert len(c[2]) > 3 and len(c[3]) > 2
    assert len(set(c[0]) ^ set(c[1])) <= 10 < len(c[0])  # an insertion changes the chunks around it only


def test_byte_bpe(spark, nasty, nothing):
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.load_ranks()
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((d, struct.pack(f"<{len(x)}I", *x), (t or "").encode()) for d, t in pairs(nasty) for x in [e.encode_ordinary(t or "")])
    got = byte_bpe.encode(spark, nasty, ranks).collect()
    assert Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in got) == want
    assert all(byte_bpe.decode(bytes(r["ids"]), ranks) == bytes(r["decoded"]) for r in got)
    small = byte_bpe.encode(spark, nasty.coalesce(1), ranks, block_chars=500).collect()  # many blocks
    assert Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in small) == want
    short = {r["doc_id"]: r for r in byte_bpe.encode(spark, nasty, ranks, digests=True).filter("doc_id is not null").collect()}
    for d, ids, text in want:
        if d is not None and d != 11:
            assert short[d]["ids_sha256"] == hashlib.sha256(ids).hexdigest() and short[d]["decoded_sha256"] == hashlib.sha256(text).hexdigest()
    assert byte_bpe.encode(spark, nothing, ranks).count() == 0


def test_byte_bpe_words_of_any_length(spark):
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.load_ranks()
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(3)
    words = ["x" * 5000, "".join(r.choice("abcdefé世") for _ in range(3000)), "".join(r.choice("-_=#*") for _ in range(5000))]
    rows = spark.createDataFrame([(i, w.encode()) for i, w in enumerate(words)], "i int, word binary")
    assert {x["i"]: x["ids"] for x in byte_bpe.fold_merges(rows, ranks).collect()} == {i: e.encode_ordinary(w) for i, w in enumerate(words)}
    words += ["y" * 20_000, "".join(r.choice("abcdefghijk") for _ in range(20_000))]
    assert [byte_bpe.merge_by_heap(w.encode(), ranks) for w in words] == [e.encode_ordinary(w) for w in words]
    got = byte_bpe.encode(spark, make(spark, list(enumerate(words))), ranks).collect()
    assert {x["doc_id"]: bytes(x["ids"]) for x in got} == {i: struct.pack(f"<{len(v)}I", *v) for i, w in enumerate(words) for v in [e.encode_ordinary(w)]}


def test_packing(spark, nasty, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(spark, nasty).collect()
    assert all((r["offset"] + r["length"]) <= 2048 and r["length"] > 0 for r in got)
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(seqs) == list(range(len(seqs)))
    fills = []
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        fills.append(at)
    assert all(f == 2048 or f & (f - 1) == 0 for f in fills)
    want, have = Counter(), Counter()
    for d, x in pairs(nasty):
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        want.update((d, len(ids), i) for i in range(len(ids)))
    texts = defaultdict(set)
    for d, x in pairs(nasty):
        texts[d].add(tuple(t.encode(x or "", add_special_tokens=False).ids + [1]))
    for r in got:
        have.update((r["doc_id"], r["doc_tokens"], i) for i in range(r["start"], r["start"] + r["length"]))
        crc = {zlib.crc32(struct.pack(f"<{r['length']}I", *x[r["start"] : r["start"] + r["length"]])) for x in texts[r["doc_id"]] if len(x) == r["doc_tokens"]}
        assert r["ids_crc32"] in crc
    assert have == want
    assert packing.pack(spark, nothing).count() == 0


@pytest.mark.parametrize("lengths", [[1500] * 100, [2047] * 7, [1], [1000, 1048, 3, 2045], list(range(1, 400)), [683] * 50 + [7] * 9, []])
def test_plan_places_every_id_once(lengths):
    rows = packing.plan(dict(Counter(lengths)))
    used, seqs = Counter(), defaultdict(Counter)
    for length, a, b, sub, n, seq, offset in rows:
        for k in range(a, b):
            for i in range(n):
                used[length, k, sub + i] += 1
                seqs[seq + k - a][offset + i] += 1
    assert used == Counter((x, k, i) for x, c in Counter(lengths).items() for k in range(c) for i in range(x))
    for s in seqs.values():
        assert set(s) == set(range(len(s))) and max(s.values()) == 1 and (len(s) == 2048 or len(s) & (len(s) - 1) == 0)


def test_best_fill_is_closest():
    from itertools import product

    r = random.Random(2)
    for _ in range(60):
        counts = {r.randrange(1, 30): r.randrange(1, 4) for _ in range(4)}
        used = packing.best_fill(counts, 40)
        longest = max(counts)
        best = max(s for c in product(*(range(n + 1) for n in counts.values())) for s in [sum(a * b for a, b in zip(c, counts, strict=True))] if s <= 40 and dict(zip(counts, c, strict=True))[longest])
        assert sum(k * n for k, n in used.items()) == best and used[longest] >= 1 and all(used[k] <= counts[k] for k in used)


def test_ranks_stand_for_the_definition():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    definition = open(path, encoding="utf-8").read()
    ranks = packing.byte_ranks(definition)
    t = Tokenizer.from_file(path)
    fast, slow = packing.Encoder(definition, ranks), packing.Encoder(definition, None)
    r = random.Random(6)
    texts = ["".join(r.choice("abcdeéñ世🙂-_#0123 \t\n'.,TheNSZ") for _ in range(200)) for _ in range(400)] + ["", "<|endoftext|>", "x <|endoftext|> y", "a<|endoftext|><|endoftext|>b"]
    assert fast(texts) == slow(texts) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert packing.byte_ranks(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()) is None


def test_license_scan(spark, nasty, nothing):
    lower = str.maketrans(license_scan.UPPER, license_scan.LOWER)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    gpl = "This work -- is LICENSED under the GNU General Public\tLicense, version 3 (copy)"
    extra = [(50, "under the MIT license under the mit license\nx"), (51, gpl), (52, "cc by nc cc by nc"), (53, "licensed under the\napache license version 2"), (54, "M\u212aT license under the \u212amit license")]
    docs = make(spark, [*pairs(nasty), *extra])

    def brute(t):
        w = word.findall((t or "").translate(lower))
        at = [(i, label) for p, label in license_scan.PHRASES for p in [p.split()] for i in range(len(w)) if w[i : i + len(p)] == p]
        labels, best = {x for _, x in at}, 0.0
        for line in (t or "").translate(lower).split("\n"):
            s = set(word.findall(line))
            for label, x in license_scan.TEMPLATES:
                x = set(x.split())
                if len(s & x) >= math.ceil(0.8 * len(x) - 1e-9):
                    labels.add(label)
                    best = max(best, len(s & x) / len(x))
        places = [i for i, _ in at]
        base = ",".join(sorted({x for _, x in at}))
        return len(w), len(at), min(places, default=None), max(places, default=None), base, ",".join(sorted(labels)), 1.0 if at else best

    cols = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    got = license_scan.scan(spark, docs).collect()
    assert Counter((r["doc_id"], *(r[c] for c in cols)) for r in got) == Counter((d, *brute(t)) for d, t in pairs(docs))
    assert license_scan.scan(spark, nothing).count() == 0


def labelled_texts(seed, n):
    r = random.Random(seed)
    plain = [f"{a}{b}" for a in ("ra", "li", "mo", "se") for b in ("ton", "ver", "la", "pi", "dun")]
    out = []
    for i in range(n):
        s = [" ".join(r.choice(plain) for _ in range(8)) for _ in range(r.randrange(2, 8))]
        bad = i % 5 == 0
        if bad:
            s[r.randrange(len(s))] += r.choice([" vilest", " vilely", " scabrous"])
        out.append((". ".join(s) + ".", int(bad)))
    return out


def test_toxicity(spark, nasty, nothing):
    model = toxicity.train(labelled_texts(1, 400))
    fresh = labelled_texts(2, 200)
    docs = make(spark, [(i, t) for i, (t, _) in enumerate(fresh)])
    out = {r["doc_id"]: r for r in toxicity.score(spark, docs, model).collect()}
    assert sum((out[i]["score"] >= 0.3) == y for i, (_, y) in enumerate(fresh)) >= 196
    for i, (_, y) in enumerate(fresh):
        if y and out[i]["offending"]:
            assert any(re.search("vil|scab", s["text"]) for s in out[i]["offending"])
    odd = toxicity.score(spark, nasty, model).collect()
    assert len(odd) == nasty.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert abs(next(r["score"] for r in odd if r["doc_id"] == 3) - model["leak"]) < 1e-9
    assert toxicity.score(spark, nothing, model).count() == 0
    assert toxicity.train([("a b", 0)])["weights"] == {}


def test_quality_classifier(spark, nasty, nothing):
    r = random.Random(5)
    plain = [f"{a}{b}" for a in ("ra", "li", "mo", "se") for b in ("ton", "ver", "la", "pi", "dun")]
    rows = [(i, " ".join(w.upper() + "!!" if i % 4 == 0 else w for w in (r.choice(plain) for _ in range(r.randrange(5, 60))))) for i in range(400)]
    docs = make(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(200)], "doc_id long, y int")
    model = quality_classifier.fit(docs, labels)
    out = {x["doc_id"]: x["score"] for x in quality_classifier.score(spark, docs, model, ["doc_id"]).collect()}
    assert sum((out[i] >= 0.7) == (i % 4 != 0) for i in range(200, 400)) >= 196
    assert 0.2 < model["net"]["temperature"] < 9
    odd = quality_classifier.score(spark, nasty.drop("score"), model).collect()
    assert len(odd) == nasty.count() and all(0 <= x["score"] <= 1 for x in odd)
    assert quality_classifier.score(spark, nothing, model, ["doc_id"]).count() == 0
    none = quality_classifier.fit(nothing, labels)
    assert {x["score"] for x in quality_classifier.score(spark, nasty, none, ["doc_id"]).collect()} == {0.5}


def test_contexts_by_definition(spark):
    docs = make(spark, [(1, "a b c"), (2, "b a"), (3, None)])
    slots = quality_classifier.Slots()
    places, signs = quality_classifier.index_vectors()
    want = np.zeros((quality_classifier.SLOTS, quality_classifier.WIDTH))
    for t in ("a b c", "b a"):
        ids = [slots[w] for w in t.split()]
        for i, x in enumerate(ids):
            for j, y in enumerate(ids):
                if i != j and abs(i - j) <= quality_classifier.WINDOW:
                    np.add.at(want[x], places[y], signs[y])
    got = np.zeros_like(want)
    for r in quality_classifier.contexts(docs).collect():
        got[r["slot"]] = r[1:]
    assert (got == want).all()
