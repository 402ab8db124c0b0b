import hashlib
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import common, components, url_filter, warc

from .conftest import make


def pages(spark, rows):
    return spark.createDataFrame([(*r, "w") for r in rows], "page_id long, url string, html string, score string")


def test_url_rules(spark):
    urls = ["http://Example.COM/en/x?q#f", "https://www.example.com/en/", "https://a.www.example.com/en/p", "http://notexample.com/en/", "net", "x://h.net/es/1", "x://net/fr/", "x://h.net/de/", "", None, "a://b://c/d", "http://com", "http://example.com?x=/en/", "x://É.COM/\nz"]
    got = url_filter.ruled(pages(spark, [(i, u, "") for i, u in enumerate(urls)])).collect()
    for r in got:
        u = r["url"] or ""
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u)
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
        path = m[2] if m else ""
        fit = [(a + b, v) for a, b, v in url_filter.RULES if (host == a or host.endswith("." + a)) and path.startswith(b)]
        rule, ruling = max(fit, key=lambda x: len(x[0])) if fit else (None, None)
        assert (r["host"], r["path"], r["rule"], r["ruling"]) == (host, path, rule, ruling)


def test_url_model(spark):
    rng = np.random.default_rng(1)
    word = lambda a: "".join(rng.choice(list(a), 8))
    rows = [(i, f"http://{word('aeiou')}.com/{word('rst')}", "") for i in range(300)] + [(300 + i, f"http://{word('xzqk')}.net/es/{word('0123')}", "") for i in range(300)]
    fresh = [(900 + i, f"http://{word('aeiou')}.org/{word('rst')}", "") for i in range(40)] + [(950 + i, f"http://{word('xzqk')}.org/{word('0123')}", "") for i in range(40)]
    odd = [(2000, None, None), (2001, "", ""), (None, "x", "")]
    df = pages(spark, rows + fresh + odd)
    out = {r["page_id"]: r for r in url_filter.judge(spark, df).collect()}
    assert sum(out[p]["verdict"] == ("allow" if p < 950 else "block") for p, _, _ in fresh) >= 78
    assert out[2000]["score"] == 0 and out[2000]["host"] == "" and len(out) == len(rows) + len(fresh) + 3
    assert url_filter.judge(spark, df.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(spark, pages(spark, fresh)).collect()} == {"allow"}


@pytest.mark.parametrize("max_grams", [url_filter.MAX_GRAMS, 40])
def test_url_model_by_brute_force(spark, max_grams):
    good, bad = ["http://ab.com/", "é\U0001F642x", "", "http://abc.com/ab"], ["http://q.net/es/11", "", "x://q.net/"]
    rows = [(u, 0) for u in good] + [(u, 1) for u in bad]
    model = url_filter.fitted(spark, spark.createDataFrame(rows, "url string, y int"), max_grams)
    n = [Counter(), Counter()]
    for u, y in rows:
        padded = "\0\0\0" + u
        n[y].update((k, padded[i + 3 - k : i + 3], c) for i, c in enumerate(u) for k in range(4))
    total = [Counter(), Counter()]
    for y in (0, 1):
        for (k, c, _), v in n[y].items():
            total[y][k, c] += v
    every = total[0] + total[1]
    size = lambda least: len({g for y in (0, 1) for g in n[y] if every[g[:2]] >= least})
    least = 1
    while size(least) > max_grams and least * 2 <= max(every.values()):
        least *= 2
    assert (least > 1) == (max_grams == 40) and sum(len(o[0]) for o in model.orders) == size(least)
    ask = ["http://ab.com/", "http://q.org/ab", "zz", "\U0001F600é", ""]
    got, length = url_filter.log_likelihoods(ask, model)
    for i, u in enumerate(ask):
        for y in (0, 1):
            ll, padded = 0.0, "\0\0\0" + u
            for j, c in enumerate(u):
                p = 1 / 65536
                for k in range(4):
                    h = k, padded[j + 3 - k : j + 3]
                    h = k, "".join(x if x < "\uffff" else "\U0001F642" for x in h[1])
                    c2 = c if c < "\uffff" else "\U0001F642"
                    if every[h] >= least and total[y][h]:
                        t = len({x for x in n[y] if x[:2] == h})
                        p = (n[y][(*h, c2)] + t * p) / (total[y][h] + t)
                ll += np.log(p)
            assert abs(got[y, i] - ll) < 1e-9 and length[i] == len(u)


def test_cut_off_by_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(30):
        bins = [(int(b), y, 1) for y in (0, 1) for b in rng.integers(-8, 8, 6) - 5 * y]
        cut = round(url_filter.least_error(bins) / url_filter.BIN)
        error = lambda at: sum(y == 0 and b < at for b, y, _ in bins) + sum(y == 1 and b >= at for b, y, _ in bins)  # noqa: E731, B023
        assert error(cut) == min(map(error, range(-20, 20)))
    assert url_filter.least_error([(3, 0, 5)]) == 0.0


def test_warc(spark, tmp_path):
    big, other = "<p>" + "é" * 700, "x" * 999
    rows = [(1, "http://a/", big), (2, None, big), (3, "u\r\nv", big), (4, "b", other), (5, "b", other), (6, "c", None), (7, "", ""), (None, "n", big), (8, "r", "y" * 5000), (8, "r", "y" * 5000), (9, "z", "z\r\n\r\nWARC/1.1\r\n" * 90000)]
    df = pages(spark, rows)
    by_shuffle = warc.read(warc.write(spark, warc.roles(df, few=0))).collect()
    index = warc.write(spark, warc.roles(df), f"file://{tmp_path}/w", bundle_bytes=2000)
    got = warc.read(index, payloads=True).collect()
    assert Counter(map(tuple, by_shuffle)) == Counter(tuple(r)[:5] for r in got)
    want = Counter()
    for p, _, h in rows:
        b = (h or "").encode()
        same = [q for q, _, x in rows if (x or "") == (h or "") and q is not None]
        to = max(same) if len(b) >= 1000 and same and len([1 for _, _, x in rows if x == h]) > 1 and p != max(same) else None
        want[p, len(b), hashlib.sha1(b).hexdigest(), "response" if to is None else "revisit", to] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    assert all(bytes(r["payload"]) == (b"" if r["record_type"] == "revisit" else next((h or "").encode() for p, _, h in rows if p == r["page_id"])) for r in got)
    assert warc.read(warc.write(spark, warc.roles(df.limit(0)))).count() == 0
    # any reader of plain Zstandard sees the records one after the other
    import zstandard

    for r in index.collect():
        raw = open(r["bundle"].removeprefix("file://"), "rb").read()
        plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
        assert plain.count(b"WARC-Record-ID") == len(r["page_ids"]) and len(warc.seek_table(raw, len(raw))) == max(r["frames"]) + 1


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(5, 5), (3, 2), (2, 9), (8, 7), (7, 8)]])
def test_components(spark, edges):
    got = {r["node"]: r["root"] for r in components.connected(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges if e[0] != e[1] for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}


def test_shared_dir(spark):
    assert common.shared_dir(spark).startswith("file:") or "://" in common.shared_dir(spark) or common.shared_dir(spark).startswith("/")


def test_pipeline_stages(spark, nasty, nothing, tmp_path):
    import corpus_pipeline as c

    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    names = [n for n, _ in c.STAGES]
    assert names == ["quality_classifier", "quality_rules", "exact_dedup", "near_dedup", "packing"]
    docs = nasty.drop("score", "row")
    want = {"exact_dedup": 16, "near_dedup": None}
    for name, stage in c.STAGES:
        for src in (docs, docs.limit(0)):
            out = stage(spark, src, str(tmp_path))
            n = out.count()
            assert name == "packing" or out.columns == src.columns
            assert n == 0 if src is not docs else n >= (0 if name in ("quality_classifier", "quality_rules") else 1)
        if name == "exact_dedup":
            texts = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in stage(spark, docs, str(tmp_path)).collect()]
            assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in docs.collect()})
        if name == "near_dedup":
            from quillspark.llm import near_dedup

            fps = [near_dedup.fingerprint(r["text"]) for r in stage(spark, docs, str(tmp_path)).collect()]
            assert all((a ^ b).bit_count() > 3 for i, a in enumerate(fps) for b in fps[:i]) and len(want) == 2


def test_dedup_stages_by_brute_force(spark, nasty, tmp_path):
    import corpus_pipeline as c
    from quillspark.llm import near_dedup

    odd = "wid", "wkey", "_n", "_key", "_sha", "file_key", "carry0", "th", "fp", "root", "text_"
    docs = nasty.select("doc_id", "text", *(F.col("w").alias(x) for x in odd))
    docs.write.parquet(str(tmp_path / "d"))
    for src in (docs, spark.read.parquet(str(tmp_path / "d"))):
        once = c.distinct(spark, src, str(tmp_path))
        assert once.columns == src.columns and once.filter("wid = 'w' and _sha = 'w' and file_key = 'w'").count() == once.count()
        got = sorted(((r["doc_id"] is None, r["doc_id"], r["text"] or "") for r in once.collect()), key=str)
        groups = {}
        for r in src.collect():
            t = r["text"] or ""
            groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), r["doc_id"] is None, r["doc_id"], t))
        assert got == sorted(((x[1], x[2], x[3]) for x in (min(g, key=lambda x: (x[0], x[1], x[2] or 0)) for g in groups.values())), key=str)
        left = c.unlike(spark, src, str(tmp_path))
        rows = [(r["doc_id"], r["text"] or "") for r in src.collect()]
        fp, sets = [near_dedup.fingerprint(t) for _, t in rows], [set(near_dedup.shingles(t).tolist()) for _, t in rows]
        label = list(range(len(rows)))
        for _ in rows:
            near = lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 3 or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            label = [min(label[j] for j in range(len(rows)) if near(i, j)) for i in range(len(rows))]
        want = Counter()
        for k in set(label):
            want[min((rows[i][0] for i in range(len(rows)) if label[i] == k and rows[i][0] is not None), default=None)] += 1
        assert Counter(r["doc_id"] for r in left.collect()) == want and left.columns == src.columns


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data here")
def test_run(spark):
    import corpus_pipeline as c

    out = c.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and make is not None
