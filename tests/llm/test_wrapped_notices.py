import textwrap

from quillspark.llm import license_scan


def test_wrapped_notices_are_found(spark, tmp_path):
    rows, want = [], {}
    for i, (label, text) in enumerate(license_scan.TEMPLATES):
        for k, (width, mark) in enumerate([(24, "# "), (36, " * "), (70, "// ")]):
            body = "\n".join(mark + line for line in textwrap.wrap(text.capitalize() + ".", width))
            rows.append((10 * i + k, "Some file.\n\n" + body + "\n\nint main() {}"))
            want[10 * i + k] = label
    mit = dict(license_scan.TEMPLATES)["mit-notice"].split()
    # the words stand too far apart for any span, and on lines of their own
    rows += [(900, " x\n x x x\n".join(mit)), (901, "\n".join(mit[:8])), (902, None), (None, "\n".join(mit)), (903, " ".join(mit))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in license_scan.op8(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for d, label in want.items():
        assert label in got[d]["labels"].split(",") and got[d]["score"] == 1.0 and got[d]["n_blocks"] >= 1
    for d, labels, n in ((900, "", 0), (901, "", 0), (902, "", 0), (None, "mit-notice", 1), (903, "mit-notice", 1)):
        assert (got[d]["labels"], got[d]["n_blocks"]) == (labels, n)


def test_position_filter_drops_pairs_but_no_match(spark):
    import random

    r = random.Random(8)
    words = sorted({w for _, t in license_scan.TEMPLATES for w in t.split()})
    lines = [" ".join(r.sample(words, r.randrange(4, 20))) for _ in range(300)]
    lines += [" ".join(r.sample(t.split(), len(t.split()))) for _, t in license_scan.TEMPLATES]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    pairs = license_scan.prefix_pairs(spark, docs)
    n, kept = pairs.count(), pairs.filter(license_scan.may_match()).count()
    assert 0 < kept < n
    got = {(x["doc_id"], x["label"]) for x in license_scan.matches(spark, docs).collect()}
    want = {(i, label) for i, x in enumerate(lines) for label, t in license_scan.TEMPLATES if len(set(x.split()) & set(t.split())) >= 0.8 * len(set(t.split()))}
    assert got == want and len(want) >= len(license_scan.TEMPLATES)
