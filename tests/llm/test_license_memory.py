"""What the license scan holds in executors: the spans of long texts, and no Python workers."""

import math
import random
import subprocess
import sys
from pathlib import Path

import pytest

from quillspark.llm import license_scan

WORDS = sorted({w for _, t in license_scan.TEMPLATES for w in t.split()})
LONG = """
import random, sys
from pyspark.sql import SparkSession
from quillspark.llm import license_scan
spark = (
    SparkSession.builder.master("local[1]").config("spark.driver.memory", "600m").config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "1").config("spark.local.dir", sys.argv[1]).getOrCreate()
)
r = random.Random(1)
words = sorted({w for _, t in license_scan.TEMPLATES for w in t.split()})
rows = [(1, " ".join(r.choices(words, k=400_000))), (2, license_scan.TEMPLATES[0][1].replace(" ", "\\n"))]
spark.createDataFrame(rows, "doc_id long, text string").write.parquet(sys.argv[1] + "/documents.parquet")
got = {x["doc_id"]: x for x in license_scan.op8(spark, sys.argv[1]).collect()}
assert got[1]["n_words"] == 400_000 and got[2]["labels"] == "mit-notice"
print("done")
"""


def test_a_long_text_takes_little_memory(tmp_path):
    done = subprocess.run([sys.executable, "-c", LONG, str(tmp_path)], capture_output=True, text=True, cwd=Path(__file__).parents[2])
    assert done.stdout.endswith("done\n"), done.stderr[-2000:]


@pytest.mark.parametrize("stretch", [1, 7, 512])
def test_spans_are_those_of_brute_force(spark, monkeypatch, stretch):
    monkeypatch.setattr(license_scan, "STRETCH", stretch)
    r = random.Random(stretch)
    texts = [r.choices([*WORDS, "x"], k=r.randrange(0, 120)) for _ in range(30)]
    for _, t in license_scan.TEMPLATES:
        for before in (0, 1, 6, 7, 13, 480, 511, 512, 530):
            notice = t.split()
            for _ in range(3):
                notice.insert(r.randrange(len(notice)), "x")
            texts.append(["x"] * before + notice + ["x"] * r.randrange(3))
    docs = spark.createDataFrame([(i, "\n".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    want = {}
    for i, x in enumerate(texts):
        for label, t in license_scan.TEMPLATES:
            words, n = set(t.split()), math.ceil(len(t.split()) / license_scan.SHARE - 1e-9)
            best = max(len(words.intersection(x[k : k + n])) for k in range(max(len(x) - n, 0) + 1))
            if best >= math.ceil(license_scan.SHARE * len(words) - 1e-9):
                want[i, label] = best / len(words)
    got = [((g["doc_id"], g["label"]), g["containment"]) for g in license_scan.spans(spark, docs).collect()]
    assert len(got) == len(want) and dict(got) == want and len(want) > 60


def test_scan_starts_no_python_workers_and_counts_words_once(spark, nasty, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("a list of rows goes through Python workers")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    counted = []
    count = license_scan.frequencies
    monkeypatch.setattr(license_scan, "frequencies", lambda *a: counted.append(1) or count(*a))
    assert license_scan.scan(spark, nasty, wrapped=True).count() == nasty.count()
    assert len(counted) == 1
