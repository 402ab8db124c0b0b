"""Memory that Python workers take and keep: an executor's limit covers them too."""

import subprocess
import sys
import tracemalloc
from pathlib import Path

import pyarrow as pa
import pytest

from quillspark.llm import packing, quality_classifier

KEPT = """
import re
from quillspark.llm.common import sliced
def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
blocks = [bytes(3000) for _ in range(60_000)]
last = blocks[-1]  # at the end of the heap, so that nothing goes back by itself
most = held()
del blocks
list(sliced([]))
print(most - held())
"""


class Captured:
    """Stands in for a table, and keeps the function that its partitions would go through."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.run = run
        return self

    def groupBy(self, *_):
        return self

    def agg(self, *_):
        return self


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="needs Linux's figures")
def test_a_task_hands_back_what_the_worker_no_longer_uses():
    done = subprocess.run([sys.executable, "-c", KEPT], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert float(done.stdout) > 100  # MB, of 170


def test_counting_contexts_takes_little_memory(spark):
    docs = Captured()
    quality_classifier.contexts(docs)
    words = [f"w{i}" for i in range(300_000)]
    texts = [" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)] * 4
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in docs.run(iter([batch])))
        most = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert rows == quality_classifier.SLOTS
    assert most < 60  # MB


def test_contexts_are_the_same_in_parts(spark, monkeypatch):
    docs = Captured()
    quality_classifier.contexts(docs)
    batch = pa.RecordBatch.from_arrays([pa.array(["a b c a b", None, "x", "c b a " * 50, "d e"])], ["text"])
    whole = list(docs.run(iter([batch])))
    monkeypatch.setattr(quality_classifier, "BATCH", 3)
    monkeypatch.setattr(quality_classifier, "CACHE", 2)
    assert list(docs.run(iter([batch]))) == whole


def test_packing_starts_no_other_python_workers(spark, nasty, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("a list of rows goes through Python workers of another kind")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    placed = packing.pack(spark, nasty).groupBy("doc_id").count()
    assert placed.count() == nasty.select("doc_id").distinct().count()
