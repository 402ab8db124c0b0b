import pytest

from quillspark.llm import quality_rules

from .conftest import make


@pytest.mark.parametrize("block_ids", [None, 7])
def test_every_trusted_document_is_counted(spark, block_ids):
    n = 50_400 if block_ids is None else 40
    docs = make(spark, [(i, f"w{i % 5} common") for i in range(n)])
    trusted = spark.range(n).toDF("doc_id")
    more = {} if block_ids is None else {"block_ids": block_ids}
    got = quality_rules.bucket_counts(docs, trusted, buckets=512, **more).collect()
    assert sum(r["raw"] for r in got) == 3 * n and all(r["raw"] == r["target"] for r in got)
