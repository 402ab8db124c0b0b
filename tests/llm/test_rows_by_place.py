"""Rows named by their place in files, and dropped by it."""

import pytest
from pyspark.sql import functions as F

from quillspark.llm import common


@pytest.mark.parametrize("few", [0, 100])
@pytest.mark.parametrize("from_files", [True, False])
def test_rows_go_by_their_place(spark, tmp_path, few, from_files):
    made = spark.range(60).select((F.col("id") % 7).alias("doc_id"), F.lit("x").alias("file_key"), F.when(F.col("id") % 2 == 0, "same").alias("text"))
    made.repartition(5).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    docs = docs if from_files else docs.filter("doc_id >= 0")
    named, key = common.identified(spark, docs)
    assert key[0] == "file_key_" and named.select(*key).distinct().count() == 60
    left = common.without(spark, named, named.filter("doc_id = 3 and text is null").select(*key), key, few=few)
    assert left.columns == docs.columns and left.count() == 60 - docs.filter("doc_id = 3 and text is null").count()
    assert left.filter("doc_id = 3 and text is null").count() == 0
    assert common.without(spark, named, named.limit(0).select(*key), key, few=few).count() == 60


def test_spent_tables_are_gone(spark):
    t = common.written(spark, spark.range(3), "x")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(t.scratch)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert fs.exists(path) and t.count() == 3
    common.spent(spark, t)
    assert not fs.exists(path)
