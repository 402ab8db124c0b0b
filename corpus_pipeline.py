"""The corpus pipeline: STAGES in order, each reading what the one before it wrote.

quality classifier -> quality rules -> exact dedup -> SimHash near-dedup -> packing. Every stage
takes (spark, docs, sf_dir); all but the last return the columns of documents, and any others that
the rows have, whatever their names. A row with a null text counts as empty; repeated rows are
duplicates and one of them stays, ties going to the smallest id, then to the first row; very long
texts take part whole; an empty table passes through as an empty one.

The two dedup stages decide over digests and drop rows by their place in the input's files, so texts
move through no window and, unless very many rows go, through no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import exact_dedup, near_dedup, packing, quality_classifier, quality_rules
from quillspark.llm.common import fresh, identified, labelled, table, without, written

#: A document stays if its probability of good quality is at least this.
LEAST_QUALITY = 0.7
#: Texts whose sets of five-word shingles are this similar (Jaccard) are near duplicates.
SIMILARITY = 0.8


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality_classifier.fit(docs, labelled(spark, sf_dir, "quality"))
    name = fresh(docs.columns, "quality")
    scored = quality_classifier.score(spark, docs, model, name=name)
    return scored.filter(F.col(name) >= LEAST_QUALITY).drop(name)


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    trusted = labelled(spark, sf_dir, "quality").filter("y = 1")
    return quality_rules.judge(spark, docs, trusted).filter("kept").select("row.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts: the longest as written, then that of the smallest id."""
    docs, key = identified(spark, docs)
    found = exact_dedup.deduplicate(spark, docs, carry=tuple(key))
    return without(spark, docs, found.filter("not kept"), key)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of near duplicates.

    Near duplicates are texts within three bits of SimHash, or of SIMILARITY or more.
    """
    docs, key = identified(spark, docs)
    found = near_dedup.near_duplicates(spark, docs, similarity=SIMILARITY, carry=tuple(key))
    found = written(spark, found.select("doc_id", "root", *key), "components")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *key)
    first = found.groupBy("root").agg(F.min(order).alias("o")).select(*(F.col("o")[k].alias(k) for k in key))
    return without(spark, docs, found.select(*key).join(first, key, "left_anti"), key)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document's token ids in windows."""
    return packing.pack(spark, docs)


STAGES = [
    ("quality_classifier", classified),
    ("quality_rules", ruled),
    ("exact_dedup", distinct),
    ("near_dedup", unlike),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), name)
    return docs


#: The classifier and the packing have no counterpart in SQL.
ORACLE_SQL = None
