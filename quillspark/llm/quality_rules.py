"""Quality rules: base counts of each text, and a hashed n-gram log-likelihood ratio (native).

Two multinomials over hashed word n-grams are counted over the whole corpus: one of the raw
documents, one of the trusted ones. A document's score is its mean log ratio of the two, per
n-gram, and it is kept if the base rules pass and the score reaches a fixed threshold.

Defined cases: a null text has no words; a text without n-grams scores 0; null ids are kept and
never trusted; repeated rows are each scored (and each counted); an empty table gives an empty
result; columns of the input other than the id and the text, whatever their names, are ignored; very
long texts are counted whole; a score equal to the threshold is kept.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import labelled, spent, table, written

SPACE = r"[\x20\x09-\x0D]+"
#: Buckets of the counts. The model folds them to a power of two that is at least the n-grams by GRAMS
#: (up to all of them), so that its table grows with the corpus and yet has a bound.
BUCKETS, LEAST_BUCKETS, GRAMS = 1 << 17, 1 << 10, 64
#: Pseudo-counts a bucket that draw the trusted model towards the raw one.
PRIOR = 2.0
#: Chosen on training labels, by which it parts good and bad documents best.
THRESHOLD = -0.08
#: n-grams are words and pairs of words.
ORDERS = (1, 2)
#: Trusted ids that one pass broadcasts; more of them take more passes, none is left out.
BLOCK_IDS = 1_000_000


def _words(text: str) -> str:
    """SQL for the words of a column: split at white space, without the empty ends."""
    s = f"split(coalesce({text}, ''), '{SPACE.replace(chr(92), chr(92) * 2)}')"
    return s


def _quoted(name: str):
    return F.col(f"`{name}`")


def with_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, row, w): the words of every whole text; row is the input's row, for who wants it."""
    parts = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"), F.struct(*map(_quoted, docs.columns)).alias("row")
    )
    parts = parts.withColumn("p", F.expr(_words("text")))
    head = F.when(F.get("p", F.lit(0)) == "", 1).otherwise(0)
    tail = F.when((F.size("p") > 1) & (F.element_at("p", -1) == ""), 1).otherwise(0)
    return parts.select("doc_id", "text", "row", F.slice("p", head + 1, F.size("p") - head - tail).alias("w"))


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts of the base rules, h (the words' hashes) and row, for every row.

    Windows of three words are compared by chained 64-bit hashes inside one document.
    """
    w = with_words(docs, id_col, text_col)
    h = w.select(
        "doc_id",
        "row",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    g = h.select(
        "*",
        F.transform(
            F.slice("h", F.lit(1), F.greatest(F.size("h") - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get("h", i + 1), F.get("h", i + 2)),
        ).alias("g"),
    )
    d = g.select("*", F.size(F.array_distinct("g")).alias("k"))
    # only texts with a repeated window pay for the sort
    runs = F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
    d = d.withColumn("r", F.when(F.col("k") < F.size("g"), runs))
    again = F.filter(
        F.transform(
            "r",
            lambda x, j: F.when(
                (x["g"] == F.get("r", j - 1)["g"]) | (x["g"] == F.get("r", j + 1)["g"]), x["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(again, lambda i: F.array(i, i + 1, i + 2)))))
    return d.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("r").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"),
        "h",
        "row",
    )


def _gram(h: str, n: int, buckets: int):
    """Bucket of the n words whose hashes start at a place of column h."""

    def at(x, i):
        return F.pmod(F.xxhash64(x, *(F.get(h, i + k) for k in range(1, n))), F.lit(buckets)).cast("int")

    return at


def _buckets(h: str, orders: tuple[int, ...], buckets: int):
    """Array of bucket numbers of the n-grams of a column of word hashes."""
    parts = []
    for n in orders:
        if n == 1:
            parts.append(F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int")))
        else:
            heads = F.slice(h, F.lit(1), F.greatest(F.size(h) - (n - 1), F.lit(0)))
            parts.append(F.transform(heads, _gram(h, n, buckets)))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def bucket_counts(
    docs: DataFrame, trusted: DataFrame, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS, block_ids: int = BLOCK_IDS
) -> DataFrame:
    """(b, raw, target): counts of every n-gram bucket over all documents and over the trusted ones.

    ``trusted`` holds doc_id; both sides cover every document. The trusted ids are dealt by hash
    into blocks of about ``block_ids``, each counted in a pass of its own. The result has
    ``buckets`` rows at most, and each task adds its rows up before the shuffle.
    """
    ids = trusted.select("doc_id").filter("doc_id is not null").distinct()
    blocks = max(1, math.ceil(ids.count() / block_ids))

    def grams(d: DataFrame, *keep: str) -> DataFrame:
        if orders == (1,):
            g = d.select(F.explode(F.expr(_words("text"))).alias("x"), *keep).filter("x <> ''")
            return g.select(F.pmod(F.xxhash64("x"), F.lit(buckets)).cast("int").alias("b"), *keep)
        w = d.select(F.filter(F.expr(_words("text")), lambda x: x != "").alias("w"), *keep)
        h = w.select(F.transform("w", lambda x: F.xxhash64(x)).alias("h"), *keep)
        return h.select(F.explode(_buckets("h", orders, buckets)).alias("b"), *keep)

    # the blocks' bound makes each broadcast safe; no text is shuffled. The first pass counts both sides
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks))
    marked = docs.select("doc_id", "text").join(F.broadcast(ids.filter(block == 0).select(F.col("doc_id").alias("good"))), F.col("doc_id") == F.col("good"), "left")
    first = grams(marked.withColumn("trusted", F.col("good").isNotNull()), "trusted")
    counted = first.groupBy("b").agg(F.count("*").alias("raw"), F.count_if("trusted").alias("target"))
    for k in range(1, blocks):
        part = grams(docs.join(F.broadcast(ids.filter(block == k)), "doc_id", "left_semi").select("text"))
        counted = counted.unionAll(part.groupBy("b").agg(F.lit(0).cast("long").alias("raw"), F.count("*").alias("target")))
    return counted.groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")) if blocks > 1 else counted


def ratio_list(spark: SparkSession, counts: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> tuple[str, int]:
    """log p_target/p_raw of as many buckets as the corpus fills, as one JSON list, and their number.

    The target is smoothed towards the raw distribution; empty buckets have 0. Computed by Spark, so the
    driver gets one text of ``buckets`` short numbers at most.
    """
    counts = written(spark, counts, "buckets")
    r = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0))).first()
    n = LEAST_BUCKETS
    while n < buckets and n * GRAMS < r[0]:
        n *= 2
    n = min(n, buckets)
    each = counts.groupBy(F.pmod("b", F.lit(n)).cast("long").alias("id")).agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    p = F.col("raw") / F.lit(float(max(r[0], 1)))
    q = (F.col("target") + F.lit(prior * n) * p) / F.lit(float(r[1] + prior * n))
    dense = spark.range(n).join(each, "id", "left").select("id", F.coalesce(F.round(F.log(q / p), 4), F.lit(0.0)).alias("x"))
    row = dense.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("id", "x"))), lambda e: e["x"])).alias("l")).first()
    spent(spark, counts)
    return row["l"], n


def judge(
    spark: SparkSession,
    docs: DataFrame,
    trusted: DataFrame,
    orders: tuple[int, ...] = ORDERS,
    buckets: int = BUCKETS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Base counts, verdict, llr score and row (the input's) of every row of ``docs`` (doc_id, text)."""
    # bounded by ``buckets``, whatever the corpus: a literal array of as many doubles
    listed, buckets = ratio_list(spark, bucket_counts(docs, trusted, orders, buckets), buckets)
    ratios = F.from_json(F.lit(listed), "array<double>")
    d = base_counts(docs).withColumn("ng", _buckets("h", orders, buckets))
    total = F.aggregate("ng", F.lit(0.0), lambda a, b: a + F.get(ratios, b))
    llr = F.round(F.when(F.size("ng") > 0, total / F.size("ng")).otherwise(0.0), 9)
    # The row number is a barrier: a filter on the result must not be pushed below here, where it
    # would repeat the nested array expressions once for each use.
    llr = F.when(F.monotonically_increasing_id() >= 0, llr)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    d = d.select(*names, llr.alias("llr"), "row")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return d.select(*names, failed.alias("base_failed"), (~failed & (F.col("llr") >= threshold)).alias("kept"), "llr", "row")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(spark, docs, labelled(spark, sf_dir, "quality").filter("y = 1")).drop("row")
