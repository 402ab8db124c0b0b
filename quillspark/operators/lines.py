"""Line-level operators: search, positional diff, repeated lines, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import WHITE
from . import readable

_TRIM = f"^{WHITE}+|{WHITE}+$"


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text", newline: str = "\r?\n") -> DataFrame:
    """(key, line_no from 1, line) of every line."""
    d = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), newline)).alias("p", "line"))
    return d.select(key, (F.col("p") + 1).cast("long").alias("line_no"), "line")


def search(docs: DataFrame, keyword: str, per_doc: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Hits of a keyword, case-insensitive: key, matches, line_no, line; ``per_doc`` hits a document at most."""
    word = keyword.strip().lower()
    hit = lines(docs, key, text).filter(F.lit(bool(word)) & F.contains(F.lower("line"), F.lit(word)))
    w = W.partitionBy(key)
    ranked = hit.withColumn("matches", F.count("*").over(w)).withColumn("rn", F.row_number().over(w.orderBy("line_no")))
    return ranked.filter(F.col("rn") <= per_doc).select(key, "matches", "line_no", F.regexp_replace("line", _TRIM, "").alias("line"))


def search_counts(docs: DataFrame, keyword: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with hits and how many, the most first."""
    word = keyword.strip().lower()
    hit = lines(docs, key, text).filter(F.lit(bool(word)) & F.contains(F.lower("line"), F.lit(word)))
    return hit.groupBy(key).agg(F.count("*").alias("matches")).orderBy(F.desc("matches"), key)


def diff(a: DataFrame, b: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Positional line differences of two versions: key, line_no, old_line, new_line (null: no such line)."""
    old = a.select(F.col(key), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("old_line"))
    new = b.select(F.col(key), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("new_line"))
    # documents meet once by their key; their lines are paired inside
    d = old.join(new, key, "full_outer")
    none = F.array().cast("array<string>")
    pairs = F.arrays_zip(F.coalesce("old_line", none).alias("old_line"), F.coalesce("new_line", none).alias("new_line"))
    d = d.select(key, F.posexplode(pairs).alias("i", "x")).filter(~F.col("x.old_line").eqNullSafe(F.col("x.new_line")))
    return d.select(key, (F.col("i") + 1).cast("long").alias("line_no"), "x.old_line", "x.new_line")


def diff_lines(d: DataFrame) -> DataFrame:
    """A diff as text: one row for each removed and each added line."""
    at = F.col("line_no").cast("string")
    old = F.when(F.col("old_line").isNotNull(), F.concat(F.lit("- L"), at, F.lit(": "), F.col("old_line")))
    new = F.when(F.col("new_line").isNotNull(), F.concat(F.lit("+ L"), at, F.lit(": "), F.col("new_line")))
    keys = [c for c in d.columns if c not in ("old_line", "new_line")]
    return d.select(*keys, F.posexplode(F.array_compact(F.array(old, new))).alias("side", "entry"))


def noise_key(line: Column) -> Column:
    """:func:`readable.noise_key` as a Column."""
    t = F.regexp_replace(line, _TRIM, "")
    k = F.lower(t)
    for pattern, to in readable.NUMBERS:
        k = F.regexp_replace(k, pattern, to)
    n = F.length(t)
    apart = t.rlike("(?s)^(?:" + "|".join(readable.NOT_REPEATED) + r")\z")
    return F.when((n < readable.SHORTEST_HEAD) | (n > readable.LONGEST_HEAD) | apart, F.lit("")).otherwise(F.trim(F.regexp_replace(k, f"{WHITE}+", " ")))


def without_repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The lines that are no running heads: those whose key stands less than max(4, lines / 90) times.

    A document's lines stay together in one array, so nothing is shuffled: its keys are sorted, and those
    that have their equal that many places on are running heads.
    """
    all_ = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    d = docs.select(F.col(key).alias("_id"), all_.alias("l"))
    d = d.withColumn("k", F.transform("l", noise_key)).withColumn("most", F.greatest(F.lit(4), F.floor(F.size("l") / 90)).cast("int"))
    d = d.withColumn("s", F.array_sort(F.filter("k", lambda x: x != "")))
    ahead = F.transform("s", lambda x, i: F.when(F.get("s", i + F.col("most") - 1) == x, x))
    d = d.withColumn("heads", F.array_distinct(F.array_compact(ahead)))
    kept = F.filter(F.transform(F.arrays_zip("l", "k"), lambda x, i: F.struct((i + 1).cast("long").alias("no"), x["l"].alias("line"), x["k"].alias("k"))), lambda x: ~F.array_contains(F.col("heads"), x["k"]))
    return d.select("_id", F.explode(kept).alias("x")).select(F.col("_id").alias(key), F.col("x.no").alias("line_no"), "x.line")


def page_noise(line: Column) -> Column:
    """Whether a line is only a page number."""
    t = F.regexp_replace(line, _TRIM, "")
    return t.rlike(r"^(?i:page\s*)?[0-9]{1,5}\s*(?:/\s*[0-9]{1,5})?$") | t.rlike("^[-–—]\\s*[0-9]{1,5}\\s*[-–—]$")


def versions(rows: DataFrame, path: str = "path", created: str = "created") -> DataFrame:
    """Adds ``version``: a row's number among those of its path, by time."""
    return rows.withColumn("version", F.row_number().over(W.partitionBy(path).orderBy(created)).cast("long"))
