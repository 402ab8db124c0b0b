"""Exact dedup by content-defined chunk recipes (native).

Each text, without its white space, is cut where its own content says so; chunks become verified
identifiers; a document is then the ordered list of its chunks' identifiers, and equal lists are
equal texts. Only digests are shuffled: no text, long or short, leaves the task that read it.

A text is first read in atoms of 25 to 128 characters, which end at some frequent characters. A
chunk ends at an atom whose 64-bit hash is a multiple of CUT, after 8 atoms at least and 128 at
most, so an insertion moves the cuts near it only and every chunk's size is bounded.

An identifier is a chunk's 64-bit hash and, where different SHA-256 digests were seen with that
hash anywhere, the digest's rank among those; so two chunks share an identifier only if their digests
are equal.

Defined cases: null counts as empty; all empty texts are one group; rows with a null id take part
and lose ties against any id; of rows that tie in length and id (repeated rows, null ids) exactly one
stays; an empty table gives an empty result; very long texts are cut like others; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spent, table, written

#: Characters at which an atom ends: some of each script, so that atoms of about 32 characters are usual.
ENDS = r"[e;}05\u0430\u043E\u0627\u093E\u3042-\u304A\u4E00-\u55FF\uAC00-\uAFFF]"
ATOM = rf"(?s).{{24,127}}?{ENDS}|.{{1,128}}"
CUT = 32
#: Atoms end in a space, those that may end a chunk in a line feed; neither is left in a normalised text.
CHUNK = r"(?:[^ \n]++[ \n]){8,127}?(?<=\n)|(?:[^ \n]++[ \n]){1,128}"


def normalised(text):
    """The text without the characters of [\\x20\\x09-\\x0D]."""
    for c in " \n\t\r\x0b\x0c":
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def chunks_of(t):
    """The chunks of a normalised text, in order, with the marks of their atoms."""
    atoms = F.regexp_extract_all(t, F.lit(ATOM), F.lit(0))
    marked = F.transform(atoms, lambda a: F.concat(a, F.when(F.pmod(F.xxhash64(a), F.lit(CUT)) == 0, "\n").otherwise(" ")))
    return F.regexp_extract_all(F.array_join(marked, ""), F.lit(CHUNK), F.lit(0))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple = (), bits: int = 64) -> DataFrame:
    """(row_id, doc_id, n, text_sha256, chunks, carry...): the chunk digests of every row, in order."""
    kept = [F.col(f"`{c}`").alias(f"carry{i}") for i, c in enumerate(carry)]
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"), *kept)
    kept = [f"carry{i}" for i in range(len(carry))]
    d = d.select("doc_id", F.length("text").alias("n"), normalised(F.col("text")).alias("t"), *kept)

    def digest(c):
        return F.struct(F.shiftright(F.xxhash64(c), 64 - bits).alias("key"), F.unhex(F.sha2(c, 256)).alias("sha"))

    return d.select(
        F.monotonically_increasing_id().alias("row_id"),
        "doc_id",
        "n",
        F.sha2("t", 256).alias("text_sha256"),
        F.transform(chunks_of(F.col("t")), digest).alias("chunks"),
        *kept,
    )


def _ranks(t: DataFrame, shared: DataFrame) -> DataFrame:
    """(row_id, ords): the digests' ranks of rows with a chunk whose key has several digests."""
    flat = t.select("row_id", F.posexplode("chunks").alias("pos", "c")).select("row_id", "pos", "c.key", "c.sha")
    each = flat.join(shared.select("key"), "key", "left_semi").groupBy("key", "sha").agg(F.lit(1).alias("one"))
    # a key's window holds one row per different digest
    each = each.selectExpr("key", "sha", "row_number() over (partition by key order by sha) as ord")
    met = flat.join(each, ["key", "sha"])
    # bounded by one document's chunks
    return met.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("pos", "ord"))).alias("ords"))


def deduplicate(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple = (), bits: int = 64
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and the columns in ``carry`` of every row.

    ``bits`` of the chunks' hashes make their keys (fewer only in tests, for keys with several digests).
    """
    t = written(spark, recipes(docs, id_col, text_col, carry, bits), "recipes")
    digests = t.select(F.explode("chunks").alias("c")).groupBy("c.key")
    shared = digests.agg(F.min("c.sha").alias("low"), F.max("c.sha").alias("high")).filter("low <> high")
    shared = written(spark, shared, "shared-keys")
    rows = t.select(
        "row_id", "doc_id", "n", "text_sha256", *(f"carry{i}" for i in range(len(carry))), F.transform("chunks", lambda c: c["key"]).alias("recipe")
    )
    none = F.array().cast("array<struct<pos: int, ord: int>>")
    if shared.isEmpty():
        rows = rows.withColumn("ords", none)
    else:
        rows = rows.join(_ranks(t, shared), "row_id", "left").withColumn("ords", F.coalesce("ords", none))
    rows = written(spark, rows.withColumn("g", F.xxhash64("recipe", "ords")), "lists")
    spent(spark, t, shared)
    # the longest, then the smallest id (a null is the last), then the first row
    best = F.max(F.struct("n", F.bitwise_not("doc_id").alias("d"), F.bitwise_not("row_id").alias("r")))
    groups = rows.groupBy("g", "recipe", "ords").agg(F.count("*").alias("group_size"), best.alias("best"))
    groups = groups.select("g", "recipe", "ords", "group_size", F.bitwise_not("best.d").alias("keep_id"), F.bitwise_not("best.r").alias("keep_row"))
    # a table of its own, so that a large group's rows can be split in the join
    groups = written(spark, groups, "groups")
    out = rows.join(groups, ["g", "recipe", "ords"])
    named = [F.col(f"carry{i}").alias(c) for i, c in enumerate(carry)]
    return out.select("doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "text_sha256", *named)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark, table(spark, sf_dir, "documents"))


SQL = r"""
with t as (select doc_id, length(coalesce(text, '')) as n,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as s from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by s) as group_size,
       row_number() over w = 1 as kept, s as text_sha256
from t window w as (partition by s order by n desc, doc_id asc nulls last)
"""
