"""Paths and folders: what lies inside a root, safe output names, and folders made safe to share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import masking

READ = ("md", "markdown", "txt", "docx", "pptx", "pdf", "csv", "xlsx")


def resolved(path: Column, root: Column) -> Column:
    """A path without ``.``, ``..`` and doubled marks, taken from ``root`` if it is relative. Both read ``/`` and ``\\`` alike."""
    p, r = (F.replace(x, F.lit("\\"), F.lit("/")) for x in (path, root))
    whole = F.when(p.startswith("/"), p).otherwise(F.concat(r, F.lit("/"), p))
    steps = F.filter(F.split(whole, "/"), lambda x: ~x.isin("", "."))
    up = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(steps, F.array().cast("array<string>"), up), "/"))


def inside(path: Column, root: Column) -> Column:
    """Whether a path, resolved, is the root or lies below it."""
    p, r = resolved(path, root), resolved(root, F.lit("/"))
    return (r == "/") | (p == r) | p.startswith(F.concat(r, F.lit("/")))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/\\](\.[^./\\]*)$", 1))


def write_refusal(path: Column, root: Column, extensions: tuple[str, ...] = ()) -> Column:
    """Why nothing may be written at a path; null if it may."""
    code = F.when(~inside(path, root), "path_outside_workspace")
    return code.when(~extension(path).isin(*extensions), "unsupported_output_extension") if extensions else code


def segment(masked: Column) -> Column:
    """A masked name as part of a safe path."""
    c = F.regexp_replace(masked, r"\[MASK_([A-Z]+)_([0-9]+)\]", "MASK-$1-$2")
    c = F.regexp_replace(F.regexp_replace(c, r"[^a-zA-Z0-9_\-\u4e00-\u9fa5]+", "-"), r"^-+|-+$", "")
    return F.when(c == "", "sanitized").otherwise(c)


def output_path(path: Column, rules=masking.RULES) -> Column:
    """Where the safe copy of a file goes: every part of its path masked apart from the others."""
    mask = masking.mask_each(rules)
    p = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    folders = F.filter(F.split(F.regexp_extract(p, "^(.*)/", 1), "/"), lambda x: x != "")
    base = F.regexp_extract(p, "([^/]*)$", 1)
    name = F.when(base.rlike(r"^.+\.[^.]*$"), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)
    parts = F.transform(mask(F.concat(folders, F.array(name))), segment)
    return F.concat(F.array_join(parts, "/"), F.lit("-AI-safe.md"))


def source_ref(path: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.coalesce(path, F.lit("")), 256))


def sanitized(files: DataFrame, rules=masking.RULES) -> DataFrame:
    """Files (path, text) made safe: source_ref, type, status, masked (text), masked_count, output_path, reason.

    Types that are not read are skipped, files without a text failed. The original path is in no column.
    """
    kind = F.substring(extension(F.col("path")), 2, 100)
    d = files.select("path", "text", kind.alias("type"))
    status = F.when(~F.col("type").isin(*READ), "skipped").when(F.col("text").isNull(), "failed").otherwise("succeeded")
    d = d.select("*", status.alias("status"), masking.mask(rules)(F.when(status == "succeeded", F.col("text"))).alias("m"), output_path(F.col("path"), rules).alias("out"))
    good = F.col("status") == "succeeded"
    return d.select(
        source_ref(F.col("path")).alias("source_ref"),
        "type",
        "status",
        F.when(good, F.col("m.masked")).alias("masked"),
        F.when(good, F.size("m.mapping").cast("long")).alias("masked_count"),
        F.when(good, F.col("out")).alias("output_path"),
        F.when(F.col("status") == "skipped", "unsupported type").when(~good, "no text").alias("reason"),
    )


def report(rows: DataFrame) -> DataFrame:
    """Files and masked values by status."""
    return rows.groupBy("status").agg(F.count("*").alias("files"), F.coalesce(F.sum("masked_count"), F.lit(0)).alias("masked"))


def report_lines(rows: DataFrame) -> DataFrame:
    """The report as rows of a Markdown table."""
    details = (
        F.when(F.col("status") == "succeeded", F.concat(F.lit("Redacted: "), "masked_count", F.lit(" items, saved to "), "output_path"))
        .when(F.col("status") == "skipped", F.concat(F.lit("Reason: "), "reason"))
        .otherwise(F.concat(F.lit("Error: "), "reason"))
    )
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", "source_ref", F.upper("type"), F.initcap("status"), details), F.lit(" |")).alias("line"))
