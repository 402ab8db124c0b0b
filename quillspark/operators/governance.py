"""Catalog and log operators: import dedup, change detection, evidence, roll-ups and verdicts.

Logs are append-only and never hold bodies, query texts, mappings or keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVIDENCE = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("kind", T.StringType()),
        T.StructField("created", T.TimestampType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("source_ref", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("signals", T.ArrayType(T.StringType())),
        T.StructField("decision", T.StringType()),
        T.StructField("query_shape", T.MapType(T.StringType(), T.StringType())),
        T.StructField("override_reason_hash", T.StringType()),
    ]
)
DOCUMENTS, DATASETS = ("md", "markdown", "txt", "docx", "pptx", "pdf"), ("csv", "xlsx")
LEGACY = ("doc", "ppt", "xls")


def source_kind(path: Column) -> Column:
    """document, dataset, optional_adapter_required (old office formats) or unsupported, by extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return (
        F.when(ext.isin(*DOCUMENTS), "document").when(ext.isin(*DATASETS), "dataset")
        .when(ext.isin(*LEGACY), "optional_adapter_required").otherwise("unsupported")
    )


def new_imports(incoming: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows whose (path, hash) the catalog does not hold yet."""
    return incoming.join(catalog.select("path", "hash"), ["path", "hash"], "left_anti")


def changes(listing: DataFrame, catalog: DataFrame) -> DataFrame:
    """path and state (new, missing, unchanged, touched, changed) of files against the catalog (path, mtime, hash)."""
    a, b = listing.alias("a"), catalog.alias("b")
    same_time, same_hash = F.col("a.mtime").eqNullSafe(F.col("b.mtime")), F.col("a.hash").eqNullSafe(F.col("b.hash"))
    state = (
        F.when(F.col("b.path").isNull(), "new").when(F.col("a.path").isNull(), "missing")
        .when(same_time, "unchanged").when(same_hash, "touched").otherwise("changed")
    )
    return a.join(b, F.col("a.path") == F.col("b.path"), "full_outer").select(F.coalesce("a.path", "b.path").alias("path"), state.alias("state"))


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """hash, first (smallest key) and n of texts that more than one document has."""
    h = docs.select(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("hash"))
    return h.groupBy("hash").agg(F.min(key).alias("first"), F.count("*").alias("n")).filter("n > 1")


def append_evidence(rows: DataFrame, path: str) -> None:
    """Adds whitelisted fields to the log at ``path``; any other column is left out."""
    cols = [F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in EVIDENCE]
    rows.select(*(c.alias(f.name) for c, f in zip(cols, EVIDENCE, strict=True))).write.mode("append").json(path)


def visible(log: DataFrame, deleted: DataFrame) -> DataFrame:
    """The log's index without deleted ids; the log itself keeps its lines."""
    return log.join(deleted.select("id"), "id", "left_anti")


def timeline(log: DataFrame, record: str | None = None) -> DataFrame:
    d = log if record is None else log.filter(F.col("record_id") == record)
    return d.orderBy("created", "id")


def placed(log: DataFrame) -> DataFrame:
    """Every record's timeline: the log with each row's place among its record's, by time."""
    return log.withColumn("place", F.row_number().over(W.partitionBy("record_id").orderBy("created", "id")).cast("long"))


def rollup(log: DataFrame, by: str = "kind") -> DataFrame:
    """n, first and last time of each kind."""
    return log.groupBy(by).agg(F.count("*").alias("n"), F.min("created").alias("first"), F.max("created").alias("last"))


def job_status(events: DataFrame) -> DataFrame:
    """The last status of every job in a log of (job_id, at, status)."""
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("at", "status")).alias("status"), F.max("at").alias("at"))


def leaked(log: DataFrame) -> DataFrame:
    """Ids of log rows that hold a secret, with a failure code; names of signals alone are fine."""
    from .gate import PATTERNS

    body = F.to_json(F.struct(*(c for c in log.columns if c not in ("signals", "id"))))
    bad = body.rlike(PATTERNS["api_key"]) | body.rlike(PATTERNS["bearer"]) | body.rlike(PATTERNS["private_key"]) | body.rlike(PATTERNS["label"])
    return log.filter(bad).select("id", F.lit("secret_leaked_in_evidence").alias("code"))


def quality_state(chars: Column, scanned: Column, mojibake: Column, simplified: Column, damaged: Column) -> dict[str, Column]:
    """Confidence, warnings and the gate's block of an extraction."""
    image = chars == 0
    confidence = F.when(scanned | image | (chars < 100), "low").when(mojibake | simplified, "medium").otherwise("high")
    named = ((scanned | image, "scannedLikely"), (simplified, "tableSimplified"), (mojibake, "possibleMojibake"), (damaged, "formulaDamageLikely"))
    return {
        "confidence": confidence,
        "warnings": F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in named))),
        "blocked": (confidence == "low") | damaged,
        "pages": F.greatest(F.lit(1).cast("long"), F.ceil(chars / 2000).cast("long")),
    }


def verdict(integrity: Column, sanitized: Column, gate: Column, version: Column, quality: Column, audit: Column, provenance: Column, limits: Column) -> Column:
    """blocked, trusted_with_warnings or trusted."""
    stop = (integrity == "fail") | (sanitized == "fail") | (gate == "fail") | (version != 1)
    warn = (quality == "warning") | (audit == "fail") | (provenance == "fail") | (gate != "pass") | (limits > 0)
    return F.when(stop, "blocked").when(warn, "trusted_with_warnings").otherwise("trusted")


def verified(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """path and state (ok, changed, missing, unlisted) of a package's files (path, content) against (path, sha256)."""
    f = files.select("path", F.sha2("content", 256).alias("actual"))
    state = (
        F.when(F.col("actual").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted")
        .when(F.col("actual") == F.regexp_replace("sha256", "^sha256:", ""), "ok").otherwise("changed")
    )
    return f.join(manifest.select("path", "sha256"), "path", "full_outer").select("path", state.alias("state"))
