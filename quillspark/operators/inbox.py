"""The inbox: what each record needs next; and the log of exchanges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Types of documents and of tables.
DOCUMENT_TYPES, TABLE_TYPES = ("docx", "pptx", "pdf", "txt", "md"), ("csv", "xlsx")
#: Fields of an exchange audit; nothing else is kept of a request.
AUDIT = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("kind", T.StringType()),
        T.StructField("operation", T.StringType()),
        T.StructField("source_ref", T.StringType()),
        T.StructField("api_base_url", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("content_length", T.LongType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("decision", T.StringType()),
        T.StructField("signals", T.ArrayType(T.StringType())),
        T.StructField("tokens", T.LongType()),
        T.StructField("sent", T.BooleanType()),
        T.StructField("evidence_id", T.StringType()),
        T.StructField("created", T.TimestampType()),
    ]
)


def items(records: DataFrame) -> DataFrame:
    """id, status, actions and warnings of records.

    Records have id, status (imported, converted, failed, archived, ...), type, has_source,
    source_available, source_changed, has_markdown, confidence, scanned and mojibake.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    status, kind = F.col("status"), F.coalesce("type", F.lit(""))
    changed, live = yes("source_changed"), ~F.coalesce(F.col("status") == "archived", F.lit(False))
    low = F.coalesce(F.col("confidence") == "low", F.lit(False))
    fresh = status.isin("imported", "failed")
    supported = kind.isin(*DOCUMENT_TYPES, *TABLE_TYPES)
    actions = (
        (~live, "unarchive"),
        (live & changed, "refresh"),
        (live & kind.isin(*DOCUMENT_TYPES) & (fresh | changed), "extract"),
        (live & kind.isin(*TABLE_TYPES) & fresh, "inspect"),
        (live & ((kind == "md") | yes("has_markdown")) & status.isin("converted", "imported"), "open_note"),
        (live & ~supported, "show_known_limit"),
        (live & (low | yes("scanned") | yes("mojibake")), "review_before_ai"),
    )
    warnings = (
        (status == "failed", "Extraction failed"),
        (yes("has_source") & ~yes("source_available"), "Source file is missing"),
        (changed, "Source file changed externally"),
        (~supported, "Unsupported file type"),
        (yes("scanned"), "Scanned document detected - requires OCR"),
        (yes("mojibake"), "Possible CJK character corruption (mojibake)"),
        (low, "Low quality extraction (confidence: low)"),
    )
    listed = lambda rules: F.array_compact(F.array(*(F.when(c, F.lit(x)) for c, x in rules)))
    return records.select(
        "id",
        F.when(live & changed, "stale").otherwise(status).alias("status"),
        listed(actions).alias("actions"),
        listed([(live & c, x) for c, x in warnings]).alias("warnings"),
    )


def audits(rows: DataFrame) -> DataFrame:
    """Rows as audits: known fields with their types, defaults for absent ones, nothing else."""
    default = {"string": F.lit(""), "long": F.lit(0).cast("long"), "boolean": F.lit(False), "array": F.array().cast("array<string>")}

    def field(f: T.StructField) -> Column:
        kind = f.dataType.typeName()
        c = F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)
        return (F.coalesce(c, default[kind]) if kind in default else c).alias(f.name)

    return rows.select(*map(field, AUDIT))


def without_audit(log: DataFrame, deleted: DataFrame) -> DataFrame:
    """The log without the audits whose id is deleted; ids that are not there have no effect."""
    return log.join(deleted.select("id"), "id", "left_anti")
