"""Overlapping chunks, reading plans and greedy packing under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import token_estimate

CHUNK_TOKENS, OVERLAP_TOKENS, BUNDLE_TOKENS, PER_TOKEN = 3000, 200, 9000, 4
SIZE, OVERLAP = CHUNK_TOKENS * PER_TOKEN, OVERLAP_TOKENS * PER_TOKEN
STRIDE = SIZE - OVERLAP
RANGE = max(1, BUNDLE_TOKENS // CHUNK_TOKENS)


def chunk_count(length: Column) -> Column:
    return F.when(length == 0, F.lit(0)).otherwise(F.ceil(F.greatest(F.lit(1), length - OVERLAP) / STRIDE)).cast("long")


def chunks(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), bodies: bool = False) -> DataFrame:
    """One row a chunk: idx (from 1), start_char, end_char, tokens, heading (of its first heading line)."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(*keep, t.alias("_t"), F.length(t).alias("_n"))
    d = d.filter("_n > 0").select("*", F.explode(F.sequence(F.lit(1).cast("long"), chunk_count(F.col("_n")))).alias("idx"))
    start = (F.col("idx") - 1) * STRIDE
    d = d.withColumn("start_char", start).withColumn("end_char", F.least(F.col("_n").cast("long"), start + SIZE))
    body = F.substring(F.col("_t"), (F.col("start_char") + 1).cast("int"), (F.col("end_char") - F.col("start_char")).cast("int"))
    tokens = F.ceil((F.col("end_char") - F.col("start_char")) / PER_TOKEN).cast("long")
    out = [*keep, "idx", "start_char", "end_char", tokens.alias("tokens")]
    if bodies:
        out += [F.regexp_extract(body, r"(?m)^#{1,6}[ \t]+([^\n]+)", 1).alias("heading"), body.alias("body")]
    return d.select(*out)


def intake_plan(docs: DataFrame, text: str = "text", size: Column | None = None, blocked: Column | None = None) -> DataFrame:
    """doc_id with tokens, chunks, ranges, mode and warnings."""
    size = F.lit(0) if size is None else size
    blocked = F.lit(False) if blocked is None else blocked
    tokens, n = token_estimate(text), chunk_count(F.length(F.coalesce(F.col(text), F.lit(""))))
    d = docs.select("doc_id", tokens.alias("tokens"), n.alias("chunks"), size.cast("long").alias("bytes"), blocked.alias("blocked"))
    big = F.col("bytes") > 25 * 1024 * 1024
    mode = F.when(F.col("chunks") <= 1, "single_context").when((F.col("tokens") > 2 * CHUNK_TOKENS) | big, "chunked_large_document")
    warnings = F.array_compact(
        F.array(
            F.when(F.col("chunks") > 1, F.lit("context_should_be_sent_in_chunks")),
            F.when(big, F.lit("large_source_file_use_progressive_extraction")),
            F.when(F.col("blocked"), F.lit("quality_must_be_resolved_before_chunk_send")),
        )
    )
    ranges = F.ceil(F.col("chunks") / RANGE).cast("long")
    return d.select("*", ranges.alias("ranges"), mode.otherwise("chunked_context").alias("mode"), warnings.alias("warnings"))


def feeding_plan(plan: DataFrame) -> DataFrame:
    """How an intake plan would be fed: priority, mode, reasons, and whether a loop could run on it."""
    ultra = (F.col("tokens") >= 250_000) | (F.col("chunks") >= 80) | (F.col("bytes") >= 50 * 1024 * 1024)
    large = ultra | (F.col("chunks") > 1) | (F.col("tokens") > 2 * CHUNK_TOKENS)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("chunks") > 1, F.lit("chunked_context_required")),
            F.when(ultra, F.lit("ultra_large_document")),
            F.when(F.col("bytes") >= 25 * 1024 * 1024, F.lit("large_source_file")),
            F.when(F.col("blocked"), F.lit("quality_review_required")),
        )
    )
    return plan.select(
        "doc_id",
        F.when(ultra, "ultra_large").when(large, "large").otherwise("normal").alias("priority"),
        F.when(ultra, "background_range_feeding").when(large, "reviewed_range_feeding").otherwise("single_review").alias("feed_mode"),
        F.col("ranges").alias("batches"),
        (large & ~F.col("blocked")).alias("loop_ready"),
        reasons.alias("reasons"),
    )


def batches(plan: DataFrame, preview: int | None = None, budget: int = BUNDLE_TOKENS) -> DataFrame:
    """Batches of chunks: batch_index, first and last chunk; the first ``preview`` ones only, if given."""
    width = max(1, budget // CHUNK_TOKENS)
    n = F.ceil(F.col("chunks") / width).cast("long")
    n = n if preview is None else F.least(n, F.lit(preview).cast("long"))
    d = plan.filter("chunks > 0").select("doc_id", "chunks", F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("batch_index"))
    first = (F.col("batch_index") - 1) * width + 1
    return d.select("doc_id", "batch_index", first.alias("first_chunk"), F.least(first + width - 1, F.col("chunks")).alias("last_chunk"))


def bundle(parts: DataFrame, start: int = 1, end: int | None = None, budget: int = BUNDLE_TOKENS) -> DataFrame:
    """Per document, the chunks from ``start`` that fit the budget (the first always does).

    Returns doc_id, first_chunk, last_chunk, tokens, next_chunk and truncated, which compares with
    the end that was asked for, not with the document's.
    """
    d = parts.filter(F.col("idx") >= start)
    if end is not None:
        d = d.filter(F.col("idx") <= end)
    run = F.sum("tokens").over(W.partitionBy("doc_id").orderBy("idx").rowsBetween(W.unboundedPreceding, 0))
    taken = d.withColumn("run", run).filter((F.col("run") <= budget) | (F.col("idx") == start))
    all_ = parts.groupBy("doc_id").agg(F.max("idx").alias("n"))
    got = taken.groupBy("doc_id").agg(F.min("idx").alias("first_chunk"), F.max("idx").alias("last_chunk"), F.sum("tokens").alias("tokens"))
    want = F.col("n") if end is None else F.lit(end)
    return got.join(all_, "doc_id").select(
        "doc_id", "first_chunk", "last_chunk", "tokens",
        F.when(F.col("last_chunk") < F.col("n"), F.col("last_chunk") + 1).alias("next_chunk"),
        (F.col("last_chunk") < want).alias("truncated"),
    )


def runbook_status(rows: DataFrame) -> DataFrame:
    """Roll-up of batches (run_id, batch_index, status) by run."""
    is_ = lambda *s: F.col("status").isin(*s)
    n = lambda *s: F.count(F.when(is_(*s), 1))
    first = lambda *s: F.min(F.when(is_(*s), F.col("batch_index")))
    done = n("reviewed", "sent", "skipped")
    total = F.count(F.lit(1))
    return rows.groupBy("run_id").agg(
        total.alias("total"), done.alias("completed"), n("sent").alias("sent"), n("reviewed").alias("ready"), n("blocked").alias("blocked"),
        n("planned").alias("planned"), n("pulled").alias("pulled"), F.greatest(F.lit(0).cast("long"), total - done - n("blocked")).alias("remaining"),
        F.floor(done / total * 100 + 0.5).cast("long").alias("percent"),
        first("planned", "pulled").alias("next_planned"), first("pulled").alias("next_pulled"),
        first("reviewed").alias("next_reviewed"), first("blocked").alias("next_blocked"),
    )


STATUSES = ("planned", "pulled", "reviewed", "sent", "skipped", "blocked")


def transition(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Batches with the statuses of ``changes`` (run_id, batch_index, status); other values are refused."""
    new = changes.select("run_id", "batch_index", F.lower(F.trim("status")).alias("new_status"))
    checked = F.when(F.col("new_status").isNull() | F.col("new_status").isin(*STATUSES), F.coalesce("new_status", "status"))
    checked = checked.otherwise(F.raise_error(F.concat(F.lit("unsupported status: "), F.col("new_status"))).cast("string"))
    keep = [c for c in rows.columns if c != "status"]
    return rows.join(new, ["run_id", "batch_index"], "left").select(*keep, checked.alias("status"))


def progress(plan: DataFrame, completed: Column, budget: int = BUNDLE_TOKENS) -> DataFrame:
    """doc_id with how far the feeding of an intake plan is, and the chunk and range that come next (null when done)."""
    width = max(1, budget // CHUNK_TOKENS)
    total = F.col("chunks")
    done = F.least(total, F.greatest(F.lit(0).cast("long"), F.coalesce(completed, F.lit(0)).cast("long")))
    d = plan.select("doc_id", total.alias("total"), done.alias("completed"))
    following = F.when(F.col("completed") < F.col("total"), F.col("completed") + 1)
    left = F.col("total") - F.col("completed")
    return d.select(
        "*",
        left.alias("remaining"),
        F.when(F.col("total") > 0, F.floor(F.col("completed") / F.col("total") * 100 + 0.5).cast("long")).otherwise(100).alias("percent"),
        following.alias("next_chunk"),
        F.when(following.isNotNull(), F.least(F.col("total"), following + (width - 1))).alias("next_range_end"),
        F.ceil(left / width).cast("long").alias("remaining_ranges"),
        F.when(F.col("total") > 1, "range_then_confirm").otherwise("single_reviewed_context").alias("mode"),
    )
