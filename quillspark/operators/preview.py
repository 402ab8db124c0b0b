"""What a model would see: previews of documents and tables, hand-off bundles, cleaned stored Markdown."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import chunks

SHORT = 100
SHOWN_ROWS, SHOWN_COLUMNS = 8, 12


def context(docs: DataFrame, text: str = "text", warnings: Column | None = None, blocked: Column | None = None) -> DataFrame:
    """doc_id, headings, placeholders, tokens, chunks, mode, decision, low_quality and next_step of documents."""
    warnings = F.array().cast("array<string>") if warnings is None else warnings
    blocked = F.lit(False) if blocked is None else blocked
    body = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, f"^{T.WHITE}+|{T.WHITE}+$", ""))
    heading = F.filter(trimmed, lambda x: x.rlike(r"^#{1,6}\s+"))
    low = blocked | F.array_contains(warnings, "scannedLikely") | (F.length(body) < SHORT)
    step = F.concat(F.when(F.col("low_quality"), "Low quality document detected. ").otherwise(""), F.lit("Proceed with exchange."))
    step = F.when((F.col("chunks") > 1) & (F.col("decision") != "blocked"), F.concat(step, F.lit(" Use chunked intake: "), "mode")).otherwise(step)
    d = docs.select("doc_id", F.col(text), heading.alias("headings"), T.mask_placeholders(text).alias("placeholders"), low.alias("low_quality"), F.when(blocked, "blocked").otherwise("allow").alias("decision"))
    n = chunks.chunk_count(F.length(body))
    tokens = chunks.token_estimate(text)
    mode = F.when(n <= 1, "single_context").when(tokens > 2 * chunks.CHUNK_TOKENS, "chunked_large_document").otherwise("chunked_context")
    d = d.select("doc_id", "headings", "placeholders", tokens.alias("tokens"), n.alias("chunks"), mode.alias("mode"), "decision", "low_quality")
    return d.withColumn("next_step", step)


def dataset_markdown(name: str, source_type: str, status: str, sheets: list[tuple[str, DataFrame]]) -> str:
    """A table's preview: its sheets' columns and first rows, at most SHOWN_ROWS by SHOWN_COLUMNS cells."""
    out = [f"# {name}", "", f"Source type: {source_type}", f"Status: {status}", ""]
    if not sheets:
        return "\n".join([*out, "No table preview is available yet. Inspect the spreadsheet before sending it to AI."])
    for title, df in sheets:
        rows = df.limit(SHOWN_ROWS).collect()
        shown = df.columns[:SHOWN_COLUMNS]
        cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
        out += [f"## {title}", "", f"Columns: {', '.join(df.columns) or 'none'}", f"Preview rows: {len(rows)}", ""]
        if rows and shown:
            table = [shown, ["---"] * len(shown), *([cell(r[c]) for c in shown] for r in rows)]
            out += [*(f"| {' | '.join(line)} |" for line in table), ""]
    return "\n".join(out)


# The text around a hand-off's context.
BUNDLE_TOP = (
    "## AI Handoff Bundle",
    "",
    "This bundle captures the reviewed context that is ready to hand to an AI model. Treat it as the source of truth for what the model is allowed to see.",
    "",
    "### Send Gate",
    "",
)
BUNDLE_MIDDLE = (
    "",
    "### Operator Prompt",
    "",
    "Use only the staged context below. Do not assume access to the original file. Respect redaction markers and do not reconstruct masked secrets. If context appears incomplete, ask for the next chunk or range instead of guessing.",
    "",
    "### Return Contract",
    "",
    "- Cite the section, table, or chunk you used when possible.",
    "- Flag missing context before making a high-impact conclusion.",
    "- Preserve Markdown structure in the response.",
    "- Keep any suggested follow-up tied to the staged context and evidence.",
    "",
    "### Staged Context",
    "",
)
BUNDLE_FACTS = (
    ("", "ledger", "AI chunk ledger: unavailable"),
    ("", "gate", "Send Gate: not reviewed"),
    ("Evidence: ", "evidence_id", "none"),
    ("Audit: ", "audit_id", "none"),
    ("Operation: ", "operation", "not selected"),
    ("Model: ", "model", "not selected"),
    ("API Base URL: ", "api_base_url", "not selected"),
)


def bundle(rows: DataFrame, content: str = "content") -> Column:
    """A hand-off bundle's text from the facts that the rows have as columns; null for empty content."""
    facts = [
        F.concat(F.lit(f"- {label}"), F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(absent)) if c in rows.columns else F.lit(absent))
        for label, c, absent in BUNDLE_FACTS
    ]
    top, middle = "\n".join(BUNDLE_TOP), "\n".join(BUNDLE_MIDDLE)
    whole = F.concat_ws("\n", F.lit(top), *facts, F.lit(middle), F.col(content))
    return F.when(F.coalesce(F.col(content), F.lit("")).rlike(r"\S"), whole)


# Lines about the conversion, and the marks of older notices.
PROCESS_LINE = r"(?i)^>\s*(?:Source|Converted by|Extractor|Extraction quality|Human-readable Markdown view\.?|Source format):|^>\s*Human-readable Markdown view\.?$"
PDF_NOTICE = ("# PDF extraction needs another path", "Presentation replaced due to low readability", "\n---\n")
BLOCKED_NOTICE = ("Human-readable Markdown was not generated", "this human reading view is blocked")
BLOCKED_LINE, BLOCKED_NOW = r"(?m)^- Schema Docs kept.*this human reading view is blocked.*$", "- PDF/OCR extraction limit; not Markdown failure."
UNREADABLE = "\n".join(
    (
        "# Document needs another extraction path",
        "",
        "> **Status**: This generated reading file contains unreadable replacement characters, so Schema Docs blocked the human reading view instead of showing corrupted text.",
        "",
        "## What you can do",
        "- Refresh extraction after saving the source as UTF-8 text.",
        "- If this came from a TXT file, confirm it is real plain text and not a compressed, binary, or ebook/export file.",
        "- If this is an older generated readable segment, delete the stale output and re-import or refresh the source.",
        "",
        "## Warnings",
        "- Low-readable generated Markdown was detected while opening this file.",
        "",
    )
)


def without_legacy(text: Column) -> Column:
    """Of a document that an older notice stands before, the notice alone."""
    holds = lambda marks: F.least(F.lit(True), *(F.contains(text, F.lit(m)) for m in marks))
    end = lambda c: F.concat(F.regexp_replace(c, f"{T.WHITE}+\\z", ""), F.lit("\n"))
    blocked = F.regexp_replace(F.substring_index(text, "\n---\n\n", 1), BLOCKED_LINE, BLOCKED_NOW)
    return F.when(holds(PDF_NOTICE), end(F.substring_index(text, "\n---\n", 1))).when(holds(BLOCKED_NOTICE), end(blocked)).otherwise(text)


def cleaned_markdown(text: Column) -> Column:
    """Stored Markdown without lines about its conversion (and the blank line after one), or a notice if it is unreadable."""
    lines = F.split(F.regexp_replace(without_legacy(F.coalesce(text, F.lit(""))), "\r\n?", "\n"), "\n")
    trim = lambda x: F.regexp_replace(x, f"^{T.WHITE}+|{T.WHITE}+$", "")

    def clean(all_: Column) -> Column:
        about = lambda i: F.coalesce(trim(F.get(all_, i)).rlike(PROCESS_LINE), F.lit(False))
        return F.filter(all_, lambda x, i: ~about(i) & ~((trim(x) == "") & about(i - 1)))

    body = F.regexp_replace(F.array_join(T.let(lines, clean), "\n"), "\n{3,}", "\n\n")
    body = F.concat(F.regexp_replace(body, f"{T.WHITE}+\\z", ""), F.lit("\n"))
    return T.let(body, lambda b: F.when(T.high_mojibake(b), F.lit(UNREADABLE)).otherwise(b))


# A slide's heading, and an image that shows the slide by its caption or its file.
SLIDE = r"(?i)##\s+Slide\s+(\d+)(?:\s*[:：].*)?\s*"
IMAGE = r"""(?i)!\[([^\]]*)\]\((?:<([^>\n]+)>|([^\s)\n]+))(?:\s+["'][^"']*["'])?\)\s*"""
CAPTION, IMAGE_FILE = r"(?i)Slide\s+%s\s+(?:preview|image)", r"(?i).*\.pptx[\\/]slide-%s(?:-(?:preview|image))?\.(?:png|jpe?g|webp)"


def _picture(block: list[str], number: str) -> str | None:
    """The line of a slide's block that shows the slide as a whole."""
    for line in block:
        m = re.fullmatch(IMAGE, line.strip())
        if m and (re.fullmatch(CAPTION % number, m[1]) or re.fullmatch(IMAGE_FILE % number, m[2] or m[3] or "")):
            return line.strip()
    return None


def projected_slides(markdown: str | None) -> str:
    """Slides as their heading and picture, where they have one; a text without such pictures stays as it is."""
    text = re.sub("\r\n?", "\n", markdown or "")
    blocks: list[tuple[str | None, list[str]]] = [(None, [])]
    for line in text.split("\n"):
        if m := re.fullmatch(SLIDE, line.strip()):
            blocks.append((m[1], []))
        blocks[-1][1].append(line)
    pictures = [number and _picture(block, number) for number, block in blocks]
    if not any(pictures):
        return text
    title = next((x.strip() for x in blocks[0][1] if re.match(r"#\s+\S", x.strip())), "")
    parts = [title] + [f"{block[0].strip()}\n\n{p}" if p else "\n".join(block).rstrip() for (_, block), p in zip(blocks[1:], pictures[1:], strict=True)]
    return re.sub("\n{3,}", "\n\n", "\n\n".join(x for x in parts if x)).strip() + "\n"


def slides(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the projected text of every row."""

    @F.pandas_udf("string")
    def run(t: pd.Series) -> pd.Series:
        return t.map(projected_slides)

    return docs.select(key, run(F.col(text)).alias("projected"))
