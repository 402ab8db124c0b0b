"""Text metrics as Column expressions; lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
CJK_METRIC = r"[一-龥぀-ゟ゠-ヿ가-힯]"
# Frequent Chinese characters of the readability rule.
CJK_COMMON = "[的了是有我在一个这中他会与及以和要国人]"
WHITE = r"[\t\n\x0B\f\r    -     　﻿]"


def _c(text) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def _n(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def token_estimate(text) -> Column:
    """Four characters a token, rounded up; empty text has none."""
    return F.ceil(F.length(_c(text)) / CHARS_PER_TOKEN).cast("long")


def token_count(text) -> Column:
    """The other estimate: at least one."""
    return F.greatest(F.lit(1).cast("long"), token_estimate(text))


def content_hash(text, prefix: bool = False) -> Column:
    h = F.sha2(_c(text), 256)
    return F.concat(F.lit("sha256:"), h) if prefix else h


def clip(text, size: int = 280) -> Column:
    """Long text as its two ends around a mark."""
    c, half = _c(text), (size - 20) // 2
    cut = F.concat(F.substring(c, 1, half), F.lit("\n...[clipped]...\n"), F.right(c, F.lit(half)))
    return F.when(F.length(c) <= size, c).otherwise(cut)


def metrics(text) -> dict[str, Column]:
    c = _c(text)
    n = F.length(c)
    ratio = lambda p: F.when(n == 0, F.lit(0.0)).otherwise(_n(c, p) / n)
    return {
        "chars": n.cast("long"),
        "replacement_chars": _n(c, "�").cast("long"),
        "non_printable_ratio": ratio(CONTROL),
        "cjk_ratio": ratio(CJK_METRIC),
        "ascii_ratio": ratio(r"[\x00-\x7F]"),
    }


def quality_score(text) -> Column:
    """Share of common characters, less five times that of replacement and four times that of control characters."""
    c = _c(text)
    n = F.length(c)
    common = r"""[A-Za-z0-9一-鿿　-〿＀-￯\s.,;:!?'"()\[\]{}\-_/\\]"""
    score = _n(c, common) / n - 5 * (_n(c, "�") / n) - 4 * (_n(c, CONTROL) / n)
    return F.when(n == 0, F.lit(float("-inf"))).otherwise(score)


def printable(text) -> Column:
    return F.regexp_replace(_c(text), WHITE, "")


def high_mojibake(text) -> Column:
    # The least printable characters, lost characters and their share.
    p = F.length(printable(text))
    r = _n(_c(text), "�")
    return (p >= 80) & (r >= 20) & (r / F.greatest(p, F.lit(1)) > 0.04)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def low_readable(text) -> Column:
    """Whether a text reads like a failed extraction."""
    # The patterns and thresholds of this verdict.
    c = _c(text)
    counts = F.struct(
        F.length(printable(text)).alias("p"),
        _n(c, r"\\(?:[0-7]{2,3}|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|[nrt()\\])").alias("escapes"),
        _n(c, r"[\p{L}\p{N}]").alias("readable"),
        _n(c, r"[一-龥぀-ヿ가-힯]").alias("cjk"),
        _n(c, "\ufffd").alias("lost"),
    )

    def verdict(x: Column) -> Column:
        share = lambda n: F.when(x["p"] == 0, F.lit(0.0)).otherwise(n / x["p"])
        noise = (x["escapes"] >= 3) | ((x["p"] >= 24) & (share(x["readable"]) < 0.35))
        noise = noise | ((x["p"] >= 80) & (share(_n(c, "[\ufffd□À-ɏ]")) > 0.12)) | c.rlike(r"(?:[0-9A-Fa-f]{2}\s*){12}")
        return (
            F.when((x["cjk"] >= 10) & (_n(c, CJK_COMMON) / F.greatest(x["cjk"], F.lit(1)) < 0.015), F.lit(True))
            .when((x["p"] > 10) & (share(x["lost"]) > 0.05), F.lit(True))
            .when((share(x["readable"]) >= 0.65) & (share(x["escapes"]) < 0.05), F.lit(False))
            .otherwise(noise)
        )

    return F.when(c == "", F.lit(True)).otherwise(let(counts, verdict))


def semantic_loss(text) -> dict[str, Column]:
    """Counts of damaged formula encodings, their weighted score and the verdict (24 or more)."""
    # Patterns and weights.
    c = _c(text)
    found = {
        "octal": (_n(c, r"\\[0-2][0-7]{2}"), 3),
        "cid": (_n(c, r"\(cid:[0-9]+\)"), 4),
        "private_use": (_n(c, r"[-]"), 4),
        "replacement": (_n(c, "�"), 5),
        "ligature": (_n(c, r"(?:@|=|\\[0-7]{3})\s*(?:ff|fi|fl|ffi|ffl)(?![A-Za-z0-9_])"), 2),
    }
    score = sum((n * w for n, w in found.values()), F.lit(0))
    out = {k: n.cast("long") for k, (n, _) in found.items()}
    return out | {"score": score.cast("long"), "damaged": score >= 24}


def readable_stats(text) -> dict[str, Column]:
    c = F.regexp_replace(_c(text), "\r\n?", "\n")
    blocks = F.filter(F.split(c, "\n{2,}"), lambda b: (F.regexp_replace(b, WHITE, "") != "") & ~b.rlike(rf"^{WHITE}*\|"))
    return {
        "characters": F.length(c).cast("long"),
        "headings": _n(c, r"(?m)^#{1,6}\s+\S").cast("long"),
        "paragraphs": F.size(blocks).cast("long"),
    }


def table_count(text) -> Column:
    return _n(_c(text), r"\|[^\r\n]*\|\r?\n\|[\s\-|:]*\|").cast("long")


def headings(text) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(r"(?m)^[ \t]*(#{1,6}[ \t]+[^\n]*)$"), F.lit(1))


def mask_placeholders(text) -> Column:
    return F.array_distinct(F.regexp_extract_all(_c(text), F.lit(r"\[(?:MASK|MASKED)_[A-Z0-9_]+\]"), F.lit(0)))


def safe_file_name(text) -> Column:
    return F.regexp_replace(_c(text), r'[<>:"/\\|?*\x00-\x1F]', "_")


def escape_table_cell(text) -> Column:
    c = F.regexp_replace(_c(text), "\r\n?", "\n")
    return F.trim(F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>")))
