"""Risk signals of a text, and what may be sent on their account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

_A, _B = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_UUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}"
# The patterns of the signals.
PATTERNS = {
    "email": r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}",
    "phone": rf"(?:{_A}[0-9]|{_B}(?<=[A-Za-z0-9_])\+[0-9])[0-9\s().-]{{7,}}[0-9]{_B}",
    "label": rf"(?i)(?:{_A}(?:api[_-]?key|access[_-]?key(?:[_-]?id)?|secret[_-]?access[_-]?key|client[_-]?secret|secret|password|token){_B}|密码|口令|密钥)\s*[:=：]",
    "bearer": rf"(?i){_A}(?:authorization\s*[:=]\s*Bearer\s+|Bearer\s+)[a-zA-Z0-9._~+/=-]{{12,}}",
    "api_key": rf"(?i){_A}(?:sk-[a-zA-Z0-9_-]{{6,}}|key-[a-zA-Z0-9_-]{{6,}}|(?:AKIA|ASIA|LTAI|AIza)[a-zA-Z0-9_-]{{12,}}|(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9_]{{20,}}|(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{{16,}}|xox[abprs]-[A-Za-z0-9-]{{20,}}){_B}",
    "private_key": r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY-----",
    "uuid_token": rf"(?i){_A}(?:token|session[_-]?token|auth[_-]?token|credential[_-]?id){_B}\s*[:=]\s*{_UUID}{_B}",
    "local_only": rf"(?i){_A}local-only{_B}|<!--\s*local-only\s*-->",
    "id_number": rf"{_A}[0-9]{{17}}[0-9Xx]{_B}|{_A}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_B}",
    "table": r"\|[\s\-|:]*\|",
}
LONG = 10_000


def signals(text: Column, external: Column | None = None, low_quality: Column | None = None) -> Column:
    """The signals of a text in a fixed order, each once."""
    t = F.coalesce(text, F.lit(""))
    has = lambda *parts: F.greatest(F.lit(False), *(F.contains(t, F.lit(x)) for x in parts))
    # what a match cannot do without, as a cheap test before the pattern
    first = {"email": has("@"), "label": has(":", "=", "："), "private_key": has("-----BEGIN"), "uuid_token": has(":", "="), "table": has("|")}
    marks = F.struct(*((first[k] & t.rlike(p) if k in first else t.rlike(p)).alias(k) for k, p in PATTERNS.items()))
    no = F.lit(False)

    def named(on: Column) -> Column:
        credential = on["label"] | on["bearer"] | on["private_key"] | on["uuid_token"]
        found = [
            (on["email"], "email"),
            (on["phone"], "phone_or_numeric_identifier"),
            (on["phone"], "phone"),
            (credential, "credential_like_text"),
            (on["bearer"], "bearer_token_like"),
            (on["api_key"], "api_key_like"),
            (on["uuid_token"], "uuid_token_like"),
            (on["local_only"], "local_only_marker"),
            (on["id_number"], "id_number_like"),
            (F.length(t) > LONG, "long_context"),
            (on["table"], "table_included"),
            (no if external is None else F.coalesce(external, no), "external_source_included"),
            (no if low_quality is None else F.coalesce(low_quality, no), "low_quality_extraction"),
        ]
        return F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in found)))

    return let(marks, named)


def decision(s: Column) -> Column:
    has = lambda x: F.array_contains(s, x)
    return (
        F.when(has("local_only_marker"), "never_send")
        .when(has("credential_like_text") | has("api_key_like") | has("low_quality_extraction"), "review_required")
        .when(F.size(s) > 0, "review_recommended")
        .otherwise("selected_context_preview")
    )


def standard(d: Column) -> Column:
    return F.when(d == "never_send", "block").when(d.isin("review_recommended", "review_required"), "review_required").otherwise("allow")


def quality(low: Column, limited: Column) -> Column:
    return F.when(low, 0.5).when(limited, 0.8).otherwise(1.0)


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", low_quality: Column | None = None) -> DataFrame:
    """key, signals, decision and standard decision of every row."""
    d = docs.select(key, signals(F.col(text), low_quality=low_quality).alias("signals"))
    d = d.withColumn("decision", decision(F.col("signals")))
    return d.withColumn("standard", standard(F.col("decision")))


# What each signal means to the reader.
REASONS = {
    "api_key_like": "Found a value that looks like an API key or cloud access key.",
    "bearer_token_like": "Found an Authorization Bearer token pattern.",
    "credential_like_text": "Found text pattern resembling API keys or credentials.",
    "email": "Found email address pattern.",
    "external_source_included": "The staged context comes from an imported local source file.",
    "id_number_like": "Found a value that looks like a personal or government identifier.",
    "local_only_marker": "Found a local-only marker that must not be sent to an AI provider.",
    "long_context": "The staged context is large and should be reviewed or chunked before sending.",
    "low_quality_extraction": "The source extraction has low confidence or OCR/layout warnings.",
    "phone": "Found phone number pattern.",
    "phone_or_numeric_identifier": "Found phone number or long numeric identifier pattern.",
    "table_included": "The staged context includes table rows; filter to the needed rows when possible.",
    "uuid_token_like": "Found a credential-labeled UUID token pattern.",
}
# Actions, and the signals that call for each.
REQUIRED = (
    ("Remove or mask credentials, API keys, tokens, and secrets.", ("credential_like_text", "api_key_like", "bearer_token_like", "uuid_token_like")),
    ("Review extraction quality before relying on or sending this context.", ("low_quality_extraction",)),
)
OPTIONAL = (
    ("Run automatic mask/redaction filter before sharing externally.", ("email", "phone", "phone_or_numeric_identifier", "id_number_like")),
    ("Use AI Will See chunk or range review instead of sending the full context at once.", ("long_context",)),
    ("Filter the table locally and send only the relevant rows.", ("table_included",)),
    ("Confirm the imported source file is approved for AI use.", ("external_source_included",)),
)
ON_BLOCK = "Remove local-only markers and any sensitive credentials before sending."
ON_REVIEW = "Verify target AI endpoint and confirm data sanitization."


def guidance(s: Column, standard_decision: Column) -> dict[str, Column]:
    """Reasons, required and optional actions for the signals of a text."""
    asked = lambda rules: [F.when(F.arrays_overlap(s, F.array(*map(F.lit, names))), F.lit(text)) for text, names in rules]
    reasons = F.create_map(*(F.lit(x) for pair in REASONS.items() for x in pair))
    required = F.array_compact(F.array(F.when(standard_decision == "block", F.lit(ON_BLOCK)), *asked(REQUIRED)))
    fallback = F.when((F.size(required) == 0) & (standard_decision == "review_required"), F.array(F.lit(ON_REVIEW)))
    return {
        "reasons": F.transform(s, lambda x: F.coalesce(F.try_element_at(reasons, x), F.concat(F.lit("Detected signal: "), x))),
        "required": F.coalesce(fallback, required),
        "optional": F.array_compact(F.array(*asked(OPTIONAL))),
    }


def payload_table_rows(text: Column) -> Column:
    """How many lines of a payload start and end with a pipe."""
    edge = r"^\s*\|(?:.*\|)?\s*$"
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(edge))).cast("long")


def confirmed_request(text: Column, s: Column, confirmed: Column, override: Column, reason: Column) -> dict[str, Column]:
    """``code``: null if a request may go out, else why not; ``reason_hash``: of the reason a quality block was lifted with.

    Only low quality can be lifted, and only with a reason; local-only text and credentials never.
    """
    d = decision(s)
    has = lambda x: F.array_contains(s, x)
    given = F.trim(F.regexp_replace(F.coalesce(reason, F.lit("")), r"\s", " ")) != ""
    lifted = has("low_quality_extraction") & ~has("credential_like_text") & ~has("api_key_like") & F.coalesce(override, F.lit(False))
    code = (
        F.when(~F.coalesce(confirmed, F.lit(False)), "ai_confirmation_required")
        .when(~F.coalesce(text, F.lit("")).rlike(r"\S"), "ai_content_empty")
        .when(d == "never_send", "ai_send_gate_review_required")
        .when((d == "review_required") & ~lifted, "ai_send_gate_review_required")
        .when((d == "review_required") & ~given, "ai_override_reason_required")
    )
    hashed = F.concat(F.lit("sha256:"), F.sha2(reason, 256))
    return {"code": code, "reason_hash": F.when(code.isNull() & (d == "review_required"), hashed)}


def confirmable(d: Column, confirmed: Column, reason: Column) -> Column:
    """Whether a request may go out: confirmed, never on a hard block, and with a reason where one is due."""
    due = d.isin("review_required", "review_recommended")
    return F.coalesce(confirmed, F.lit(False)) & (d != "never_send") & (~due | (F.length(F.trim(F.coalesce(reason, F.lit("")))) > 0))


def signal_counts(judged_rows: DataFrame) -> DataFrame:
    return judged_rows.select(F.explode("signals").alias("signal")).groupBy("signal").agg(F.count("*").alias("n"))
