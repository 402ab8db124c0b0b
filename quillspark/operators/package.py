"""Exchange packages for many documents at once: their files, what a receiver can rely on, and the report for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange, governance

VERSION = 1
# Decisions of the send gate by how they weigh.
FAILING, WARNING = ("blocked", "never_send", "review_required"), ("review", "review_recommended")
# The condition, the risk and the action of each, in order.
GUIDANCE = (
    ("integrity", "Package hashes or manifest validation failed.", "Reject the package and ask the sender to regenerate it."),
    ("provenance", "Source record provenance is missing.", "Verify the source file before accepting the package."),
    ("markdown", "Canonical document.md is missing or empty.", "Regenerate the package with a non-empty Markdown document."),
    ("audit", "Audit trail is missing.", "Keep this package as preview-only until audit evidence is attached."),
    ("quality", "One or more conversions have low-confidence extraction quality.", "Review the Markdown before sending it to AI or exporting it externally."),
    ("limits", "Known format limits are declared for this package.", "Inspect knownLimits before relying on tables, images, formulas, or layout-sensitive content."),
    ("sanitized", "Sensitive raw files or credential-like values were detected.", "Do not share externally until the sensitive content is removed."),
    ("gate_fail", "AI Send Gate marked this content as blocked or requiring review.", "Do not send to AI until Send Gate issues are resolved."),
    ("gate_warning", "AI Send Gate recommends human review.", "Review the AI preview before confirming a send."),
    ("gate_unknown", "No AI Send Gate summary is attached.", "Run AI preparation or preview before using this package with a model."),
)
READY = "Package is ready for AI preview and external handoff under the declared policies."


def files(rows: DataFrame) -> DataFrame:
    """(id, path, content) of the package of each row: id, title, body, and where there is any evidence (JSON) and table (CSV).

    The manifest lists every other file with its hash, and holds no text of the document.
    """
    has = lambda c: c in rows.columns
    front = F.concat(F.lit("---\ntitle: "), F.to_json(F.array("title")), F.lit("\n---\n\n"))
    front = F.regexp_replace(front, r"(?m)^title: \[(.*)\]$", "title: $1")
    body = F.concat(front, F.regexp_replace(F.coalesce("body", F.lit("")), r"^\s+|\s+$", ""), F.lit("\n"))
    evidence = F.when(F.coalesce("evidence", F.lit("")) != "", F.concat("evidence", F.lit("\n"))).otherwise("") if has("evidence") else F.lit("")
    listed = [F.struct(F.lit("document.md").alias("path"), body.alias("content")), F.struct(F.lit("evidence.jsonl").alias("path"), evidence.alias("content"))]
    if has("table"):
        listed.append(F.when(F.col("table").isNotNull(), F.struct(F.lit("tables/query_result.csv").alias("path"), F.col("table").alias("content"))))
    d = rows.select("id", "title", F.array_compact(F.array(*listed)).alias("files"))
    named = F.transform("files", lambda f: F.struct(f["path"].alias("path"), F.concat(F.lit("sha256:"), F.sha2(f["content"], 256)).alias("hash")))
    manifest = F.to_json(F.struct(F.lit(VERSION).alias("version"), "title", named.alias("files")))
    every = F.concat("files", F.array(F.struct(F.lit("manifest.json").alias("path"), manifest.alias("content"))))
    return d.select("id", F.explode(every).alias("f")).select("id", "f.path", "f.content")


def integrity(package_files: DataFrame) -> DataFrame:
    """(id, integrity): pass if a package's manifest and files agree, else fail."""
    man = package_files.filter("path = 'manifest.json'")
    listed = man.select("id", F.explode(F.from_json(F.get_json_object("content", "$.files"), "array<struct<path: string, hash: string>>")).alias("f"))
    listed = listed.select("id", "f.path", "f.hash")
    own = package_files.filter("path <> 'manifest.json'").select("id", "path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("actual"))
    met = listed.join(own, ["id", "path"], "full_outer").withColumn("good", F.col("hash").eqNullSafe(F.col("actual")))
    ids = package_files.select("id").distinct()
    found = met.groupBy("id").agg(F.bool_and("good").alias("good")).join(man.select("id"), "id", "left_semi")
    return ids.join(found, "id", "left").select("id", F.when(F.col("good"), "pass").otherwise("fail").alias("integrity"))


def gate_state(decisions: Column) -> Column:
    """fail, warning, pass or unknown (no decisions) for the send gate's decisions."""
    d = F.coalesce(decisions, F.array().cast("array<string>"))
    known = lambda names: F.arrays_overlap(d, F.array(*map(F.lit, names)))
    return F.when(known(FAILING), "fail").when(known(WARNING), "warning").when(F.size(d) > 0, "pass").otherwise("unknown")


def explained(packages: DataFrame) -> DataFrame:
    """id, gate, ai_ready, sharing, risks, actions and verdict.

    Packages have id, integrity and sanitized (pass or fail), version, sources (their number), bytes of
    the document, audited, low_confidence, limits (their number) and decisions of the send gate.
    """
    bad = {
        "integrity": F.col("integrity") != "pass", "provenance": F.col("sources") == 0, "markdown": F.col("bytes") == 0, "audit": ~F.col("audited"),
        "quality": F.col("low_confidence"), "limits": F.col("limits") > 0, "sanitized": F.col("sanitized") != "pass",
        "gate_fail": F.col("gate") == "fail", "gate_warning": F.col("gate") == "warning", "gate_unknown": F.col("gate") == "unknown",
    }
    d = packages.withColumn("gate", gate_state(F.col("decisions")))
    told = lambda at: F.array_compact(F.array(*(F.when(bad[g[0]], F.lit(g[at])) for g in GUIDANCE)))
    state = lambda c: F.when(c, "fail").otherwise("pass")
    verdict = governance.verdict(
        F.col("integrity"), F.col("sanitized"), F.col("gate"), F.col("version"), F.when(bad["quality"], "warning").otherwise("pass"), state(bad["audit"]), state(bad["provenance"]), F.col("limits")
    )
    passing = F.col("gate") != "fail"
    return d.select(
        "id",
        "gate",
        F.when(~bad["markdown"] & ~bad["quality"] & passing, "pass").otherwise("warning").alias("ai_ready"),
        F.when(~bad["sanitized"] & ~bad["integrity"] & passing, "pass").otherwise("warning").alias("sharing"),
        told(1).alias("risks"),
        F.when(F.size(told(2)) > 0, F.array_distinct(told(2))).otherwise(F.array(F.lit(READY))).alias("actions"),
        verdict.alias("verdict"),
    )


def receiver_report(rows: DataFrame) -> Column:
    """A report for the receiver from the columns of :func:`explained` and the package's title."""
    listed = lambda c: F.concat(F.lit("- "), F.array_join(c, "\n- "))
    head = F.concat(F.lit("# Receiver report: "), "title", F.lit("\n\n- Verdict: "), "verdict", F.lit("\n- Send gate: "), "gate", F.lit("\n- AI readiness: "), "ai_ready", F.lit("\n- External sharing: "), "sharing")
    risks = F.when(F.size("risks") > 0, listed("risks")).otherwise("- none")
    return F.concat(head, F.lit("\n\n## Risks\n\n"), risks, F.lit("\n\n## Actions\n\n"), listed("actions"), F.lit("\n"))


def leaks(package_files: DataFrame) -> DataFrame:
    """(id, path, reason) of files that have no place in a package: sensitive names, or secrets in the manifest."""
    from .gate import PATTERNS

    secret = F.col("content").rlike(PATTERNS["api_key"]) | F.col("content").rlike(PATTERNS["bearer"]) | F.col("content").rlike(PATTERNS["private_key"])
    reason = F.when(exchange.sensitive_path(F.col("path")), "sensitive_path").when((F.col("path") == "manifest.json") & secret, "secret_in_manifest")
    return package_files.select("id", "path", reason.alias("reason")).filter("reason is not null")
