"""Exchange packages, front matter, settings and small keyed tables."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Settings with their defaults, the policy modes, and what hides a secret.
SETTINGS = {
    "defaultExportFormats": ["docx", "pdf"],
    "defaultAiModel": "",
    "defaultApiBaseUrl": "",
    "defaultQueryLimit": 500,
    "extractionQualityGate": "normal",
    "defaultPackagePath": "",
    "preferNewVersionOnRefresh": True,
    "policyMode": "open-core",
}
POLICIES = ("open-core", "team", "enterprise")
SECRET_NAME = r"(?i)key|token|password|secret"
HIDDEN = "[REDACTED_SECRET]"
SELECTIONS = ("ai_context_chunk_selected", "ai_context_range_selected", "ai_query_context_selected")


def front_matter(fields: dict) -> str:
    """Fields as ``key: JSON`` lines between marks."""
    lines = [f"{k}: {json.dumps(v, ensure_ascii=False)}" for k, v in fields.items()]
    return "\n".join(["---", *lines, "---", ""])


def parse_front_matter(text: str) -> tuple[dict, str]:
    """The fields and the rest of a text; values that are no JSON stay text."""
    m = re.match(r"---\r?\n(.*?)\r?\n---\r?\n?", text, re.S)
    if not m:
        return {}, text
    out = {}
    for line in m[1].splitlines():
        key, found, value = line.partition(":")
        if found:
            try:
                out[key.strip()] = json.loads(value)
            except ValueError:
                out[key.strip()] = value.strip()
    return out, text[m.end() :]


def front_matter_field(text: Column, key: str) -> Column:
    """One field of a text's front matter as JSON text, null where absent."""
    head = F.regexp_extract(text, r"\A---\r?\n([\s\S]*?)\r?\n---(?:\r?\n|\z)", 1)
    value = F.regexp_extract(head, rf"(?m)^{re.escape(key)}:[ \t]*(.*)$", 1)
    return F.when(value != "", value)


def exchange_markdown(fields: dict, body: str, sections: dict[str, str] | None = None) -> str:
    """A package's document: front matter, body, and further sections in order."""
    parts = [front_matter(fields) + "\n" + body.strip()]
    parts += [f"## {title}\n\n{text.strip()}" for title, text in (sections or {}).items() if text.strip()]
    return "\n\n".join(parts) + "\n"


def redacted(settings: Column) -> Column:
    """A map with the values of secret names hidden, and elsewhere those of a URL's ``token`` parameter."""
    url = F.regexp_replace

    def value(k: Column, v: Column) -> Column:
        in_url = F.contains(v, F.lit("?token=")) | F.contains(v, F.lit("&token="))
        hidden = url(v, r"([?&]token=)[^&]*", "$1" + HIDDEN.replace("[", r"\[").replace("]", r"\]"))
        return F.when(k.rlike(SECRET_NAME) & (v != ""), F.lit(HIDDEN)).when(in_url, hidden).otherwise(v)

    return F.transform_values(settings, value)


class SettingError(ValueError):
    """A setting's name or value that is not allowed; ``code`` says which."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def setting(key: str, value):
    """The value as its setting keeps it."""
    if key not in SETTINGS:
        raise SettingError("invalid_setting_key", f"no setting {key}")
    if key == "defaultQueryLimit":
        try:
            n = float(value if value not in (None, "") else 0)
        except ValueError:
            raise SettingError("invalid_setting_value", "defaultQueryLimit must be a number") from None
        return int(n) if n.is_integer() else n
    if key == "preferNewVersionOnRefresh":
        return value is True or value == "true"
    if key == "defaultExportFormats":
        if isinstance(value, str):
            return [x.strip() for x in value.split(",") if x.strip()]
        if not isinstance(value, list):
            raise SettingError("invalid_setting_value", "defaultExportFormats must be a list or text")
    if key == "policyMode":
        value = str("" if value is None else value).strip()
        if value not in POLICIES:
            raise SettingError("invalid_setting_value", f"policyMode must be one of {', '.join(POLICIES)}")
    return value


def settings_row(values: dict) -> dict:
    """All settings: the given ones checked, defaults for the rest."""
    return SETTINGS | {k: setting(k, v) for k, v in values.items()}


def upserted(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """A keyed table with new rows in the place of those that share their key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows.select(*table.columns))


PROFILE = ("id", "name", "api_base_url", "model")


def saved_profiles(table: DataFrame, rows: DataFrame) -> DataFrame:
    """API profiles with ``rows`` saved: one with a known id or name changes that profile, others are new.

    A profile keeps its id; keys and any other columns are not kept. A row without a name, an address
    or a model is refused.
    """
    said = [F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in PROFILE[1:]]
    new = rows.select(F.col("id").alias("new_id"), *said)
    for c, code in zip(PROFILE[1:], ("api_profile_name_required", "api_base_url_required", "api_model_required"), strict=True):
        new = new.withColumn(c, F.when(F.col(c) == "", F.raise_error(F.lit(code)).cast("string")).otherwise(F.col(c)))
    by_id = new.join(table.select("id"), F.col("new_id") == F.col("id"), "left")
    named = table.select(F.col("id").alias("named"), F.col("name"))
    found = by_id.join(named, "name", "left").withColumn("id", F.coalesce("id", "named", "new_id")).select(*PROFILE)
    return table.select(*PROFILE).join(found.select("id"), "id", "left_anti").unionByName(found)


def with_limits(rows: DataFrame, limits: DataFrame, codes: str = "codes") -> DataFrame:
    """Rows with the descriptions of their known limits (limits: code, action), in the codes' order."""
    keys = [c for c in rows.columns if c != codes]
    each = rows.select(*keys, F.posexplode_outer(codes).alias("pos", "code"))
    named = each.join(limits, "code", "left")
    got = F.array_sort(F.collect_list(F.when(F.col("action").isNotNull(), F.struct("pos", "action"))))
    return named.groupBy(*keys).agg(F.transform(got, lambda x: x["action"]).alias("actions"))


def _string(v: Column, path: str) -> Column:
    """The text at a path of a variant; null if there is none, or something else than text."""
    found = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(v, path, "string"))


def _part(p: Column) -> Column:
    return F.coalesce(_string(p, "$"), _string(p, "$.text"), _string(p, "$.text.value"), F.lit(""))


def _parts(parts: Column) -> Column:
    return F.array_join(F.filter(F.transform(parts, _part), lambda x: x != ""), "\n")


def provider_text(response: Column) -> Column:
    """The text of a model's answer: of the known layouts, in their order, the first that holds any.

    A first choice's text and the plain output text count as soon as they are there, even if empty.
    """
    none = F.array().cast("array<variant>")
    v = F.try_parse_json(response)
    every = lambda x, path: F.coalesce(F.try_variant_get(x, path, "array<variant>"), none)
    message = F.coalesce(_string(v, "$.choices[0].message.content"), _parts(every(v, "$.choices[0].message.content")))
    content = lambda item: F.coalesce(
        F.try_variant_get(item, "$.content", "array<variant>"), F.array_compact(F.array(F.try_variant_get(item, "$.content", "variant")))
    )
    output = _parts(F.flatten(F.transform(every(v, "$.output"), content)))
    told = F.flatten(F.transform(every(v, "$.candidates"), lambda c: every(c, "$.content.parts")))
    told = F.array_join(F.filter(F.transform(told, lambda p: F.coalesce(_string(p, "$.text"), F.lit(""))), lambda x: x != ""), "\n")
    return (
        F.when(message != "", message)
        .when(_string(v, "$.choices[0].text").isNotNull(), _string(v, "$.choices[0].text"))
        .when(_string(v, "$.output_text").isNotNull(), _string(v, "$.output_text"))
        .when(output != "", output)
        .otherwise(F.coalesce(told, F.lit("")))
    )


def capability(requests: DataFrame, matrix: DataFrame) -> DataFrame:
    """Requests (from, to) with the mode, quality and limits of the matrix; mode is unsupported where absent."""
    out = requests.join(matrix, ["from", "to"], "left")
    return out.withColumn("mode", F.coalesce("mode", F.lit("unsupported")))


def summary(samples: DataFrame, by: str) -> DataFrame:
    """Counts by a column; array columns count each element."""
    c = F.explode(by) if samples.schema[by].dataType.typeName() == "array" else F.col(by)
    return samples.select(c.alias(by)).groupBy(by).agg(F.count("*").alias("n"))


def manifest(log: DataFrame) -> DataFrame:
    """An evidence log by section: context selections, send-gate decisions, null for what a manifest leaves out."""
    section = F.when(F.col("kind").isin(*SELECTIONS), "aiContextSelections").when(F.coalesce("decision", F.lit("")) != "", "aiSendGateDecisions")
    return log.withColumn("section", section)


def manifest_events(events: DataFrame, kind: str = "kind") -> DataFrame:
    """A timeline by section: hand-off bundles, refresh history, null for what a manifest leaves out."""
    k = F.col(kind)
    return events.withColumn("section", F.when(k == "ai_handoff_bundle", "aiHandoffBundles").when(k.isin("refresh", "import"), "refreshHistory"))


def sensitive_path(path: Column) -> Column:
    """Whether a file's name has no place in a package."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return name.rlike(r"(?i)^(?:\.env.*|id_rsa.*|.*\.(?:pem|key|pfx|p12)|credentials.*|secrets?\..*)$")


def refresh_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes of headings, tables and characters of documents (doc_id, headings, tables, chars) between two states."""
    a, b = before.alias("a"), after.alias("b")
    delta = [(F.coalesce(f"b.{c}", F.lit(0)) - F.coalesce(f"a.{c}", F.lit(0))).alias(f"{c}_delta") for c in ("headings", "tables", "chars")]
    out = a.join(b, F.col("a.doc_id") == F.col("b.doc_id"), "full_outer").select(F.coalesce("a.doc_id", "b.doc_id").alias("doc_id"), *delta)
    return out.withColumn("changed", (F.col("headings_delta") != 0) | (F.col("tables_delta") != 0) | (F.col("chars_delta") != 0))


def rolling_hash(path: Column) -> Column:
    """A 32-bit hash of a path, by 31 times the hash so far plus each character: its size in hexadecimal digits."""
    units = F.transform(F.sequence(F.lit(1), F.length(path)), lambda i: F.ascii(F.substr(path, i, F.lit(1))))
    wrap = lambda x: F.pmod(x + (1 << 31), F.lit(1 << 32)) - (1 << 31)
    value = F.aggregate(units, F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + c))
    return F.when(F.length(path) == 0, "0").otherwise(F.lower(F.hex(F.abs(value))))


def feedback(records: DataFrame) -> DataFrame:
    """Records (id, type, status, path) without their paths: only a hash that tells equal ones is left."""
    named = F.concat(F.lit("[REDACTED_PATH_HASH_"), rolling_hash(F.col("path")), F.lit("]"))
    return records.select("id", "type", "status", F.when(F.coalesce("path", F.lit("")) != "", named).alias("path"))
