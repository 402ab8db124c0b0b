"""The library's own queries and their DuckDB counterparts, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import coerce, text
from .operators import chunks, exchange, gate, governance, lines, masking, readable
from .plans.engine import Engine
from .sources import csv_source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def dialect(name: str, tables: str, statement: str, oracle: str, unbounded: bool = True) -> None:
    """Registers a statement of the dialect over driver tables."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        e = Engine(spark)
        for t in tables.split():
            e.register(t, _t(spark, d, t))
        return e.plan(statement, unbounded=unbounded)

    query(name, oracle)(run)


dialect("sql_filter_numeric", "lineitem", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity > 45", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity > 45")
dialect("sql_filter_string_ci", "orders", "select o_orderkey, o_orderpriority from orders where o_orderpriority = '1-urgent'", "select o_orderkey, o_orderpriority from orders where lower(o_orderpriority) = '1-urgent'")
dialect("sql_filter_like_ci", "part", "select p_partkey, p_brand from part where p_brand like 'bRAND_1%'", "select p_partkey, p_brand from part where lower(p_brand) like 'brand_1%'")
dialect("sql_project_alias", "customer", "select c_custkey as id, c_name as who from customer", "select c_custkey as id, c_name as who from customer")
dialect("sql_scalar_functions", "customer", "select c_custkey, upper(c_name) as u, lower(c_mktsegment) as l, substr(c_name,2,4) as s, substr(c_name,5) as r from customer", "select c_custkey, upper(c_name) as u, lower(c_mktsegment) as l, substr(c_name,2,4) as s, substr(c_name,5) as r from customer")
dialect("sql_group_multi", "lineitem", "select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as qty, avg(l_quantity) as mean, max(l_discount) as disc from lineitem group by l_returnflag, l_linestatus", "select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as qty, avg(l_quantity) as mean, max(l_discount) as disc from lineitem group by all")
dialect("sql_group_minmax", "part", "select p_brand, min(p_size) as lo, max(p_size) as hi, min(p_type) as t from part group by p_brand", "select p_brand, min(p_size)::double as lo, max(p_size)::double as hi, min(p_type) as t from part group by p_brand")
dialect("sql_count_nonempty", "events", "select event_type, count(props) as n, count(1) as every from events group by event_type", "select event_type, count(nullif(props, '')) as n, count(*) as every from events group by event_type")
dialect("sql_global_agg", "orders", "select count(*) as n, min(o_orderkey) as lo, max(o_orderkey) as hi from orders", "select count(*) as n, min(o_orderkey)::double as lo, max(o_orderkey)::double as hi from orders")
dialect("sql_global_agg_empty", "orders", "select count(*) as n from orders where o_orderkey < 0", "select count(*) as n from orders where o_orderkey < 0 having count(*) > 0")
dialect("sql_order_alias_topk", "customer", "select c_custkey as id from customer order by id desc limit 20", "select c_custkey as id from customer order by id desc limit 20", unbounded=False)
dialect("sql_limit_clamp", "orders", "select o_orderkey from orders order by o_orderkey limit 5000", "select o_orderkey from orders order by o_orderkey limit 1000", unbounded=False)
dialect("sql_limit_default", "orders", "select o_orderkey from orders order by o_orderkey desc", "select o_orderkey from orders order by o_orderkey desc limit 500", unbounded=False)
dialect("sql_join", "orders customer", "select orders.o_orderkey as k, customer.c_name as who from orders join customer on o_custkey = c_custkey", "select o_orderkey as k, c_name as who from orders join customer on o_custkey = c_custkey")
dialect("sql_join_group", "customer nation", "select n_name, count(*) as n, sum(c_acctbal) as bal from customer inner join nation on customer.c_nationkey = nation.n_nationkey group by n_name", "select n_name, count(*) as n, sum(c_acctbal) as bal from customer join nation on c_nationkey = n_nationkey group by n_name")
dialect("sql_wildcard", "nation", "select * from nation", "select * from nation")


@query("sql_group_first_value", "select o_orderstatus, arg_min(o_orderkey, o_orderkey) as first_key, count(*) as n from orders group by o_orderstatus")
def _(spark, d):
    e = Engine(spark)
    e.register("orders", _t(spark, d, "orders").orderBy("o_orderkey"))
    return e.plan("select o_orderstatus, o_orderkey as first_key, count(*) as n from orders group by o_orderstatus", unbounded=True)


@query("join_empty_null_keys", "select a.x as x, b.y as y from (values (1,''),(2,null),(3,'k')) a(x,k) join (values (7,''),(8,null),(9,'K'),(10,'k')) b(y,k) on coalesce(a.k,'')=coalesce(b.k,'')")
def _(spark, d):
    e = Engine(spark)
    e.register("a", spark.createDataFrame([(1, ""), (2, None), (3, "k")], "x int, k string"))
    e.register("b", spark.createDataFrame([(7, ""), (8, None), (9, "K"), (10, "k")], "y int, k string"))
    return e.plan("select x, y from a join b on a.k = b.k", unbounded=True)


_NUMBERS = [(" 12 ", 12.0), ("", 0.0), ("0x10", 16.0), ("0b11", 3.0), ("0o17", 15.0), ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0), ("1d", None), ("1_000", None), ("inf", None), ("abc", None), ("-7", -7.0), ("+3", 3.0), ("\u3000 4", 4.0)]


@query("coerce_js_number", "select * from (values " + ", ".join(f"('{t}', {'null' if v is None else v}::double)" for t, v in _NUMBERS) + ") v(t, n)")
def _(spark, d):
    return spark.createDataFrame([(t,) for t, _ in _NUMBERS], "t string").select("t", coerce.js_num(F.col("t")).alias("n"))


@query("list_tables", "select 'nation' as name, 3::bigint as n_columns union all select 'region', 2")
def _(spark, d):
    e = Engine(spark)
    for t in ("nation", "region"):
        e.register(t, _t(spark, d, t))
    return e.list_tables().select("name", F.size("columns").cast("long").alias("n_columns"))


@query("infer_column_types", "select * from (values ('c_custkey','number',false),('c_name','string',false),('c_nationkey','number',false),('c_acctbal','number',false),('c_mktsegment','string',false)) v(name,type,nullable)")
def _(spark, d):
    return csv_source.infer_types(_t(spark, d, "customer"))


@query("sink_csv_lines", "select n_nationkey || ',' || n_name || ',' || n_regionkey as line from nation")
def _(spark, d):
    return csv_source.csv_lines(_t(spark, d, "nation"))


@query("sink_markdown_table", "select '| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |' as line from nation")
def _(spark, d):
    return csv_source.markdown_lines(_t(spark, d, "nation"))


@query("doc_token_estimate", "select doc_id, ceil(length(text)/4.0)::bigint as tokens, greatest(1, ceil(length(text)/4.0)::bigint) as counted from documents")
def _(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.token_estimate("text").alias("tokens"), text.token_count("text").alias("counted"))


@query("doc_text_metrics", r"""select doc_id, length(text) as chars, len(regexp_extract_all(text, '\x{FFFD}'))::bigint as replacement_chars,
round(len(regexp_extract_all(text, '[\x00-\x7F]')) / length(text), 9) as ascii_ratio,
round(len(regexp_extract_all(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]')) / length(text), 9) as non_printable_ratio from documents""")
def _(spark, d):
    m = text.metrics("text")
    return _t(spark, d, "documents").select(
        "doc_id", m["chars"].alias("chars"), m["replacement_chars"].alias("replacement_chars"),
        F.round(m["ascii_ratio"], 9).alias("ascii_ratio"), F.round(m["non_printable_ratio"], 9).alias("non_printable_ratio"),
    )


@query("doc_content_hash", "select doc_id, 'sha256:' || sha256(text) as hash from documents")
def _(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.content_hash("text", True).alias("hash"))


@query("doc_clip", "select doc_id, case when length(text) <= 280 then text else left(text, 130) || chr(10) || '...[clipped]...' || chr(10) || right(text, 130) end as clip from documents")
def _(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.clip("text").alias("clip"))


@query("doc_mojibake", r"""with p as (select doc_id, length(regexp_replace(text, '\s', '', 'g')) as p, len(regexp_extract_all(text, '\x{FFFD}')) as r from documents)
select doc_id, p >= 80 and r >= 20 and r / greatest(p, 1) > 0.04 as mojibake from p""")
def _(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.high_mojibake("text").alias("mojibake"))


@query("doc_low_readable", r"""with a as (select doc_id, text, length(regexp_replace(text, '[\t\n\x0B\f\r \x{00A0}\x{3000}]', '', 'g')) as p,
len(regexp_extract_all(text, '\\(?:[0-7]{2,3}|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|[nrt()\\])')) as e, len(regexp_extract_all(text, '[\p{L}\p{N}]')) as r,
len(regexp_extract_all(text, '(?:[0-9A-Fa-f]{2}\s*){12,}')) as h, len(regexp_extract_all(text, '[\x{FFFD}\x{25A1}]|[\x{00C0}-\x{024F}]')) as m from documents)
select doc_id, case when text = '' then true when p > 0 and r / p >= 0.65 and e / p < 0.05 then false
else e >= 3 or h > 0 or (p >= 24 and r / p < 0.35) or (p >= 80 and m / p > 0.12) end as low from a""")
def _(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.low_readable("text").alias("low"))


@query("doc_semantic_loss", r"""with c as (select doc_id, len(regexp_extract_all(text, '\\[0-2][0-7]{2}'))*3 + len(regexp_extract_all(text, '\(cid:[0-9]+\)'))*4
+ len(regexp_extract_all(text, '[\x{E000}-\x{F8FF}]'))*4 + len(regexp_extract_all(text, '\x{FFFD}'))*5 + len(regexp_extract_all(text, '(?:@|=|\\[0-7]{3})\s*(?:ff|fi|fl|ffi|ffl)\b'))*2 as score from documents)
select doc_id, score::bigint as score, score >= 24 as damaged from c""")
def _(spark, d):
    m = text.semantic_loss("text")
    return _t(spark, d, "documents").select("doc_id", m["score"].alias("score"), m["damaged"].alias("damaged"))


@query("doc_readable_stats", r"select doc_id, length(text) as characters, len(regexp_extract_all(text, '(?m)^#{1,6}\s+\S'))::bigint as headings, len(list_filter(regexp_split_to_array(text, '\n{2,}'), lambda b: trim(b, E' \t\n\r') <> '' and not starts_with(trim(b, E' \t\n\r'), '|')))::bigint as paragraphs from documents")
def _(spark, d):
    m = text.readable_stats("text")
    return _t(spark, d, "documents").select("doc_id", *(c.alias(k) for k, c in m.items()))


_CHUNKS = """c as (select doc_id, length(text) as n, case when length(text) = 0 then 0 else ceil(greatest(1, length(text) - 800) / 11200.0)::bigint end as k from documents),
x as (select doc_id, n, unnest(range(1, k + 1)) as idx, k from c),
parts as (select doc_id, idx, (idx - 1) * 11200 as start_char, least(n, (idx - 1) * 11200 + 12000) as end_char, k from x),
p as (select *, ceil((end_char - start_char) / 4.0)::bigint as tokens from parts)"""


@query("doc_chunks", f"with {_CHUNKS} select doc_id, idx, start_char, end_char, tokens from p")
def _(spark, d):
    return chunks.chunks(_t(spark, d, "documents"))


_PLAN = """plan as (select doc_id, ceil(length(text)/4.0)::bigint as tokens, case when length(text) = 0 then 0 else ceil(greatest(1, length(text) - 800) / 11200.0)::bigint end as chunks from documents)"""


@query("doc_intake_plan", f"with {_PLAN} select doc_id, tokens, chunks, ceil(chunks / 3.0)::bigint as ranges, case when chunks <= 1 then 'single_context' when tokens > 6000 then 'chunked_large_document' else 'chunked_context' end as mode, case when chunks > 1 then 'context_should_be_sent_in_chunks' else '' end as warnings from plan")
def _(spark, d):
    p = chunks.intake_plan(_t(spark, d, "documents"))
    return p.select("doc_id", "tokens", "chunks", "ranges", "mode", F.array_join("warnings", ",").alias("warnings"))


@query("doc_feeding_plan", f"with {_PLAN} select doc_id, case when tokens >= 250000 or chunks >= 80 then 'ultra_large' when chunks > 1 or tokens > 6000 then 'large' else 'normal' end as priority, ceil(chunks / 3.0)::bigint as batches, (chunks > 1 or tokens > 6000) as loop_ready from plan")
def _(spark, d):
    return chunks.feeding_plan(chunks.intake_plan(_t(spark, d, "documents"))).select("doc_id", "priority", "batches", "loop_ready")


@query("doc_batches", f"with {_PLAN}, b as (select doc_id, chunks, unnest(range(1, ceil(chunks / 3.0)::bigint + 1)) as batch_index from plan) select doc_id, batch_index, (batch_index - 1) * 3 + 1 as first_chunk, least((batch_index - 1) * 3 + 3, chunks) as last_chunk from b")
def _(spark, d):
    return chunks.batches(chunks.intake_plan(_t(spark, d, "documents")))


@query("doc_range_bundle", f"with {_CHUNKS}, r as (select *, sum(tokens) over (partition by doc_id order by idx) as run from p), t as (select * from r where run <= 9000 or idx = 1) select doc_id, min(idx) as first_chunk, max(idx) as last_chunk, sum(tokens)::bigint as tokens, max(idx) < max(k) as truncated from t group by doc_id")
def _(spark, d):
    return chunks.bundle(chunks.chunks(_t(spark, d, "documents"))).drop("next_chunk")


@query("doc_content_hash_dedup", "select sha256(text) as hash, min(doc_id) as first, count(*) as n from documents group by 1 having count(*) > 1")
def _(spark, d):
    return governance.duplicates(_t(spark, d, "documents"))


@query("doc_change_detect", "with a as (select doc_id, n_chars as m, sha256(text) as h from documents where doc_id % 7 <> 0), b as (select doc_id, case when doc_id % 5 = 0 then 0 else n_chars end as m, case when doc_id % 10 = 0 then 'x' else sha256(text) end as h from documents where doc_id % 11 <> 0) select coalesce(a.doc_id, b.doc_id)::varchar as path, case when b.doc_id is null then 'new' when a.doc_id is null then 'missing' when a.m = b.m then 'unchanged' when a.h = b.h then 'touched' else 'changed' end as state from a full join b using (doc_id)")
def _(spark, d):
    x = _t(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("mtime"), F.sha2("text", 256).alias("hash"))
    old = x.filter("doc_id % 11 <> 0").select("path", F.when(F.expr("doc_id % 5 = 0"), 0).otherwise(F.col("mtime")).alias("mtime"), F.when(F.expr("doc_id % 10 = 0"), "x").otherwise(F.col("hash")).alias("hash"))
    return governance.changes(x.filter("doc_id % 7 <> 0"), old)


@query("doc_versions", "select doc_id, source as path, row_number() over (partition by source order by doc_id) as version from documents")
def _(spark, d):
    return lines.versions(_t(spark, d, "documents").select("doc_id", F.col("source").alias("path")), "path", "doc_id")


_LINES = r"l as (select doc_id, unnest(string_split_regex(text, '\r?\n')) as line, generate_subscripts(string_split_regex(text, '\r?\n'), 1) as line_no from documents)"


@query("line_search_top10", rf"with {_LINES}, h as (select *, count(*) over (partition by doc_id) as matches, row_number() over (partition by doc_id order by line_no) as rn from l where contains(lower(line), 'thea')) select doc_id, matches, line_no, trim(line, E' \t') as line from h where rn <= 10")
def _(spark, d):
    return lines.search(_t(spark, d, "documents"), " TheA ")


@query("line_search", rf"with {_LINES} select doc_id, count(*) as matches from l where contains(lower(line), 'thea') group by doc_id")
def _(spark, d):
    return lines.search_counts(_t(spark, d, "documents"), "thea")


@query("line_diff", r"with a as (select doc_id, unnest(string_split(text, E'\n')) as line, generate_subscripts(string_split(text, E'\n'), 1) as line_no from documents), b as (select doc_id, unnest(string_split(replace(text, 'the', 'THE'), E'\n')) as line, generate_subscripts(string_split(replace(text, 'the', 'THE'), E'\n'), 1) as line_no from documents) select doc_id, line_no, a.line as old_line, b.line as new_line from a full join b using (doc_id, line_no) where a.line is distinct from b.line")
def _(spark, d):
    a = _t(spark, d, "documents").select("doc_id", "text")
    return lines.diff(a, a.withColumn("text", F.replace("text", F.lit("the"), F.lit("THE"))))


@query("readable_view")
def _(spark, d):
    return readable.readable_view(_t(spark, d, "documents"))


_SIGNALS = r"""s as (select doc_id, list_filter([
case when regexp_matches(text, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}') then 'email' end,
case when regexp_matches(text, '\b(?:\+?[0-9][0-9\s().-]{7,}[0-9])\b') then 'phone_or_numeric_identifier' end,
case when regexp_matches(text, '\b(?:\+?[0-9][0-9\s().-]{7,}[0-9])\b') then 'phone' end,
case when regexp_matches(text, '(?i)(?:\b(?:api[_-]?key|access[_-]?key(?:[_-]?id)?|secret[_-]?access[_-]?key|client[_-]?secret|secret|password|token)\b)\s*[:=]') or regexp_matches(text, '(?i)\b(?:authorization\s*[:=]\s*Bearer\s+|Bearer\s+)[a-zA-Z0-9._~+/=-]{12,}') or regexp_matches(text, '-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----') then 'credential_like_text' end,
case when regexp_matches(text, '(?i)\b(?:authorization\s*[:=]\s*Bearer\s+|Bearer\s+)[a-zA-Z0-9._~+/=-]{12,}') then 'bearer_token_like' end,
case when regexp_matches(text, '(?i)\b(?:sk-[a-zA-Z0-9_-]{6,}|key-[a-zA-Z0-9_-]{6,}|(?:AKIA|ASIA|LTAI|AIza)[a-zA-Z0-9_-]{12,}|(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9_]{20,}|(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{20,})\b') then 'api_key_like' end,
case when regexp_matches(text, '(?i)\blocal-only\b') then 'local_only_marker' end,
case when regexp_matches(text, '\b[0-9]{17}[0-9Xx]\b|\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b') then 'id_number_like' end,
case when length(text) > 10000 then 'long_context' end,
case when regexp_matches(text, '\|[\s\-|:]*\|') then 'table_included' end], lambda x: x is not null) as signals from documents),
g as (select doc_id, signals, case when list_contains(signals, 'local_only_marker') then 'never_send' when list_contains(signals, 'credential_like_text') or list_contains(signals, 'api_key_like') then 'review_required' when len(signals) > 0 then 'review_recommended' else 'selected_context_preview' end as decision from s)"""


@query("gate_signals", f"with {_SIGNALS} select doc_id, array_to_string(signals, ',') as signals from g")
def _(spark, d):
    return gate.judged(_t(spark, d, "documents")).select("doc_id", F.array_join("signals", ",").alias("signals"))


@query("gate_decision", f"with {_SIGNALS} select doc_id, decision, case when decision = 'never_send' then 'block' when decision in ('review_required', 'review_recommended') then 'review_required' else 'allow' end as standard from g")
def _(spark, d):
    return gate.judged(_t(spark, d, "documents")).select("doc_id", "decision", "standard")


@query("gate_signal_counts", f"with {_SIGNALS} select unnest(signals) as signal, count(*) as n from g group by 1")
def _(spark, d):
    return gate.signal_counts(gate.judged(_t(spark, d, "documents")))


@query("pii_detector_counts", r"""select doc_id, len(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}'))::bigint as emails,
len(regexp_extract_all(text, '\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b'))::bigint as ips,
len(list_filter(list_transform(regexp_extract_all(text, '\b(?:[0-9]{13,19}|(?:[0-9]{4} ){3}[0-9]{4}(?: [0-9]{3})?)\b'), lambda x: replace(x, ' ', '')),
  lambda x: list_sum(list_transform(range(1, length(x) + 1), lambda i: case when (length(x) - i) % 2 = 0 then substr(x, i, 1)::int else (substr(x, i, 1)::int * 2) // 10 + (substr(x, i, 1)::int * 2) % 10 end)) % 10 = 0))::bigint as cards from documents""")
def _(spark, d):
    found = masking.detected(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", found["email"].alias("emails"), found["ip"].alias("ips"), found["cn_bank_card_luhn"].alias("cards"))


@query("mask_documents")
def _(spark, d):
    return masking.masked(_t(spark, d, "documents")).select("doc_id", "masked", F.size("mapping").alias("n"))


@query("mask_roundtrip", "select count(*) as n, count(*) as equal from documents")
def _(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text")
    back = docs.select("text", masking.mask()(F.col("text")).alias("m"))
    same = masking.unmask(F.col("m.masked"), F.col("m.mapping")) == F.col("text")
    return back.agg(F.count("*").alias("n"), F.count(F.when(same, 1)).alias("equal"))


@query("mask_by_type")
def _(spark, d):
    return masking.counts_by_type(masking.masked(_t(spark, d, "documents")))


@query("quality_state", "select doc_id, case when length(text) < 100 then 'low' when contains(text, chr(65533)) then 'medium' else 'high' end as confidence, greatest(1, ceil(length(text) / 2000.0)::bigint) as pages from documents")
def _(spark, d):
    no = F.lit(False)
    q = governance.quality_state(F.length("text"), no, F.contains(F.col("text"), F.lit("\ufffd")), no, no)
    return _t(spark, d, "documents").select("doc_id", q["confidence"].alias("confidence"), q["pages"].alias("pages"))


@query("trust_verdict", "select doc_id, case when toxic = 1 then 'blocked' when quality = 0 then 'trusted_with_warnings' else 'trusted' end as verdict from labels")
def _(spark, d):
    ok = F.lit("pass")
    v = governance.verdict(ok, F.when(F.col("toxic") == 1, "fail").otherwise("pass"), ok, F.lit(1), F.when(F.col("quality") == 0, "warning").otherwise("pass"), ok, ok, F.lit(0))
    return _t(spark, d, "labels").select("doc_id", v.alias("verdict"))


@query("runbook_status", "with r as (select conv_id as run_id, turn as batch_index, case turn % 6 when 0 then 'planned' when 1 then 'pulled' when 2 then 'reviewed' when 3 then 'sent' when 4 then 'skipped' else 'blocked' end as status from conversations) select run_id, count(*) as total, count(*) filter (status in ('reviewed','sent','skipped')) as completed, count(*) filter (status = 'blocked') as blocked, floor(count(*) filter (status in ('reviewed','sent','skipped')) / count(*) * 100 + 0.5)::bigint as percent, min(batch_index) filter (status in ('planned','pulled')) as next_planned from r group by run_id")
def _(spark, d):
    names = F.array(*map(F.lit, ("planned", "pulled", "reviewed", "sent", "skipped", "blocked")))
    r = _t(spark, d, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("batch_index"), F.get(names, (F.col("turn") % 6).cast("int")).alias("status"))
    return chunks.runbook_status(r).select("run_id", "total", "completed", "blocked", "percent", "next_planned")


def _log(spark, d):
    return _t(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("kind"), F.col("ts").alias("created"), F.col("user_id").cast("string").alias("record_id"))


@query("evidence_rollup", "select event_type as kind, count(*) as n, min(ts) as first, max(ts) as last from events group by event_type")
def _(spark, d):
    return governance.rollup(_log(spark, d))


@query("timeline_by_record", "select event_id::varchar as id, event_type as kind, ts as created, user_id::varchar as record_id, row_number() over (partition by user_id order by ts, event_id::varchar) as place from events")
def _(spark, d):
    return governance.placed(_log(spark, d))


@query("job_status", "select user_id as job_id, arg_max(event_type, (ts, event_type)) as status, max(ts) as at from events group by user_id")
def _(spark, d):
    return governance.job_status(_t(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("ts").alias("at"), F.col("event_type").alias("status")))


@query("settings_redacted", """select event_id, case event_id % 4 when 0 then 'apiKey' when 1 then 'refresh_TOKEN' when 2 then 'name' else 'endpoint' end as key,
case event_id % 4 when 0 then case when user_id % 2 = 0 then '' else '[REDACTED_SECRET]' end when 1 then case when user_id % 2 = 0 then '' else '[REDACTED_SECRET]' end when 2 then case when user_id % 2 = 0 then '' else 'http://h/?x=1' end
else 'http://h/?token=[REDACTED_SECRET]&x=1&token=[REDACTED_SECRET]' end as value from events""")
def _(spark, d):
    e = _t(spark, d, "events")
    key = F.get(F.array(*map(F.lit, ("apiKey", "refresh_TOKEN", "name", "endpoint"))), (F.col("event_id") % 4).cast("int"))
    value = F.when(key == "endpoint", "http://h/?token=abc&x=1&token=d#e").when(F.col("user_id") % 2 == 0, "").otherwise("http://h/?x=1")
    r = e.select("event_id", F.explode(exchange.redacted(F.create_map(key, value))))
    return r.select("event_id", "key", "value")


@query("front_matter_field", "select doc_id, '\"' || lang || '\"' as lang from documents")
def _(spark, d):
    t = F.concat(F.lit('---\ntitle: "x"\nlang: "'), F.col("lang"), F.lit('"\n---\n'), F.col("text"))
    return _t(spark, d, "documents").select("doc_id", exchange.front_matter_field(t, "lang").alias("lang"))


@query("provider_text", """select conv_id, turn, case turn % 7 when 0 then text when 1 then text || chr(10) || role || chr(10) || 'v' when 2 then 'plain' when 3 then '' when 4 then 'a' || chr(10) || text when 5 then text || chr(10) || role else '' end as text from conversations""")
def _(spark, d):
    s = F.struct
    both = F.array(F.lit("x"))  # an answer may hold several layouts; the first that counts wins
    message = lambda c: F.to_json(s(F.array(s(s(c.alias("content")).alias("message"), F.lit("plain").alias("text"))).alias("choices"), F.lit("out").alias("output_text"), both.alias("output")))
    parts = F.concat(F.lit("["), F.to_json(s("text")), F.lit(',{"text":""},'), F.to_json(s(s(F.col("role").alias("value")).alias("text"))), F.lit(',"v",7]'))
    listed = F.concat(F.lit('{"choices":[{"message":{"content":'), parts, F.lit("}}]}"))
    output = F.concat(F.lit('{"output":[{"content":[{"text":"a"}]},{"content":['), F.to_json(s("text")), F.lit("]},{}]}"))
    told = F.concat(F.lit('{"output":[],"candidates":[{"content":{"parts":['), F.to_json(s("text")), F.lit(',{"n":1}]}},{"content":{"parts":['), F.to_json(s(F.col("role").alias("text"))), F.lit("]}}]}"))
    shapes = [message(F.col("text")), listed, message(F.lit("")), F.lit('{"choices":[{"text":""}],"output_text":"o"}'), output, told, F.lit("no json")]
    body = shapes[6]
    for i in range(6):
        body = F.when(F.col("turn") % 7 == i, shapes[i]).otherwise(body)
    return _t(spark, d, "conversations").select("conv_id", "turn", exchange.provider_text(body).alias("text"))


@query("sample_summary", "select lang, count(*) as n from documents group by lang")
def _(spark, d):
    return exchange.summary(_t(spark, d, "documents"), "lang")


@query("profile_upsert", "select c_custkey as id, case when c_custkey % 3 = 0 then 'new' else c_name end as name from customer")
def _(spark, d):
    t = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return exchange.upserted(t, t.filter("id % 3 = 0").withColumn("name", F.lit("new")))


@query("refresh_delta", r"""select doc_id, case when doc_id % 2 = 0 then 1 else 0 end::bigint as headings_delta, case when doc_id % 3 = 0 then 1 else 0 end::bigint as tables_delta,
(case when doc_id % 2 = 0 then 4 else 0 end + case when doc_id % 3 = 0 then 12 else 0 end)::bigint as chars_delta, doc_id % 2 = 0 or doc_id % 3 = 0 as changed from documents""")
def _(spark, d):
    def state(t):
        return t.select("doc_id", text.readable_stats("text")["headings"].alias("headings"), text.table_count("text").alias("tables"), F.length("text").cast("long").alias("chars"))

    a = _t(spark, d, "documents")
    more = F.concat(F.when(F.col("doc_id") % 2 == 0, "# H\n").otherwise(""), F.when(F.col("doc_id") % 3 == 0, "|a|\n|---|\n\nx").otherwise(""), "text")
    return exchange.refresh_delta(state(a), state(a.withColumn("text", more)))


from . import queries_review as _review  # noqa: E402, F401  registers more queries
