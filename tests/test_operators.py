import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import chunks, gate, governance, lines, masking, readable
from quillspark.sources import csv_source, office


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_tokens_and_clip(spark):
    r = docs(spark, "", "abcde", None).select(text.token_estimate("text"), text.token_count("text")).collect()
    assert [tuple(x) for x in r] == [(0, 1), (2, 2), (0, 1)]
    c = docs(spark, "x" * 500).select(text.clip("text")).first()[0]
    assert c == "x" * 130 + "\n...[clipped]...\n" + "x" * 130


def test_readability(spark):
    got = [r[0] for r in docs(spark, "", "plain words here", "�" * 20 + "abc", "\\123\\045\\067\\012" * 3, "龘" * 12).select(text.low_readable("text")).collect()]
    assert got == [True, False, True, True, True]
    assert docs(spark, "(cid:12)" * 6).select(text.semantic_loss("text")["damaged"]).first()[0]


def test_chunks_and_bundle(spark):
    d = chunks.chunks(docs(spark, "a" * 12000, "b" * 12001, "", "# T\n" + "c" * 40000), bodies=True)
    n = {r["doc_id"]: r["n"] for r in d.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert n == {0: 1, 1: 2, 3: 4}
    b = {r["doc_id"]: r for r in chunks.bundle(d).collect()}
    assert (b[3]["last_chunk"], b[3]["tokens"], b[3]["next_chunk"], b[3]["truncated"]) == (3, 9000, 4, True)
    one = chunks.bundle(d, 2, 2).filter("doc_id = 3").first()
    assert (one["first_chunk"], one["last_chunk"], one["truncated"]) == (2, 2, False)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 6000), min_size=1, max_size=12))
def test_bundle_is_greedy(spark_list, tokens):
    total, taken = 0, 0
    for i, t in enumerate(tokens):
        if i and total + t > 9000:
            break
        total, taken = total + t, taken + 1
    d = spark_list.createDataFrame([(1, i + 1, t) for i, t in enumerate(tokens)], "doc_id long, idx long, tokens long")
    r = chunks.bundle(d).first()
    assert (r["last_chunk"], r["tokens"]) == (taken, total)


@pytest.fixture(scope="module")
def spark_list(spark):
    return spark


def test_runbook(spark):
    r = spark.createDataFrame([(1, 1, "sent"), (1, 2, "pulled"), (1, 3, "planned"), (1, 4, "blocked")], "run_id int, batch_index int, status string")
    s = chunks.runbook_status(r).first()
    assert (s["percent"], s["next_planned"], s["next_blocked"], s["remaining"]) == (25, 2, 4, 2)
    moved = chunks.transition(r, spark.createDataFrame([(1, 3, " Sent ")], "run_id int, batch_index int, status string"))
    assert {x["batch_index"]: x["status"] for x in moved.collect()}[3] == "sent"
    with pytest.raises(Exception, match="unsupported status"):
        chunks.transition(r, spark.createDataFrame([(1, 3, "lost")], "run_id int, batch_index int, status string")).collect()


def test_search_and_diff(spark):
    d = docs(spark, "One\r\n two ONE \nthree", "none", None)
    hits = [tuple(r) for r in lines.search(d, " one ").orderBy("doc_id", "line_no").collect()]
    assert hits == [(0, 2, 1, "One"), (0, 2, 2, "two ONE"), (1, 1, 1, "none")]
    assert lines.search(d, "  ").count() == 0
    a, b = docs(spark, "x\ny\nz"), docs(spark, "x\nY")
    got = sorted(r["entry"] for r in lines.diff_lines(lines.diff(a, b)).collect())
    assert got == ["+ L2: Y", "- L2: y", "- L3: z"]


def test_repeated_lines_native_equals_sequential(spark):
    t = "\n".join(["Annual report  Page 3 of 9", "body text number one", "- item", "Annual report  page 4 / 9"] * 5 + ["Unique line here"])
    native = [r["line"] for r in lines.without_repeated(docs(spark, t)).orderBy("line_no").collect()]
    assert native == readable.without_repeated(t.split("\n")) and "Unique line here" in native and not any("Annual" in x for x in native)


def test_readable():
    out = readable.readable("Title Line\n=====\nfirst part of a\nsentence goes on.\n\n\n12\n- item\n```\nraw  code\n```\n")
    assert out.startswith("# Title Line\n") and "first part of a sentence goes on." in out and "\n12\n" not in out and "raw  code" in out
    assert readable.readable("你好\n世界", name="n") == "# n\n\n你好世界\n"
    parts = readable.segments("\n".join("x" * 99 for _ in range(2500)))
    assert len(parts) == 3 and "".join(parts).count("x") == 2500 * 99


def test_gate(spark):
    d = docs(spark, "mail a@b.com", "password: hunter22", "plain", "<!-- local-only -->", "密钥sk-abc123xyz和", "| a |\n|---|", "Bearer abcdefghijklmnop", "id 123-45-6789")
    r = {x["doc_id"]: x for x in gate.judged(d).collect()}
    assert r[0]["signals"] == ["email"] and r[0]["decision"] == "review_recommended"
    assert r[1]["decision"] == "review_required" and r[2]["standard"] == "allow" and r[3]["standard"] == "block"
    assert "api_key_like" in r[4]["signals"] and r[5]["signals"] == ["table_included"]
    assert {"credential_like_text", "bearer_token_like"} <= set(r[6]["signals"]) and "id_number_like" in r[7]["signals"]


def test_masking(spark):
    t = "api_key = sk-abc123xyz789, mail x@y.org and x@y.org, ip 10.0.0.1. tel: 12345678 card 4111111111111111 [MASK_EMAIL_1] 密码：abcd1234"
    masked, mapping = masking.mask_text(t)
    for secret in ("sk-abc123xyz789", "x@y.org", "10.0.0.1", "12345678", "4111111111111111", "abcd1234"):
        assert secret not in masked
    assert "[MASK_EMAIL_2]" in masked and "[MASK_EMAIL_1]" not in mapping and masking.unmask_text(masked, mapping) == t
    assert masking.mask_text("1234567890123456 2024-01-02")[0] == "1234567890123456 2024-01-02"
    m = masking.masked(docs(spark, t, None, "")).orderBy("doc_id").collect()
    assert m[0]["masked"] == masked and m[1]["masked"] == "" and m[2]["mapping"] == {}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab@.:= 0123456789[]MASK_EIL\n-sk密钥", max_size=80))
def test_mask_round_trip(t):
    masked, mapping = masking.mask_text(t)
    assert masking.unmask_text(masked, mapping) == t


def test_governance(spark, tmp_path):
    log = spark.createDataFrame([("1", "query", "token: abcdef"), ("2", "query", "fine")], "id string, kind string, source_ref string")
    governance.append_evidence(log.withColumn("body", F.lit("never kept")), str(tmp_path / "log"))
    back = spark.read.schema(governance.EVIDENCE).json(str(tmp_path / "log"))
    assert back.count() == 2 and "body" not in spark.read.json(str(tmp_path / "log")).columns
    assert [r["id"] for r in governance.leaked(back).collect()] == ["1"]
    assert governance.visible(back, spark.createDataFrame([("1",)], "id string")).count() == 1
    files = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"y"))], "path string, content binary")
    import hashlib

    man = spark.createDataFrame([("a", "sha256:" + hashlib.sha256(b"x").hexdigest()), ("b", "0"), ("c", "1")], "path string, sha256 string")
    assert {r["path"]: r["state"] for r in governance.verified(files, man).collect()} == {"a": "ok", "b": "changed", "c": "missing"}


def test_csv(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('﻿name,value,value,\nalpha,"bravo,charlie","doubled ""quote"""\nb,2\n', encoding="utf-8")
    df = csv_source.read(spark, str(p))
    assert df.columns == ["name", "value", "value_2", "column_4"]
    assert [tuple(r) for r in df.collect()] == [("alpha", "bravo,charlie", 'doubled "quote"', ""), ("b", "2", "", "")]
    (tmp_path / "many").mkdir()
    (tmp_path / "many/a.csv").write_text("x,y\n1,2\nx,y\n\n")
    (tmp_path / "many/b.csv").write_text("\nx,y\n3,\"4\n")
    assert sorted(map(tuple, csv_source.read(spark, str(tmp_path / "many")).collect())) == [("", ""), ("", ""), ("1", "2"), ("3", "4"), ("x", "y")]
    odd = ['a,"b,c",d""e,"f""g"', '"open,x', ",,", "", '""', '"a"b"c,"', 'x"y,z"w']
    got = spark.createDataFrame([(x,) for x in odd], "l string").select("l", csv_source.split_cells(F.col("l")).alias("c")).collect()
    assert {r["l"]: r["c"] for r in got} == {x: csv_source.cells(x) for x in odd}
    d = spark.createDataFrame([("1", "yes", "2024-01-02", "", "x"), ("0x1", "no", "2024-02-03", "", "2")], "n string, b string, d string, e string, s string")
    assert [(r["name"], r["type"]) for r in csv_source.infer_types(d).collect()] == [("n", "number"), ("b", "boolean"), ("d", "date"), ("e", "unknown"), ("s", "string")]


def _zip(files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, t in files.items():
            z.writestr(n, t)
    return b.getvalue()


def test_office(spark, tmp_path):
    book = _zip({
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S1" r:id="a"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Target="worksheets/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>Name</t></si><si><r><t>al</t></r><r><t>pha</t></r></si></sst>",
        "xl/styles.xml": '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="2"/></cellXfs></styleSheet>',
        "xl/worksheets/s.xml": '<worksheet><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="inlineStr"><is><t>Value</t></is></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3" s="1"><v>33.333</v></c></row></sheetData></worksheet>',
    })
    (tmp_path / "b.xlsx").write_bytes(book)
    r = office.read_workbooks(spark, str(tmp_path / "b.xlsx")).collect()
    assert [(x["sheet"], x["cells"]) for x in r] == [("S1", {"Name": "alpha", "Value": "33.33"})]
    w = "http://w"
    doc = _zip({"word/document.xml": f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    (tmp_path / "d.docx").write_bytes(doc)
    (tmp_path / "t.txt").write_bytes("中文内容测试".encode("gb18030"))
    (tmp_path / "bad.docx").write_bytes(b"zip?")
    out = {x["path"].rpartition("/")[2]: x for x in office.read_documents(spark, str(tmp_path)).collect()}
    assert out["d.docx"]["markdown"] == "## Head\n\nBody\n\n| a\\|b |\n| --- |\n" and out["t.txt"]["markdown"] == "中文内容测试"
    assert out["bad.docx"]["state"] != "ok" and out["b.xlsx"]["state"] == "ok"


def test_exchange(spark):
    from quillspark.operators import exchange

    fields = {"title": "a: b", "tags": ["x", "é"], "n": 3}
    doc = exchange.exchange_markdown(fields, "Body", {"Query result": "| a |", "Audit": ""})
    back, rest = exchange.parse_front_matter(doc)
    assert back == fields and rest.strip() == "Body\n\n## Query result\n\n| a |"
    row = exchange.settings_row({"defaultQueryLimit": "20", "preferNewVersionOnRefresh": "true"})
    assert row["defaultQueryLimit"] == 20 and row["preferNewVersionOnRefresh"] is True and row["policyMode"] == "open-core" and len(row) == 8
    for bad, code in (({"x": 1}, "invalid_setting_key"), ({"policyMode": "none"}, "invalid_setting_value"), ({"defaultQueryLimit": "many"}, "invalid_setting_value"), ({"defaultExportFormats": 3}, "invalid_setting_value")):
        with pytest.raises(exchange.SettingError) as e:
            exchange.settings_row(bad)
        assert e.value.code == code
    p = spark.createDataFrame([("a/.env",), ("b/key.pem",), ("c/notes.md",)], "path string")
    assert [r[0] for r in p.select(exchange.sensitive_path(F.col("path"))).collect()] == [True, True, False]
    rows = spark.createDataFrame([(1, ["b", "zz", "a"]), (2, [])], "id long, codes array<string>")
    limits = spark.createDataFrame([("a", "do a"), ("b", "do b")], "code string, action string")
    assert {r["id"]: r["actions"] for r in exchange.with_limits(rows, limits).collect()} == {1: ["do b", "do a"], 2: []}
