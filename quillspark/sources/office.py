"""Office containers (XLSX, DOCX, PPTX) and plain text from binary files, read inside the executors."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import docx_text

# Limits against archive bombs.
MAX_ENTRIES, MAX_ENTRY, MAX_TOTAL, MAX_RATIO = 10_000, 128 << 20, 512 << 20, 500


def open_archive(data: bytes) -> zipfile.ZipFile:
    """A ZIP whose entries stay within the limits; else ValueError."""
    z = zipfile.ZipFile(io.BytesIO(data))
    info = z.infolist()
    if len(info) > MAX_ENTRIES or sum(i.file_size for i in info) > MAX_TOTAL:
        raise ValueError("zip_limits_exceeded")
    for i in info:
        if i.file_size > MAX_ENTRY or i.file_size > MAX_RATIO * max(1, i.compress_size) and i.file_size > 1 << 20:
            raise ValueError("zip_limits_exceeded")
    return z


def _xml(z: zipfile.ZipFile, name: str):
    try:
        raw = z.read(name)
    except KeyError:
        return None
    if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
        raise ValueError("xml_doctype_refused")
    return ElementTree.fromstring(raw)


def xml_text(fragment: str) -> str:
    """The text of a fragment of XML, its entities decoded."""
    return "".join(ElementTree.fromstring(f"<t>{fragment}</t>").itertext())


def _local(e) -> str:
    return e.tag.rpartition("}")[2]


def _all(e, name: str) -> Iterator:
    return (x for x in e.iter() if _local(x) == name) if e is not None else iter(())


def _text(e, name: str = "t") -> str:
    return "".join(x.text or "" for x in _all(e, name))


def _attr(e, name: str) -> str:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), "")


def _number(value: str, code: str) -> str:
    """A numeric cell as its format shows it: General, fixed decimals, percent."""
    try:
        x = float(value)
    except ValueError:
        return value
    m = re.fullmatch(r"#?,?#*0(?:\.(0+))?(%)?", code)
    if m:
        x = x * 100 if m[2] else x
        return f"{x:{',' if ',' in code else ''}.{len(m[1] or '')}f}{m[2] or ''}"
    return str(int(x)) if x.is_integer() and abs(x) < 1e15 else f"{x:.11g}"


def sheets(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, grid of strings) of every sheet, in the workbook's order."""
    z = open_archive(data)
    book, rels = _xml(z, "xl/workbook.xml"), _xml(z, "xl/_rels/workbook.xml.rels")
    target = {_attr(r, "Id"): _attr(r, "Target") for r in _all(rels, "Relationship")}
    shared = [_text(s) for s in _all(_xml(z, "xl/sharedStrings.xml"), "si")]
    styles = _xml(z, "xl/styles.xml")
    codes = {_attr(f, "numFmtId"): _attr(f, "formatCode") for f in _all(styles, "numFmt")} | {"1": "0", "2": "0.00", "3": "#,##0", "4": "#,##0.00", "9": "0%", "10": "0.00%"}
    formats = [codes.get(_attr(x, "numFmtId"), "General") for g in _all(styles, "cellXfs") for x in g]
    out = []
    for s in _all(book, "sheet"):
        path = target.get(_attr(s, "id"), "").lstrip("/")
        root = _xml(z, path if path.startswith("xl/") else f"xl/{path}")
        grid: list[list[str]] = []
        for row in _all(root, "row"):
            at = int(_attr(row, "r") or len(grid) + 1)
            grid += [[] for _ in range(at - len(grid))]
            for c in _all(row, "c"):
                ref = re.match(r"[A-Z]+", _attr(c, "r"))
                col = 0
                for ch in ref[0] if ref else "":
                    col = col * 26 + ord(ch) - 64
                col = col - 1 if ref else len(grid[at - 1])
                kind, v = _attr(c, "t"), next(_all(c, "v"), None)
                raw = v.text or "" if v is not None else ""
                if kind == "s":
                    raw = shared[int(raw)] if raw.isdigit() and int(raw) < len(shared) else ""
                elif kind == "inlineStr":
                    raw = _text(c)
                elif kind == "b":
                    raw = "TRUE" if raw == "1" else "FALSE"
                elif kind in ("", "n") and raw:
                    style = _attr(c, "s")
                    raw = _number(raw, formats[int(style)] if style.isdigit() and int(style) < len(formats) else "General")
                line = grid[at - 1]
                line += [""] * (col + 1 - len(line))
                line[col] = raw
        out.append((_attr(s, "name"), grid))
    if not out:
        raise ValueError("xlsx_empty")
    return out


def docx_markdown(data: bytes) -> str:
    """A document's blocks in order, then the notes that it refers to."""
    z = open_archive(data)
    return docx_text.Document(lambda name: _xml(z, name)).markdown()


def pptx_markdown(data: bytes) -> str:
    """A section for each slide: its title, texts, tables and notes."""
    z = open_archive(data)
    names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    out = []
    for i, n in enumerate(names, 1):
        root = _xml(z, n)
        texts = [t for s in _all(root, "sp") if (t := "\n".join(filter(None, (_text(p).strip() for p in _all(s, "p")))))]
        title = texts[0].split("\n")[0] if texts else f"Slide {i}"
        rest = ["\n".join(texts[0].split("\n")[1:])] + texts[1:] if texts else []
        tables = [docx_text.table_markdown([[_text(c) for c in _all(r, "tc")] for r in _all(t, "tr")]) for t in _all(root, "tbl")]
        notes = _xml(z, f"ppt/notesSlides/notesSlide{re.search(r'[0-9]+', n)[0]}.xml")
        note = " ".join(filter(None, (_text(p).strip() for p in _all(notes, "p"))))
        out.append("\n\n".join([f"## {title}", *filter(None, rest), *tables, *([f"> Notes: {note}"] if note else [])]))
    return "\n\n".join(out) + "\n"


def decode_text(data: bytes) -> tuple[str, str, str]:
    """(text, encoding, confidence) of a text file: by its mark, else the best-scoring candidate."""
    for mark, enc in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(enc, "replace"), enc, "high"
    if data[:4096].count(0) > len(data[:4096]) * 0.3 and b"\0\0" in data[:4096]:
        raise ValueError("binary_text")
    try:
        return data.decode("utf-8"), "utf-8", "high"
    except UnicodeDecodeError:
        pass

    def score(t: str) -> float:
        n = len(t) or 1
        common = len(re.findall(r"""[A-Za-z0-9一-鿿　-〿＀-￯\s.,;:!?'"()\[\]{}\-_/\\]""", t))
        return (common - 5 * t.count("�") - 4 * len(re.findall(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", t))) / n

    best = max(((score(t), enc, t) for enc in ("gb18030", "utf-16-le", "utf-16-be", "utf-8") for t in [data.decode(enc, "replace")]), key=lambda x: x[0])
    return best[2], best[1], "medium" if best[0] > 0.6 else "low"


def to_markdown(name: str, data: bytes) -> tuple[str, str]:
    """(markdown, state) of a file; the state names what went wrong, else it is ok."""
    ext = name.rpartition(".")[2].lower()
    try:
        if ext in ("md", "markdown", "txt"):
            return decode_text(data)[0], "ok"
        if ext in ("docx", "pptx"):
            return (docx_markdown if ext == "docx" else pptx_markdown)(data), "ok"
        if ext == "pdf":
            from .pdf_text import pdf_markdown

            return pdf_markdown(data), "ok"
        if ext == "xlsx":
            return "\n\n".join(f"## {n}\n\n{docx_text.table_markdown(g)}" for n, g in sheets(data)) + "\n", "ok"
    except (ValueError, zipfile.BadZipFile, ElementTree.ParseError) as e:
        return "", str(e) or "unreadable"
    return "", "optional_adapter_required" if ext in ("doc", "ppt", "xls") else "unsupported"


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """path, hash, bytes, markdown and state of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [to_markdown(p, c) for p, c in zip(b["path"], b["content"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "hash": b["hash"], "bytes": b["bytes"], "markdown": [m for m, _ in done], "state": [s for _, s in done]})

    cols = files.select("path", F.sha2("content", 256).alias("hash"), F.col("length").alias("bytes"), "content")
    return cols.mapInPandas(run, "path string, hash string, bytes long, markdown string, state string")


def converted(records: DataFrame) -> DataFrame:
    """id, status, markdown and state of records (id, status, path, content): the imported ones are converted.

    One that cannot be converted stays imported, and its state says why; the others stay as they are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [to_markdown(p, c) if s == "imported" else (None, None) for s, p, c in zip(b["status"], b["path"], b["content"], strict=True)]
            status = ["converted" if x[1] == "ok" else s for s, x in zip(b["status"], done, strict=True)]
            yield pd.DataFrame({"id": b["id"], "status": status, "markdown": [m if x == "ok" else None for m, x in done], "state": [x for _, x in done]})

    kind = records.schema["id"].dataType.simpleString()
    return records.select("id", "status", "path", "content").mapInPandas(run, f"id {kind}, status string, markdown string, state string")


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row_no and cells (a map from column name) of every data row of every sheet."""
    from . import sheet_table

    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, c in zip(b["path"], b["content"], strict=True):
                for sheet, grid in sheets(c):
                    t = sheet_table.table(grid)
                    rows += [(p, sheet, no, dict(zip(t.names, cells, strict=True))) for no, cells in t.rows]
            yield pd.DataFrame(rows, columns=["path", "sheet", "row_no", "cells"])

    return files.mapInPandas(run, "path string, sheet string, row_no long, cells map<string, string>")
