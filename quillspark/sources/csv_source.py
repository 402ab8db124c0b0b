"""Delimited text as tables of strings, with inferred column types as metadata."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import js_num

_ISO = r"^\d{4}-\d{2}(?:-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?)?$|^\d{4}/\d{1,2}/\d{1,2}$|^\d{1,2}/\d{1,2}/\d{4}$"


def cells(line: str) -> list[str]:
    """One line's cells; quotes double inside quotes, and a line never continues on the next."""
    out, cell, quoted, i = [], [], False, 0
    while i < len(line):
        c = line[i]
        if c == '"':
            if quoted and line[i + 1 : i + 2] == '"':
                cell.append(c)
                i += 1
            else:
                quoted = not quoted
        elif c == "," and not quoted:
            out.append("".join(cell))
            cell = []
        else:
            cell.append(c)
        i += 1
    return [*out, "".join(cell)]


def column_names(header: list[str]) -> list[str]:
    """Blank names become column_<place>, repeated ones get a number from 2."""
    out: list[str] = []
    for i, h in enumerate(header, 1):
        base = h.strip() or f"column_{i}"
        name, n = base, 2
        while name in out:
            name, n = f"{base}_{n}", n + 1
        out.append(name)
    return out


def split_cells(line: Column) -> Column:
    """:func:`cells` as a Column: cells start at commas outside quotes, and quotes inside quotes are doubled."""
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',((?:[^",]++|"(?:[^"]|"")*+"?)*+)'), F.lit(1))
    # every quote that is left when sections lose their ends is one of a pair
    return F.transform(found, lambda c: F.replace(F.regexp_replace(c, r'"((?:[^"]|"")*+)"?', "$1"), F.lit('""'), F.lit('"')))


def read(spark: SparkSession, path: str) -> DataFrame:
    """A file (or folder of files with one header line each) as string columns; missing cells are empty.

    Lines are split first and parsed alone, so the source stays splittable; interior blank lines
    are rows of empty cells. A file's header is its first line with text; other lines like it are rows.
    """
    raw = spark.read.text(path)
    raw = raw.select(F.regexp_replace("value", "^\ufeff", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("no"))
    # one row a file; numbers follow a file's order, and two scans of one plan number alike
    heads = raw.filter(F.trim("value") != "").groupBy("file").agg(F.min("no").alias("no"), F.min_by("value", "no").alias("header"))
    first = heads.orderBy("file").first()
    if not first:
        raise ValueError("csv_empty")
    names = column_names(cells(first["header"]))
    body = raw.join(heads.select("no"), "no", "left_anti").select(split_cells(F.col("value")).alias("c"))
    return body.select(*(F.coalesce(F.get("c", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)))


def is_date(c: Column) -> Column:
    return c.rlike(_ISO) & F.coalesce(c.rlike(r"^\d{1,4}[-/](?:0?[1-9]|1[0-2]|\d{1,2}/)"), F.lit(False))


def infer_types(df: DataFrame) -> DataFrame:
    """(name, type, nullable) of every column, in one pass: the first kind that 90 % of the cells with text fit."""
    aggs = []
    for i, name in enumerate(df.columns):
        c = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
        some = c != ""
        n = js_num(c)
        number = some & n.isNotNull() & (F.abs(n) != float("inf"))
        boolean = some & F.lower(c).isin("true", "false", "yes", "no", "0", "1")
        for k, test in (("n", some), ("num", number), ("bool", boolean), ("date", some & is_date(c)), ("empty", ~some)):
            aggs.append(F.count(F.when(test, 1)).alias(f"{k}{i}"))
    one = df.agg(*aggs)
    rows = []
    for i, name in enumerate(df.columns):
        share = lambda k, i=i: F.col(f"{k}{i}") >= 0.9 * F.col(f"n{i}")
        kind = F.when(F.col(f"n{i}") == 0, "unknown").when(share("num"), "number").when(share("bool"), "boolean").when(share("date"), "date").otherwise("string")
        rows.append(F.struct(F.lit(name).alias("name"), kind.alias("type"), (F.col(f"empty{i}") > 0).alias("nullable")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def quote(value: Column) -> Column:
    """A cell as CSV text: quoted only where it must be."""
    c = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_lines(df: DataFrame) -> DataFrame:
    """Rows as CSV lines, without the header."""
    return df.select(F.concat_ws(",", *(quote(F.col(f"`{c}`")) for c in df.columns)).alias("line"))


def markdown_lines(df: DataFrame) -> DataFrame:
    """Rows as lines of a Markdown table, without the header."""

    def cell(name: str) -> Column:
        c = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
        return F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))

    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, df.columns)), F.lit(" |")).alias("line"))


def header_line(df: DataFrame) -> str:
    return ",".join(f'"{c.replace(chr(34), chr(34) * 2)}"' if re.search('[",\n\r]', c) else c for c in df.columns)
