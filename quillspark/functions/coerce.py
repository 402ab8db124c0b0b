"""Value coercions of the query dialect, as Column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the dialect's number and pattern rules.
WHITE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def is_numeric_type(t: T.DataType) -> bool:
    return isinstance(t, _NUMERIC)


def text(c: Column) -> Column:
    """The cell as text; null is the empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))


def js_num(c: Column) -> Column:
    """A text's number as a double, null where it is none; blank text is 0.

    Decimal notation with an exponent, Infinity, and hexadecimal, octal and binary integers count.
    """
    t = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), f"^{WHITE}+|{WHITE}+$", "")
    radix = lambda prefix, digits, base: F.when(
        t.rlike(f"^0[{prefix}][{digits}]+$"), F.conv(F.substring(t, 3, 1 << 20), base, 10).cast("double")
    )
    return F.coalesce(
        F.when(t == "", F.lit(0.0)),
        F.when(t.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), t.try_cast("double")),
        F.when(t.rlike(r"^\+?Infinity$"), F.lit(float("inf"))),
        F.when(t == "-Infinity", F.lit(float("-inf"))),
        radix("xX", "0-9a-fA-F", 16),
        radix("oO", "0-7", 8),
        radix("bB", "01", 2),
    )


def number(c: Column, t: T.DataType) -> Column:
    """The typed fast path: numeric columns need no parsing."""
    return c.cast("double") if is_numeric_type(t) else js_num(c)


def literal_number(value: str) -> float | None:
    """A literal's number by the same rules."""
    t = value.strip(" \t\n\r\x0b\f\u00a0\ufeff\u3000\u2028\u2029")
    if t == "":
        return 0.0
    if re.fullmatch(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", t, re.A):
        return float(t)
    if t in ("Infinity", "+Infinity", "-Infinity"):
        return float(t.replace("Infinity", "inf"))
    for prefix, base in (("0x", 16), ("0o", 8), ("0b", 2)):
        if t[:2].lower() == prefix:
            try:
                return float(int(t[2:], base)) if "_" not in t else None
            except ValueError:
                return None
    return None


def like_regex(pattern: str) -> str:
    """A LIKE pattern as an anchored regular expression for lower-cased text; it never crosses a line end."""
    out = []
    for ch in pattern.lower():
        out.append("[^\\n\\r\\u2028\\u2029]*" if ch == "%" else "[^\\n\\r\\u2028\\u2029]" if ch == "_" else re.escape(ch) if ord(ch) < 128 else ch)
    return r"\A" + "".join(out) + r"\z"


def compare(c: Column, t: T.DataType, op: str, value: str) -> Column:
    """One comparison: numeric if both sides are numbers and neither is empty, else on lower-cased text."""
    ops = {
        "=": lambda a, b: a == b,
        "!=": lambda a, b: a != b,
        ">": lambda a, b: a > b,
        "<": lambda a, b: a < b,
        ">=": lambda a, b: a >= b,
        "<=": lambda a, b: a <= b,
    }
    if op == "like":
        return F.lower(text(c)).rlike(like_regex(value))
    n = literal_number(value) if value != "" else None
    if is_numeric_type(t) and n is not None:
        plain = F.lit(int(n)) if float(n).is_integer() and abs(n) < 2**53 else F.lit(n)
        # a null is the empty text, which is less than any other; both forms reach the scan
        return ops[op](c, plain) | c.isNull() if op in ("<", "<=", "!=") else ops[op](c, plain)
    as_text = ops[op](F.lower(text(c)), F.lit(value.lower()))
    if n is None:
        return as_text
    number_ = js_num(c)
    return F.when((text(c) != "") & number_.isNotNull(), ops[op](number_, F.lit(n))).otherwise(as_text)


def substr(c: Column, start: int, length: int | None) -> Column:
    """Characters from a 1-based place; place 0 means the last character, as slicing from -1 does."""
    t = text(c)
    if start >= 1:
        return F.substring(t, start, 1 << 30 if length is None else length) if length != 0 else F.lit("")
    if length is None:
        return F.right(t, F.lit(1))
    # from the last character up to (not including) place length - 1
    end = length - 1
    if end <= 0:
        return F.lit("")
    return F.when(F.length(t) <= end, F.right(t, F.lit(1))).otherwise(F.lit(""))


def comparable(name: str) -> str:
    """A column's name as queries may write it."""
    parts = str(name).split(".")
    base = unicodedata.normalize("NFKC", parts[-1]).strip()
    base = re.sub(r"[^\w]+", "_", base).strip("_")
    if base[:1].isdigit():
        base = f"column_{base}"
    return ".".join([*(p.strip().lower() for p in parts[:-1]), base.lower()])


def table_name(name: str) -> str:
    """A safe table name: ASCII letters, digits and underscores in lower case."""
    out = re.sub(r"[^A-Za-z0-9_]+", "_", str(name)).strip("_").lower()
    if out[:1].isdigit():
        out = f"table_{out}"
    return out or "table"
