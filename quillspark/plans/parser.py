"""The single-SELECT dialect: text to a frozen description of the query.

Tokens are read first, so keywords inside literals or names never confuse the clauses. Anything
outside the subset (AND/OR, subqueries, HAVING, DISTINCT, outer or further joins, table aliases,
``<>``, several sort keys) is refused with ``query_unsupported``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from .errors import QueryError

TOKEN = re.compile(
    r"""\s*(?:(?P<str>'(?:[^']|'')*'|"(?:[^"]|"")*")|(?P<num>\d+(?:\.\d+)?(?![\w.]))|(?P<name>[^\W\d][\w]*(?:\.[^\W][\w]*)*|\d\w*)"""
    r"""|(?P<op><=|>=|!=|<>|=|<|>|\*|,|\(|\)|;|-|\+|/|%))"""
)
AGGREGATES = ("count", "sum", "avg", "min", "max")
SCALARS = ("lower", "upper", "substr")
OPERATORS = ("=", "!=", ">", "<", ">=", "<=", "like")


@dataclass(frozen=True)
class Item:
    kind: str
    field: str
    name: str
    raw: str
    start: int = 1
    length: int | None = None


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    table: str
    join: tuple[str, str, str] | None = None
    where: tuple[str, str, str] | None = None
    group: tuple[str, ...] = ()
    order: tuple[str, bool] | None = None
    limit: int | None = None

    @property
    def wildcard(self) -> bool:
        return any(i.field == "*" and i.kind == "field" for i in self.items)

    @property
    def aggregated(self) -> bool:
        return any(i.kind in AGGREGATES for i in self.items)


def _bad(why: str) -> QueryError:
    return QueryError("query_unsupported", why)


class _Reader:
    def __init__(self, sql: str):
        self.sql, self.at, self.tokens = sql, 0, []
        pos, end = 0, len(sql.rstrip())
        while pos < end:
            m = TOKEN.match(sql, pos)
            if not m:
                raise _bad(f"cannot read {sql[pos : pos + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup), m.end(m.lastgroup)))
            pos = m.end()

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + k][:2] if self.at + k < len(self.tokens) else ("end", "")

    def word(self, k: int = 0) -> str:
        kind, v = self.peek(k)
        return v.lower() if kind == "name" else ""

    def next(self) -> tuple[str, str]:
        t = self.peek()
        self.at += 1
        return t

    def want(self, *words: str) -> None:
        for w in words:
            kind, v = self.next()
            if (v.lower() if kind in ("name", "op") else "") != w:
                raise _bad(f"expected {w.upper()}")

    def name(self) -> str:
        kind, v = self.next()
        if kind != "name":
            raise _bad(f"expected a name, found {v!r}")
        return v

    def raw(self, a: int, b: int) -> str:
        return self.sql[self.tokens[a][2] : self.tokens[b - 1][3]]


def _item(r: _Reader) -> Item:
    begin = r.at
    kind, v = r.next()
    made: dict = {}
    if (kind, v) == ("op", "*"):
        what, field = "field", "*"
    elif kind == "name" and r.peek() == ("op", "("):
        what = v.lower()
        if what not in AGGREGATES + SCALARS:
            raise _bad(f"function {v}")
        r.next()
        k, f = r.next()
        if not (k == "name" or (what == "count" and (f == "*" or (k, f) == ("num", "1")))):
            raise _bad(f"argument {f!r} of {v}")
        field = f
        if what == "substr":
            r.want(",")
            args = [r.next()]
            if r.peek() == ("op", ","):
                r.next()
                args.append(r.next())
            if any(k != "num" or not x.isdigit() for k, x in args):
                raise _bad("substr takes whole numbers")
            made = {"start": int(args[0][1]), "length": int(args[1][1]) if len(args) > 1 else None}
        r.want(")")
    elif kind == "name":
        if v.lower() == "distinct":
            raise _bad("DISTINCT")
        what, field = "field", v
    else:
        raise _bad(f"select item {v!r}")
    raw = r.raw(begin, r.at)
    name = raw
    if r.word() == "as":
        r.next()
        name = r.name()
    return Item(what, field, name, raw, **made)


def parse(sql: str) -> Select:
    r = _Reader(sql)
    if r.word() != "select":
        raise _bad("only SELECT is supported")
    r.next()
    if r.word() == "from":
        raise QueryError("query_no_columns", "no columns are selected")
    items = [_item(r)]
    while r.peek() == ("op", ","):
        r.next()
        items.append(_item(r))
    r.want("from")
    table, join, where, group, order, limit = r.name(), None, None, (), None, None
    if r.word() == "inner" or r.word() == "join":
        if r.word() == "inner":
            r.next()
        r.want("join")
        other = r.name()
        r.want("on")
        left = r.name()
        r.want("=")
        join = (other, left, r.name())
    if r.word() == "where":
        r.next()
        field = r.name()
        kind, op = r.next()
        op = op.lower()
        if op not in OPERATORS:
            raise _bad(f"comparison {op!r}")
        kind, v = r.next()
        if kind == "op" and v in "+-" and r.peek()[0] == "num":
            v = v + r.next()[1]
        elif kind == "str":
            v = v[1:-1].replace(v[0] * 2, v[0])
        elif kind not in ("num", "name") or v.lower() in ("select", "group", "order", "limit"):
            raise _bad(f"literal {v!r}")
        where = (field, op, v)
    if r.word() == "group":
        r.next()
        r.want("by")
        fields = [r.name()]
        while r.peek() == ("op", ","):
            r.next()
            fields.append(r.name())
        group = tuple(fields)
    if r.word() == "order":
        r.next()
        r.want("by")
        begin = r.at
        if r.word() in AGGREGATES + SCALARS and r.peek(1) == ("op", "("):
            while r.peek()[0] != "end" and r.next() != ("op", ")"):
                pass
        else:
            r.name()
        key = r.raw(begin, r.at)
        down = r.word() == "desc"
        if r.word() in ("asc", "desc"):
            r.next()
        if r.peek() == ("op", ","):
            raise _bad("more than one sort key")
        order = (key, down)
    if r.word() == "limit":
        r.next()
        kind, v = r.next()
        if kind != "num" or not v.isdigit():
            raise _bad("LIMIT takes a whole number")
        limit = int(v)
    if r.peek() == ("op", ";"):
        r.next()
    if r.peek()[0] != "end":
        raise _bad(f"clause at {r.peek()[1]!r}")
    return Select(tuple(items), table, join, where, group, order, limit)


def shape(sql: str) -> dict:
    """A description of a query that holds neither values nor column names."""
    try:
        s = parse(sql)
    except QueryError:
        s = None
    if s is None:
        has = lambda p: bool(re.search(p, sql, re.I))
        return {
            "table_count": 0, "primary_table": "", "joined_table": "", "has_join": has(r"\bjoin\b"), "has_where": has(r"\bwhere\b"),
            "has_group_by": has(r"\bgroup\s+by\b"), "has_order_by": has(r"\border\s+by\b"), "selected_columns": 0,
            "has_aggregates": has(r"\b(?:count|sum|avg|min|max)\s*\("), "limit": None,
        }
    return {
        "table_count": 2 if s.join else 1, "primary_table": s.table, "joined_table": s.join[0] if s.join else "",
        "has_join": bool(s.join), "has_where": bool(s.where), "has_group_by": bool(s.group), "has_order_by": bool(s.order),
        "selected_columns": len(s.items), "has_aggregates": any(i.kind != "field" for i in s.items), "limit": s.limit,
    }
