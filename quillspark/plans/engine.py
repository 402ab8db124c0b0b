"""Tables, names and the planning of a parsed query into one lazy DataFrame.

Filters and projections are plain Columns, so Catalyst pushes them into the scan wherever a column
is numeric already. A row number is added only when a query's result depends on the source's order
(a column outside the grouping), because it would otherwise keep columns alive for nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import coerce
from .errors import QueryError
from .parser import AGGREGATES, Item, Select, parse

DEFAULT_LIMIT, MAX_LIMIT = 500, 1000
_ORD = "__ord"


@dataclass
class Table:
    name: str
    frame: DataFrame
    aliases: list[str] = field(default_factory=list)
    complete: bool = True


@dataclass
class Result:
    """A query's answer: rows up to the limit, and whether there were more."""

    columns: list[str]
    rows: list[dict]
    truncated: bool

    @property
    def row_count(self) -> int:
        return len(self.rows)


class Engine:
    """Registered tables and the queries over them."""

    def __init__(self, spark: SparkSession, default_limit: int = DEFAULT_LIMIT, max_limit: int = MAX_LIMIT):
        self.spark, self.default_limit, self.max_limit = spark, default_limit, max_limit
        self.tables: dict[str, Table] = {}
        self.by_name: dict[str, Table] = {}

    def register(self, name: str, frame: DataFrame, aliases: tuple[str, ...] = (), complete: bool = True) -> Table:
        """Adds a table under a safe name; the first table to claim an alias keeps it."""
        key = coerce.table_name(name)
        t = Table(key, frame, complete=complete)
        self.tables[key] = t
        self.by_name.setdefault(key, t)
        for a in aliases:
            a = coerce.table_name(a)
            if self.by_name.setdefault(a, t) is t and a != key:
                t.aliases.append(a)
        return t

    def list_tables(self) -> DataFrame:
        """name, aliases, columns (source and query name) and is_complete of every table."""
        rows = [
            (t.name, t.aliases, [(c, coerce.comparable(c)) for c in t.frame.columns], t.complete)
            for t in self.tables.values()
        ]
        schema = "name string, aliases array<string>, columns array<struct<source: string, sql: string>>, is_complete boolean"
        return self.spark.createDataFrame(rows, schema)

    def table(self, name: str) -> Table:
        if name not in self.by_name:
            raise QueryError("query_table_not_found", f"unknown table {name}", tables=sorted(self.by_name))
        return self.by_name[name]

    def plan(self, query: str | Select, limit: int | None = None, unbounded: bool = False) -> DataFrame:
        """The query as a DataFrame of at most its limit's rows.

        ``unbounded`` lifts the default and the greatest limit; one that the query or the caller gives stays.
        """
        q = parse(query) if isinstance(query, str) else query
        df, n = self._plan(q, limit)
        if not unbounded:
            return df.limit(n)
        given = q.limit if q.limit is not None else limit
        return df if given is None else df.limit(given)

    def run(self, query: str, limit: int | None = None) -> Result:
        """The answer on the driver: bounded by the limit, with one row more read to see if it was cut."""
        df, n = self._plan(parse(query), limit)
        rows = [r.asDict() for r in df.limit(n + 1).collect()]
        return Result(df.columns, rows[:n], len(rows) > n)

    def _plan(self, q: Select, limit: int | None) -> tuple[DataFrame, int]:
        names = _Names(self, q)
        src = names.frame
        if q.where:
            c, t = names.find(q.where[0])
            src = src.filter(coerce.compare(c, t, q.where[1], q.where[2]))
        if q.group or q.aggregated:
            out = self._grouped(q, names, src)
        elif q.wildcard:
            out = src.select(*(coerce.text(c).alias(n) if not coerce.is_numeric_type(t) else c.alias(n) for n, c, t in names.every()))
        else:
            out = src.select(*(_scalar(i, *names.find(i.field)).alias(i.name) for i in _last_of_each(q.items)))
        if q.order:
            out = self._ordered(q, out)
        wanted = q.limit if q.limit is not None else limit if limit is not None else self.default_limit
        return out, min(wanted, self.max_limit)

    def _grouped(self, q: Select, names: _Names, src: DataFrame) -> DataFrame:
        items = _last_of_each(q.items)
        if q.wildcard:
            items = [Item("field", n, n, n) for n, _, _ in names.every()]
        keys = [names.find(g) for g in q.group]
        found = {i.name: names.find(i.field) if i.field not in ("*", "1") or i.kind not in AGGREGATES else (F.lit(1), T.IntegerType()) for i in items}
        grouped = {str(k) for k, _ in keys}
        loose = [i for i in items if i.kind not in AGGREGATES and str(found[i.name][0]) not in grouped]
        cols = {f"k{n}": coerce.text(c) if not coerce.is_numeric_type(t) else c for n, (c, t) in enumerate(keys)}
        key_of = {str(c): f"k{n}" for n, (c, _) in enumerate(keys)}
        aggs = []
        if loose:
            src = src.withColumn(_ORD, F.monotonically_increasing_id())
        for n, i in enumerate(items):
            c, t = found[i.name]
            if i.kind in AGGREGATES:
                aggs.append(_aggregate(i, c, t).alias(f"a{n}"))
            elif i in loose:
                aggs.append(F.min_by(_scalar(i, c, t), _ORD).alias(f"a{n}"))
        # one constant key makes a global aggregate of no rows an empty result, not one row
        by = [c.alias(k) for k, c in cols.items()] or [F.lit("").alias("k")]
        g = src.groupBy(*by).agg(*aggs) if aggs else src.select(*by).distinct()
        out = []
        for n, i in enumerate(items):
            if i.kind in AGGREGATES or i in loose:
                out.append(F.col(f"a{n}").alias(i.name))
            else:
                c, t = found[i.name]
                out.append(_scalar(i, F.col(key_of[str(c)]), t).alias(i.name))
        return g.select(*out)

    def _ordered(self, q: Select, out: DataFrame) -> DataFrame:
        key, down = q.order
        squeeze = lambda s: "".join(s.split()).lower()
        hit = [c for c in out.columns if c == key] or [i.name for i in q.items if squeeze(i.raw) == squeeze(key) and i.name in out.columns]
        hit = hit or [c for c in out.columns if coerce.comparable(c) == coerce.comparable(key)]
        hit = hit or [i.name for i in q.items if i.kind == "field" and coerce.comparable(i.field) == coerce.comparable(key)]
        if not hit:
            raise QueryError("query_unsupported", f"ORDER BY {key} is not in the select list")
        c, t = F.col(f"`{hit[0]}`"), out.schema[hit[0]].dataType
        if coerce.is_numeric_type(t):
            return out.orderBy(c.desc_nulls_last() if down else c.asc_nulls_last())
        n = F.when(c != "", coerce.js_num(c))
        words = F.collate(c.cast("string"), "UNICODE")
        return out.orderBy(n.desc_nulls_last(), words.desc()) if down else out.orderBy(n.asc_nulls_last(), words.asc())


def _last_of_each(items: tuple[Item, ...]) -> list[Item]:
    """Of items with one output name the last counts, in the first one's place."""
    return list({i.name: i for i in items}.values())


def _scalar(i: Item, c: Column, t: T.DataType) -> Column:
    if i.kind == "lower":
        return F.lower(coerce.text(c))
    if i.kind == "upper":
        return F.upper(coerce.text(c))
    if i.kind == "substr":
        return coerce.substr(c, i.start, i.length)
    return c if coerce.is_numeric_type(t) else coerce.text(c)


def _aggregate(i: Item, c: Column, t: T.DataType) -> Column:
    if i.kind == "count":
        return F.count(F.lit(1)) if i.field in ("*", "1") else F.count(F.when(coerce.text(c) != "", 1))
    n = coerce.number(c, t) if not coerce.is_numeric_type(t) else F.coalesce(c.cast("double"), F.lit(0.0))
    if i.kind == "sum":
        return F.coalesce(F.sum(n), F.lit(0.0))
    if i.kind == "avg":
        return F.coalesce(F.avg(n), F.lit(0.0))
    best = F.min if i.kind == "min" else F.max
    if coerce.is_numeric_type(t):
        return best(n)
    shown = best(n).cast("string")
    whole = F.when((best(n) == F.floor(best(n))) & (F.abs(best(n)) < 1e15), best(n).cast("long").cast("string")).otherwise(shown)
    return F.when(F.count(n) > 0, whole).otherwise(F.coalesce(best(F.when(coerce.text(c) != "", coerce.text(c))), F.lit("")))


class _Names:
    """The columns that a query may name, over one table or two joined ones."""

    def __init__(self, engine: Engine, q: Select):
        left = engine.table(q.table)
        self.entries: list[tuple[str, str, Column, T.DataType]] = []  # (shown name, qualifier, column, type)
        if not q.join:
            self.frame = left.frame
            self._add(left, [q.table], left.frame, "")
        else:
            right = engine.table(q.join[0])
            lf, rf = (t.frame.select(*(F.col(f"`{c}`").alias(f"{p}.{c}") for c in t.frame.columns)) for t, p in ((left, "l"), (right, "r")))
            self._add(left, [q.table], lf, "l.")
            self._add(right, [q.join[0]], rf, "r.")
            sides = [self._find(n) for n in q.join[1:]]
            if any(s is None for s in sides):
                raise QueryError("query_column_not_found", f"unknown join column in {q.join[1]} = {q.join[2]}")
            (a, ta), (b, tb) = sides
            # whole numbers read alike as text if and only if they are equal, and null is the empty text on both sides
            whole = isinstance(ta, T.IntegralType) and isinstance(tb, T.IntegralType)
            self.frame = lf.join(rf, a.eqNullSafe(b) if whole else coerce.text(a) == coerce.text(b), "inner")
        self.joined = bool(q.join)
        self.left, self.right = left, engine.table(q.join[0]) if q.join else None
        for i in q.items:
            if not (i.field in ("*", "1") or self._find(i.field)):
                raise QueryError("query_column_not_found", f"unknown column {i.field}", columns=[e[0] for e in self.entries])

    def _add(self, t: Table, used: list[str], frame: DataFrame, prefix: str) -> None:
        for c in t.frame.columns:
            f = frame.schema[prefix + c]
            for qualifier in dict.fromkeys([t.name, *t.aliases, *used]):
                self.entries.append((c, qualifier, F.col(f"`{prefix + c}`"), f.dataType))

    def _find(self, name: str) -> tuple[Column, T.DataType] | None:
        exact = [e for e in self.entries if e[0] == name or f"{e[1]}.{e[0]}" == name]
        key = coerce.comparable(name)
        near = [e for e in self.entries if coerce.comparable(e[0]) == key or f"{e[1]}.{coerce.comparable(e[0])}" == key]
        hit = (exact or near or [None])[0]  # the left table wins an unqualified clash
        return hit and hit[2:]

    def find(self, name: str) -> tuple[Column, T.DataType]:
        found = self._find(name)
        if found is None:
            raise QueryError("query_column_not_found", f"unknown column {name}", columns=[e[0] for e in self.entries])
        return found

    def every(self) -> list[tuple[str, Column, T.DataType]]:
        """The columns of ``*``: those of a table, or qualified ones and then the names both sides share once."""
        if not self.joined:
            return list({e[0]: (e[0], *e[2:]) for e in self.entries}.values())
        out = {f"{e[1]}.{e[0]}": e[2:] for e in self.entries}
        for e in self.entries:
            out.setdefault(e[0], e[2:])
        return [(n, *v) for n, v in out.items()]
