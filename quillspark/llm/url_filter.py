"""URL filter: rules first, then the ratio of two character Markov models.

URLs that a rule allows or blocks train two variable-order models, of accepted and of rejected URLs.
Contexts of no to three characters and the characters after them are counted exactly, over all those
URLs; each order is interpolated with the one below by Witten-Bell smoothing (the weight of the lower
order is the number of different characters seen after the context). The score of a URL is the
difference of the two log-likelihoods, per character, and the cut-off is calibrated on a part of the
ruled URLs that trained neither model.

The table of counts grows with the input, and all of it counts. Up to MAX_GRAMS rows of it are sent to
every task. Where there are more, the same ratios come by joins: a character's ratio depends on it and the
three before it, so it is worked out once for each such gram that URLs have; of these the most frequent
are sent to every task (MAX_GRAMS at most), and the others are joined to the URLs that have them. Ratios are
added as whole numbers of 2**-32, so both ways give the same scores. (``fitted`` with a bound makes a smaller
model for other callers; the query does not use it.)

Defined cases: a null URL, or one without "://", has an empty host and path and fits no rule; a null
or empty URL scores 0; a score equal to the cut-off is allowed; without ruled URLs of both kinds all
scores are 0 and the cut-off is 0, so such URLs are allowed; null ids and repeated rows are kept; very
long URLs are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table, written

#: (host, path, verdict); a rule's name is host/path.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Contexts have no character, one, two and three.
ORDERS = 4
#: Codes of characters: 0 stands before a URL, the last for all beyond the basic plane.
CODES = 1 << 16
MAX_GRAMS = 2_000_000
#: Log ratios are counted in units of one over this.
UNIT = 1 << 32
#: Scores are counted in bins of this width for the calibration.
BIN = 0.01


def host_of(url: Column) -> Column:
    h = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(h, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, url, host, path, rule, ruling): the longest fitting rule of every URL."""
    d = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule = ruling = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        ruling = F.when(fits, v) if ruling is None else ruling.when(fits, v)
    empty = F.lit(None).cast("string")
    return d.select("*", (empty if rule is None else rule).alias("rule"), (empty if ruling is None else ruling).alias("ruling"))


def _grams(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For every order, each character with its context as one number (the character in the lowest 16 bits); its URL's row."""
    n = np.array([len(u) for u in urls], np.int64)
    points = np.frombuffer("".join(urls).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    code = np.minimum(points + np.uint64(1), np.uint64(CODES - 1))
    row = np.repeat(np.arange(len(urls)), n)
    place = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
    out = np.zeros((ORDERS, len(code)), np.uint64)
    out[0] = code
    for k in range(1, ORDERS):
        before = np.zeros(len(code), np.uint64)
        before[k:] = code[:-k] if len(code) > k else 0
        before[place < k] = 0
        out[k] = out[k - 1] | before << np.uint64(16 * k)
    return out, row


def counts(urls: DataFrame) -> DataFrame:
    """(k, g, accepted, rejected): how often each character follows each context, over all of (url, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, row = _grams(b.column(0).to_pylist())
            bad = b.column(1).to_numpy(zero_copy_only=False)[row] == 1 if len(row) else np.zeros(0, bool)
            for k in range(ORDERS):
                own, at, n = np.unique(g[k], return_inverse=True, return_counts=True)
                rejected = np.bincount(at[bad], minlength=len(own)).astype(np.int64)
                cols = [pa.array(np.full(len(own), k, np.int32)), pa.array(own.view(np.int64)), pa.array(n - rejected), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays(cols, ["k", "g", "accepted", "rejected"])

    each = urls.select("url", "y").mapInArrow(run, "k int, g long, accepted long, rejected long")
    return each.groupBy("k", "g").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))


class Model:
    """Counts of both kinds of URLs by order: of grams, and of contexts with their different successors."""

    def __init__(self, k: np.ndarray, g: np.ndarray, n: np.ndarray):
        """``n`` has a row for accepted and one for rejected URLs."""
        self.orders = []
        for order in range(ORDERS):
            own = k == order
            at = np.argsort(g[own])
            grams, count = g[own][at], n[:, own][:, at]
            contexts, start = np.unique(grams >> np.uint64(16), return_index=True)
            sums = [np.add.reduceat(x, start, axis=1) if len(start) else np.zeros((2, 0), np.int64) for x in (count, (count > 0).astype(np.int64))]
            self.orders.append((grams, count, contexts, *sums))

    @classmethod
    def of(cls, orders: list[tuple]) -> Model:
        """The model with these counts, as another one's ``orders`` has them."""
        model = cls.__new__(cls)
        model.orders = orders
        return model

    def has_both(self) -> bool:
        return bool(self.orders[0][3].sum(1).all())

    def probabilities(self, kind: int, g: np.ndarray) -> np.ndarray:
        """Of each character after its context."""
        p = np.full(g.shape[1], 1 / CODES)
        for k, (grams, count, contexts, total, different) in enumerate(self.orders):
            n, t = _at(contexts, total[kind], g[k] >> np.uint64(16)), _at(contexts, different[kind], g[k] >> np.uint64(16))
            p = _smoothed(p, _at(grams, count[kind], g[k]), n, t)
        return p


def _smoothed(p: np.ndarray, c: np.ndarray, n: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Witten-Bell: a gram seen ``c`` times, its context ``n`` times with ``t`` successors; ``p`` is the lower order's."""
    return np.where(n > 0, (c + t * p) / np.maximum(n + t, 1), p)


def _ratios(accepted: np.ndarray, rejected: np.ndarray) -> np.ndarray:
    """Log ratios of probabilities, in units."""
    return np.rint((np.log(accepted) - np.log(rejected)) * UNIT).astype(np.int64)


def _sums(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Exact sums of whole numbers by row; ``row`` ascends."""
    ends = np.concatenate([[0], np.cumsum(values)])
    at = np.searchsorted(row, np.arange(rows + 1))
    return ends[at[1:]] - ends[at[:-1]]


def _scores(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.round(total / UNIT / np.maximum(n, 1), 9)


def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of sorted keys; 0 for others."""
    if not len(keys):
        return np.zeros(len(wanted))
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[i] == wanted, values[i], 0).astype(np.float64)


def fitted(spark: SparkSession, urls: DataFrame, max_grams: int = MAX_GRAMS) -> Model:
    """The model of (url, y), with as many contexts as the bound allows."""
    table = written(spark, counts(urls), "grams")
    context = F.shiftrightunsigned("g", 16)
    by = table.groupBy("k", context.alias("c"))
    size = by.agg(F.sum(F.col("accepted") + F.col("rejected")).alias("n"), F.count("*").alias("m"))
    # a row for each power of two
    hist = size.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).agg(F.sum("m").alias("m")).collect()
    least, held = 0, 0
    for r in sorted(hist, key=lambda r: -r["b"]):
        held += r["m"]
        if held > max_grams and r["b"] < max(x["b"] for x in hist):
            least = r["b"] + 1
            break
    if least:
        kept = size.filter(F.col("n") >= 1 << least).select("k", "c")
        table = table.withColumn("c", context).join(kept, ["k", "c"], "left_semi").drop("c")
    return collected(table)  # max_grams rows at most


def collected(table: DataFrame) -> Model:
    """The model of a table of ``counts``, all of it."""
    t = table.select("k", "g", "accepted", "rejected").toArrow()
    col = lambda name: t.column(name).to_numpy()
    return Model(col("k"), col("g").view(np.uint64), np.array([col("accepted"), col("rejected")]).reshape(2, -1))


def log_likelihoods(urls: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods of whole URLs under both models, and their lengths in characters."""
    g, row = _grams(urls)
    out = np.array([np.bincount(row, np.log(model.probabilities(kind, g)), len(urls)) for kind in (0, 1)])
    return out, np.bincount(row, minlength=len(urls))


def scored(spark: SparkSession, pages: DataFrame, model: Model) -> DataFrame:
    """Adds ``score``: (log-likelihood accepted - rejected) / length."""
    # bounded by MAX_GRAMS; plain arrays, so that executors need not know this module
    sent = spark.sparkContext.broadcast(model.orders if model.has_both() else None)
    at, names = pages.columns.index("url"), [*pages.columns, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value and Model.of(sent.value)
        for b in batches:
            s = np.zeros(b.num_rows)
            if model:
                g, row = _grams([u or "" for u in b.column(at).to_pylist()])
                each = _ratios(model.probabilities(0, g), model.probabilities(1, g))
                s = _scores(_sums(each, row, b.num_rows), np.bincount(row, minlength=b.num_rows))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names)

    return pages.mapInArrow(run, pages.withColumn("score", F.lit(0.0)).schema)


def ratios(table: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (g, m: grams of the highest order) with each one's log ratio r in units, by a table of ``counts``."""
    low = lambda k: F.lit((1 << 16 * (k + 1)) - 1 if k < ORDERS - 1 else -1)
    found = asked
    for k in range(ORDERS):
        own = table.filter(F.col("k") == k)
        sums = [f(x).alias(f"{f_}{x[0]}{k}") for f_, f in (("n", F.sum), ("t", lambda x: F.sum((F.col(x) > 0).cast("long")))) for x in ("accepted", "rejected")]
        contexts = own.groupBy(F.shiftrightunsigned("g", 16).alias("c")).agg(*sums)
        grams = own.select(F.col("g").alias("w"), F.col("accepted").alias(f"ca{k}"), F.col("rejected").alias(f"cr{k}"))
        # of so few characters there are 65,536 at most, and one may end very many grams
        small = (F.broadcast if k == 0 else lambda d: d), (F.broadcast if k <= 1 else lambda d: d)
        found = found.withColumn("w", F.col("g").bitwiseAND(low(k))).join(small[0](grams), "w", "left")
        found = found.withColumn("c", F.shiftrightunsigned("w", 16)).drop("w").join(small[1](contexts), "c", "left").drop("c")
    names = [f"{x}{y}{k}" for k in range(ORDERS) for x in "cnt" for y in "ar"]
    found = found.select("g", "m", *(F.coalesce(x, F.lit(0)).cast("double").alias(x) for x in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = []
            for y in "ar":
                q = np.full(b.num_rows, 1 / CODES)
                for k in range(ORDERS):
                    q = _smoothed(q, *(b.column(f"{x}{y}{k}").to_numpy() for x in "cnt"))
                p.append(q)
            yield pa.RecordBatch.from_arrays([b.column("g"), b.column("m"), pa.array(_ratios(*p))], ["g", "m", "r"])

    return found.mapInArrow(run, "g long, m long, r long")


def scored_by_joins(spark: SparkSession, pages: DataFrame, table: DataFrame, max_grams: int = MAX_GRAMS) -> DataFrame:
    """As ``scored`` by the model of a table of ``counts``, of any size."""
    names = pages.columns
    at = names.index("url")
    row, total, length, rest = (fresh([*names, "score"], x) for x in ("row", "total", "length", "rest"))
    both = table.filter("k = 0").agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r")).first()
    if not (both["a"] and both["r"]):
        return pages.withColumn("score", F.lit(0.0))
    pages = written(spark, pages.withColumn(row, F.monotonically_increasing_id()), "pages")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, _ = _grams([u or "" for u in b.column(0).to_pylist()])
            own, n = np.unique(g[-1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n.astype(np.int64))], ["g", "m"])

    asked = pages.select("url").mapInArrow(own, "g long, m long").groupBy("g").agg(F.sum("m").alias("m"))
    every = written(spark, ratios(table, written(spark, asked, "asked")), "ratios")
    power = F.floor(F.log2("m")).cast("int")
    held, least = 0, 64
    for r in sorted(every.groupBy(power.alias("b")).count().collect(), key=lambda r: -r["b"]):  # a row for each power of two
        held += r["count"]
        if held > max_grams:
            break
        least = r["b"]
    t = every.filter(power >= least).select("g", "r").toArrow()  # max_grams rows at most
    keys = t.column("g").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    sent = spark.sparkContext.broadcast((keys[order], t.column("r").to_numpy()[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = sent.value
        for b in batches:
            g, of = _grams([u or "" for u in b.column(at).to_pylist()])
            g = g[-1]
            if len(keys):
                i = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
                known = keys[i] == g
                s = _sums(np.where(known, values[i], 0), of, b.num_rows)
            else:
                known, s = np.zeros(len(g), bool), np.zeros(b.num_rows, np.int64)
            ends = np.searchsorted(of[~known], np.arange(b.num_rows + 1))
            others = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(g[~known].view(np.int64)))
            n = np.bincount(of, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array(n.astype(np.int64)), others], [*names, row, total, length, rest])

    more = pages.withColumn(total, F.lit(0).cast("long")).withColumn(length, F.lit(0).cast("long")).withColumn(rest, F.array(F.lit(0).cast("long")))
    parts = written(spark, pages.mapInArrow(run, more.schema), "parts")
    left = parts.select(F.col(row).alias("i"), F.explode(rest).alias("g"))
    left = left.join(every.filter(power < least).select("g", "r"), "g").groupBy("i").agg(F.sum("r").alias("r"))
    done = parts.drop(rest).join(left, F.col(row) == F.col("i"), "left")
    done = done.withColumn(total, F.col(total) + F.coalesce(left["r"], F.lit(0))).select(*names, total, length)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _scores(b.column(len(names)).to_numpy(), b.column(len(names) + 1).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(s)], [*names, "score"])

    return written(spark, done.mapInArrow(last, pages.select(*names).withColumn("score", F.lit(0.0)).schema), "scored")


def least_error(bins: list[tuple[int, int, int]]) -> float:
    """Of (bin, y, count), the cut-off with the least mean error of both kinds; 0 if one is missing.

    Of several the middle one.
    """
    places = sorted({b for b, _, _ in bins})
    n = np.zeros((2, len(places)))
    for b, y, c in bins:
        n[y, np.searchsorted(places, b)] += c
    if not n.sum(1).all():
        return 0.0
    # below each place, and above the last: accepted URLs lost, rejected ones let in
    lost = np.concatenate([[0], np.cumsum(n[0])]) / n[0].sum()
    let_in = 1 - np.concatenate([[0], np.cumsum(n[1])]) / n[1].sum()
    cuts = [*places, places[-1] + 1]
    error = lost + let_in
    best = np.flatnonzero(error <= error.min() + 1e-12)
    b = best[len(best) // 2]
    low, high = cuts[b - 1] + 1 if b else cuts[0], cuts[b]
    return (low + high) // 2 * BIN


def calibrated(held: DataFrame) -> float:
    """The cut-off for (score, y)."""
    b = F.floor(F.col("score") / BIN).cast("int")
    rows = held.groupBy(b.alias("b"), "y").count().collect()  # two counts a bin
    return least_error([(r["b"], r["y"], r["count"]) for r in rows])


def judge(spark: SparkSession, pages: DataFrame, rules=RULES, max_grams: int = MAX_GRAMS) -> DataFrame:
    """page_id, host, path, rule, verdict, score and threshold of every row of (page_id, url).

    ``max_grams`` bounds what is sent to every task, and changes the plan but no result.
    """
    r = ruled(pages, rules)
    y, held = (F.col("ruling") == "block").cast("int").alias("y"), F.crc32("url") % 4 == 3
    known = r.filter("ruling is not null")
    table = written(spark, counts(known.filter(~held).select("url", y)), "grams")
    if table.count() <= max_grams:
        model = collected(table)
        each = scored(spark, r, model)
        cut = calibrated(scored(spark, known.filter(held).select("url", y), model))
    else:
        each = scored_by_joins(spark, r, table, max_grams)
        cut = calibrated(each.filter("ruling is not null").filter(held).select("score", y))
    method = F.when(F.col("score") >= cut, "allow").otherwise("block")
    return each.select("page_id", "host", "path", "rule", F.coalesce("ruling", method).alias("verdict"), "score", F.lit(cut).alias("threshold"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, table(spark, sf_dir, "pages").select("page_id", "url"))
