"""SimHash near-dedup with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The binary Golay code of length
23 is perfect: every word is within three bits of exactly one codeword. If two segments differ in
at most one bit, the codeword nearest to one of them lies within four bits of the other. So one
side of a join carries each segment's nearest codeword (one key), the other all codewords within
four bits (one key or six), and every such pair of segments meets.

Three differing bits over three segments leave, by the pigeonhole principle, either some segment
equal and another off by one at most (six kinds of key: an exact segment with another's codeword),
or one bit wrong in each (two kinds: two codewords, the three flipped parities, and one half of the
last segment, since its wrong bit lies in the other). Pairs that meet are verified on all 64 bits; components of the links follow.

Where a ``similarity`` is asked for (the pipeline's stage), texts whose sets of five-word shingles reach
that Jaccard similarity are linked too. Candidates share a key of BANDS bands of ROWS MinHash values
(a pair at 0.8 shares none with a chance of 3 in a million; more similar pairs, less), and every link
is checked on the whole sets. Each key's texts meet its most central one first, that whose keys hold most
texts, which joins the core of a group of near copies. Texts of one key that are still in different
components then meet by an exact prefix and positional filter (``apart``), which no pair of that
similarity fails, instead of each with each.

Defined cases: a null or empty text has fingerprint zero, linked like any other; equal fingerprints
are one class, whatever the number of rows; a null id is no component's smallest (a component of
null ids only has a null id); repeated rows are kept; very long texts are read whole; a bit set in
exactly half of the hashes is 0; other columns, whatever their names, are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, spent, table, written
from .components import connected

#: Generator polynomial of the binary Golay code of length 23.
GENERATOR = 0xAE3
SEGMENTS = ((0, 23), (23, 23), (46, 18))
DISTANCE = 3
#: MinHash keys of the similarity links.
BANDS, ROWS = 32, 5
#: Counts of shingles that order them, whatever the input.
ORDER_SLOTS = 1 << 20
#: Classes of set sizes for each power of e; any number gives the same pairs.
SIZE_CLASSES = 20
#: Slots of the bitmap of candidate texts, whatever the input.
SLOTS = 1 << 22


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a whole text, over shingles of lower-cased words, repeats included."""
    import xxhash

    w = (text or "").encode().lower().split()
    n = len(w)
    if not n:
        return 0
    if n < shingle:
        each, count = [b" ".join(w)], 1
    else:
        each, count = map(b" ".join, zip(*(w[i:] for i in range(shingle)))), n - shingle + 1  # noqa: B905
    h = np.fromiter(map(xxhash.xxh64_intdigest, each, repeat(seed)), dtype="<u8", count=count)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, 1 << 16):
        bits = np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple = ()) -> DataFrame:
    """(doc_id, th, fp) of every row; th hashes the text, fp holds the 64 bits as a signed long.

    The long columns in ``carry`` come along as carry0, carry1 and so on.
    """
    more = [f"carry{i}" for i in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype="<u8")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp.view("<i8")), *b.columns[3:]], ["doc_id", "th", "fp", *more])

    text = F.coalesce(text_col, F.lit("")).alias("text")
    src = docs.select(F.col(id_col).alias("doc_id"), text, F.xxhash64(text).alias("th"), *(F.col(f"`{c}`").alias(m) for c, m in zip(carry, more, strict=True)))
    return src.mapInArrow(run, "doc_id long, th long, fp long" + "".join(f", {m} long" for m in more))


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the 4096 message parts; error patterns of weight up to four by syndrome, and their number."""

    def remainder(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - 11)
        return x

    rem = np.array([remainder(m << 11) for m in range(4096)], np.int64)
    errors = np.zeros((2048, 6), np.int64)
    count = np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            s = remainder(e)
            errors[s, count[s]] = e  # the first is the coset's leader
            count[s] += 1
    return rem, errors, count


def codewords(words: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the codewords within four bits of each 23-bit word, nearest first, and their number."""
    rem, errors, count = tables
    s = rem[words >> 11] ^ (words & 2047)
    return (words[:, None] ^ errors[s]) >> 11, count[s]


def keys(fps: np.ndarray, tables, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs: nearest codewords only, or all within four bits if ``wide``."""
    u = fps.view(np.uint64)
    seg = [((u >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    near, count = zip(*(codewords(s, tables) for s in seg), strict=True)
    parity = [np.bitwise_count(s).astype(np.int64) & 1 for s in seg]
    if not wide:
        near, count = [x[:, :1] for x in near], [np.ones_like(c) for c in count]
    at, out = [], []
    kind = 0
    for i in range(3):
        for j in range(3):
            if i == j:
                continue
            for k in range(near[j].shape[1]):
                r = np.flatnonzero(count[j] > k)
                at.append(r)
                out.append(kind << 56 | seg[i][r] << 12 | near[j][r, k])
            kind += 1
    flags = sum((p ^ wide) << b for b, p in enumerate(parity))
    # of the last segment's halves one is equal, as one of its bits alone differs
    for half in range(2):
        own = seg[2] >> (9 * half) & 511
        for k in range(near[0].shape[1]):
            for m in range(near[1].shape[1]):
                r = np.flatnonzero((count[0] > k) & (count[1] > m))
                at.append(r)
                out.append((kind + half) << 56 | own[r] << 27 | flags[r] << 24 | near[0][r, k] << 12 | near[1][r, m])
    return np.concatenate(at), np.concatenate(out)


def keyed(fps: DataFrame, wide: bool) -> DataFrame:
    """(key, fp) rows of distinct fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = golay_tables()
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for k in range(0, len(fp), 4096):
                part = fp[k : k + 4096]
                at, key = keys(part, tables, wide)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[at])], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b), a < b: every two fingerprints of a distinct list at ``distance`` (3 at most) or fewer bits."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError("the keys find pairs of up to three differing bits")
    one = keyed(fps, False).toDF("key", "a")
    all_ = keyed(fps, True).toDF("key", "b")
    # sizes are estimated before a fingerprint becomes its many keys, so a broadcast must not be chosen by them
    met = one.hint("merge").join(all_, "key").filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
    return met.select("a", "b").distinct()


def shingles(text: str | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """The set of hashes of a text's shingles of lower-cased words, sorted; a shorter text is one shingle."""
    import xxhash

    w = (text or "").encode().lower().split()
    if len(w) < shingle:
        each, count = [b" ".join(w)], 1
    else:
        each, count = map(b" ".join, zip(*(w[i:] for i in range(shingle)))), len(w) - shingle + 1  # noqa: B905
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, each, repeat(seed)), dtype="<u8", count=count))


def band_keys(h: np.ndarray) -> list[int]:
    """A key (a signed long) of each band of the MinHash values of a set of hashes."""
    import xxhash

    rng = np.random.default_rng(5)
    flip, times = rng.integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 512):
        np.minimum(least, ((h[at : at + 512, None] ^ flip) * (times | np.uint64(1))).min(0), out=least)
    each = [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    return np.array(each, np.uint64).view(np.int64).tolist()


def _keyed_texts(docs: DataFrame, shingle: int) -> DataFrame:
    """(th, n, keys) of every row of (text, th): the size of its set and its bands' keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sets = [shingles(t, shingle) for t in b.column(0).to_pylist()]
            n, made = pa.array(map(len, sets), pa.int32()), pa.array([band_keys(h) for h in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(1), n, made], ["th", "n", "keys"])

    return docs.mapInArrow(run, "th long, n int, keys array<long>")


def _sets(docs: DataFrame, wanted: np.ndarray, shingle: int) -> DataFrame:
    """(th, s): the sets of the rows of (text, th) whose slot ``wanted`` (a packed bitmap) marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64) & (SLOTS - 1)
            b = b.filter(pa.array((wanted[slot >> 3] >> (slot & 7) & 1).astype(bool)))
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                sets = [shingles(t, shingle).view(np.int64) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(sets, pa.list_(pa.int64()))], ["th", "s"])

    return docs.mapInArrow(run, "th long, s array<long>")


def apart(spark: SparkSession, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: candidates among (th, root, s) for pairs of ``similarity`` or more with different roots; none is missed.

    In one order of all shingles, the first that two sets share lies at places p and q; before it they
    share none, so they share min(n - p, m - q) at most, and need similarity / (1 + similarity) * (n + m).
    The order puts rare shingles first. It counts them in ORDER_SLOTS slots: where several share one, the
    order is another, and as right.
    """
    sets = written(spark, sets.select("s", "th", "root"), "apart")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(ORDER_SLOTS, np.int64)
        for b in batches:
            n += np.bincount(b.column(0).flatten().to_numpy() & (ORDER_SLOTS - 1), minlength=ORDER_SLOTS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], ["slot", "n"])

    slots = sets.select("s").mapInArrow(seen, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # ORDER_SLOTS rows at most
    rarity = np.zeros(ORDER_SLOTS, np.uint8)  # 0: in one set only
    rarity[slots.column("slot").to_numpy()] = np.ceil(8 * np.log2(slots.column("n").to_numpy())).clip(0, 255)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows, n, g, p = [], [], [], []
            for i, s in enumerate(b.column(0)):
                s = s.values.to_numpy()
                r = rarity[s & (ORDER_SLOTS - 1)]
                # a partner has similarity * n shingles at least
                o = np.lexsort((s, r))[: int(len(s) * (1 - similarity) + 1e-6) + 1]
                at = np.flatnonzero(r[o])
                rows.append(np.full(len(at), i))
                n.append(np.full(len(at), len(s), np.int32))
                g.append(s[o[at]])
                p.append(at.astype(np.int32))
            if rows:
                rows, n, g, p = map(np.concatenate, (rows, n, g, p))
                yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(rows)), b.column(2).take(pa.array(rows)), *map(pa.array, (n, g, p))], ["th", "root", "n", "g", "p"])

    prefix = written(spark, sets.mapInArrow(first, "th long, root long, n int, g long, p int"), "prefixes")
    most = prefix.groupBy("g", "root").agg(F.count("*").alias("c")).groupBy("g")
    most = most.agg(F.max(F.struct("c", "root")).alias("m"), F.count("*").alias("k")).filter("k > 1").select("g", F.col("m.root").alias("major"))
    some = written(spark, prefix.join(most, "g").select("g", "th", "root", "n", "p", "major"), "shared")
    # the smaller set, m, shares its first at a place q that leaves a partner of its own size room; the larger, n,
    # at any place p, which bounds m: sizes meet by classes, so that deep places do not meet their like
    n, left, need = F.col("n"), F.col("n") - F.col("p"), similarity / (1 + similarity)
    size_class = lambda x: F.floor(F.log(x) * F.lit(SIZE_CLASSES)).cast("int")
    least = F.greatest(n * F.lit(similarity) - 1e-6, F.lit(1.0))
    classes = F.explode(F.sequence(size_class(least), size_class(F.greatest(least, F.least(n, left / F.lit(need) - n + 1e-6)))))
    names = lambda d, x: d.toDF("g", *(f"{c}{x}" for c in d.columns[1:-1]), "class")
    small = names(some.filter(left >= n * F.lit(2 * need) - 1e-6).withColumn("class", size_class(n)), "y")
    large = names(some.withColumn("class", classes), "x")
    fits = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) >= (F.col("nx") + F.col("ny")) * F.lit(need) - 1e-6
    fits = fits & (F.col("rootx") != F.col("rooty")) & (F.col("ny") <= F.col("nx"))
    # of a shingle's most frequent root no two sets need meet
    x_few, y_few = F.col("rootx") != F.col("majorx"), F.col("rooty") != F.col("majory")
    sides = (small.filter(y_few), large), (small.filter(~y_few), large.filter(x_few))
    met = [y.join(x, ["g", "class"]).filter(fits).select("thx", "thy") for y, x in sides]
    met = met[0].union(met[1])
    met = written(spark, met.select(F.least("thx", "thy").alias("a"), F.greatest("thx", "thy").alias("b")).distinct(), "met")
    spent(spark, sets, prefix, some)
    return met


def similar(spark: SparkSession, docs: DataFrame, rows: DataFrame, edges: DataFrame, similarity: float, shingle: int = 5) -> DataFrame:
    """(a, b), a < b: fingerprints with texts of ``similarity`` or more, as far as ``edges`` leave them apart.

    ``docs`` has text (not null) and th, ``rows`` th and fp. Links between fingerprints that are
    connected without them are left out.
    """
    texts = _keyed_texts(docs, shingle).groupBy("th").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    fps = rows.groupBy("th").agg(F.first("fp").alias("fp"))
    texts = written(spark, texts.join(fps, "th"), "texts")
    flat = texts.select(F.explode("keys").alias("key"), "th")
    sizes = flat.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    met = written(spark, flat.join(sizes, "key"), "buckets")

    slots = met.select(F.col("th").bitwiseAND(F.lit(SLOTS - 1)).cast("int").alias("slot")).distinct().toArrow()
    marks = np.zeros(SLOTS, bool)
    marks[slots.column("slot").to_numpy()] = True
    sets = _sets(docs, np.packbits(marks, bitorder="little"), shingle).groupBy("th").agg(F.first("s").alias("s"))
    sets = written(spark, sets, "sets")
    named = texts.select("th", "n", "fp")

    def linked(pairs: DataFrame) -> DataFrame:
        for x in "ab":
            pairs = pairs.join(named.toDF(x, f"n{x}", f"f{x}"), x)
        pairs = pairs.filter((F.col("fa") != F.col("fb")) & (F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(similarity) - 1e-9))
        pairs = listed = written(spark, pairs, "pairs")
        for x in "ab":
            pairs = pairs.join(sets.toDF(x, f"s{x}"), x)
        pairs = pairs.withColumn("c", F.size(F.array_intersect("sa", "sb")))
        found = pairs.filter(F.col("c") >= (F.col("na") + F.col("nb") - F.col("c")) * F.lit(similarity) - 1e-9)
        found = written(spark, found.select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b")).distinct(), "similar")
        spent(spark, listed)
        return found

    central = met.groupBy("th").agg(F.sum("c").alias("rank"))
    ranked = met.select("key", "th").join(central, "th")
    heads = ranked.groupBy("key").agg(F.max(F.struct("rank", "th")).alias("m")).select("key", F.col("m.th").alias("head"))
    stars = met.join(heads, "key").filter("th <> head").select(F.least("head", "th").alias("a"), F.greatest("head", "th").alias("b"))
    one = linked(stars.distinct())
    # texts of one key that are still in different components
    roots = connected(spark, edges.union(one)).toDF("fp", "root")
    member = met.select("key", "th").join(named.select("th", "fp"), "th").join(roots, "fp", "left")
    member = written(spark, member.select("key", "th", F.coalesce("root", "fp").alias("root")), "parted")
    mixed = member.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    rest = member.join(mixed, "key").select("th", "root").distinct()
    pairs = apart(spark, rest.join(sets, "th"), similarity)
    found = linked(pairs)
    both = written(spark, one.union(found).distinct(), "links")
    spent(spark, texts, met, sets, member, one, pairs, found)
    return both


def near_duplicates(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, carry: tuple = ()
) -> DataFrame:
    """doc_id, fingerprint, component_id, n_links, root, th and the long columns in ``carry`` of every row.

    With ``similarity``, components also follow the links of ``similar``; n_links counts those as well.

    n_links counts the other fingerprints linked to this one; root names the component even if its
    ids are null; th is the text's hash.
    """
    rows = written(spark, fingerprints(docs, id_col, text_col, carry), "fingerprints")
    fps = written(spark, rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    edges = written(spark, links(fps), "links")
    if similarity is not None:
        text = F.coalesce(text_col, F.lit("")).alias("text")
        more = similar(spark, docs.select(text, F.xxhash64(text).alias("th")), rows, edges, similarity)
        edges = written(spark, edges.union(more).distinct(), "links")
    roots = connected(spark, edges)
    degree = edges.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    named = roots.withColumnRenamed("node", "fp").join(fps, "fp")
    named = written(spark, named, "members")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "root").join(degree, "fp").select("fp", "component_id", "n_links", "root")
    classes = fps.join(named, "fp", "left").select(
        "fp",
        F.when(F.col("n_links").isNull(), F.col("rep")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("root", "fp").alias("root"),
    )
    # a table of its own, so that the rows of a frequent fingerprint can be split in the join
    classes = written(spark, classes, "classes")
    more = [F.col(f"carry{i}").alias(c) for i, c in enumerate(carry)]
    return rows.join(classes, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links", "root", "th", *more
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents")).drop("root", "th")
