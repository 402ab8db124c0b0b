"""Packing token ids into fixed windows by minimum bin slack.

A document's ids, and an end id, are cut into full windows and one remainder. Only the counts of
the remainders' lengths (at most ``capacity`` of them) reach the driver. There a bitset
subset-sum over that multiset, which always includes the longest length left, finds the fill
closest to the capacity; backtracking gives the count of each length; and the pattern repeats
while the counts last. Where no fill is exact, the slack is closed by cutting one more piece; the
last, partly filled window is cut into powers of two, which need no padding.

Rows find their places by their rank among pieces of their length, so nothing about single
documents is ever gathered.

Defined cases: a null text is empty and has the end id alone; null ids and repeated rows are packed
like any other; very long texts are encoded whole; pieces of one length are ranked by their number, so
ties have an order; an empty table gives no sequences; extra columns, whatever their names, are
ignored. An added token's string inside a text is that token, as in the definition's plain call.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import env_path, sliced, table, written

CAPACITY = 2048
END_ID = 1
#: Cut pieces up to this number are broadcast to find their documents; more are joined by a shuffle.
FEW = 10_000
#: Splits of each length's pieces for ranking, and rows of a split from which there are more of them.
SPLITS, RANKED = 64, 100_000


def byte_ranks(definition: str) -> dict[bytes, int] | None:
    """A tokenizer's vocabulary as ranks of byte strings, if its merges come in the order of their ids.

    Merging by the ids' order is then what the definition says, and the faster of two public
    libraries does it; None for any other definition.
    """
    d = json.loads(definition)
    m, pre = d["model"], d.get("pre_tokenizer") or {}
    plain = m.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if not plain or d.get("normalizer") or m.get("dropout") or m.get("ignore_merges"):
        return None
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    other = [x for x in range(256) if x not in kept]
    byte = {chr(x): x for x in kept} | {chr(256 + i): x for i, x in enumerate(other)}
    special = {t["content"] for t in d.get("added_tokens", [])}
    ids = {t: i for t, i in m["vocab"].items() if t not in special}
    pairs = [tuple(p) if isinstance(p, list) else tuple(p.split(" ")) for p in m["merges"]]
    merged = [ids.get("".join(p)) for p in pairs]
    if None in merged or merged != sorted(set(merged)) or len(ids) != 256 + len(merged):
        return None
    return {bytes(byte[c] for c in t): i for t, i in ids.items()}


def added_tokens(definition: str) -> list[str]:
    return [t["content"] for t in json.loads(definition).get("added_tokens", [])]


class Encoder:
    """Whole texts to little-endian 32-bit ids, as the definition's tokenizer gives them without special tokens.

    Texts that hold the string of an added token go to that tokenizer itself, which gives it its own id.
    """

    def __init__(self, definition: str, ranks: dict[bytes, int] | None, added: list[str] | None = None):
        self.definition, self.ranks = definition, None
        self.added = added_tokens(definition) if added is None else added
        if ranks:
            import public_tokenizers
            import tiktoken

            self.ranks = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.definition)

    def _defined(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.ranks:
            return self._defined(texts)
        return [self._defined([t])[0] if any(x in t for x in self.added) else np.array(self.ranks.encode_ordinary(t), "<u4").tobytes() for t in texts]


@lru_cache(maxsize=1)
def _read(path: str) -> tuple[str, dict[bytes, int] | None, list[str]]:
    with open(path, encoding="utf-8") as f:
        definition = f.read()
    return definition, byte_ranks(definition), added_tokens(definition)


def _vocabulary(spark: SparkSession, path: str | None):
    """The definition, its ranks and added tokens, sent to every executor: of a fixed size."""
    return spark.sparkContext.broadcast(_read(path or env_path("byte_bpe_50k.json", "QUILLSPARK_BPE_JSON")))


def _groups(b: pa.RecordBatch, column: int, limit: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """Rows of a batch in runs of about ``limit`` characters: the first row's place and the texts."""
    at, held, size = 0, [], 0
    for i, t in enumerate(b.column(column).to_pylist()):
        held.append(t)
        size += len(t)
        if size >= limit:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


def pieces(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """(uid, doc_id, th, start, length, crc, doc_tokens): full windows and the remainder of every row."""
    sent = _vocabulary(spark, path)
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, uid = Encoder(*sent.value), TaskContext.get().partitionId() << 40
        for b in sliced(batches):
            ids, hashes = b.column(0).to_pylist(), b.column(2).to_pylist()
            for at, texts in _groups(b, 1):
                rows = []
                for i, raw in enumerate(encoder(texts), at):
                    raw += tail
                    n = len(raw) // 4
                    for s in range(0, n, capacity):
                        k = min(capacity, n - s)
                        rows.append((uid, ids[i], hashes[i], s, k, zlib.crc32(raw[4 * s : 4 * (s + k)]), n))
                        uid += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    names = ["uid", "doc_id", "th", "start", "length", "crc", "doc_tokens"]
    return _source(docs).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _source(docs: DataFrame) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", t.alias("text"), F.xxhash64(t).alias("th"))


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Counts of lengths whose sum, with the longest length among them, is closest to ``capacity``."""
    longest = max(counts)
    room = capacity - longest
    mask, goal = (1 << (room + 1)) - 1, 1 << room
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == longest), room // length)
        m = 1
        while left > 0 and not reach & goal:
            m = min(m, left)
            steps.append((reach, length, m))
            reach |= reach << (length * m) & mask
            left -= m
            m *= 2
        if reach & goal:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = defaultdict(int)
    used[longest] = 1
    for before, length, m in reversed(steps):
        if not before >> total & 1:
            total -= length * m
            used[length] += m
    return dict(used)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, ...]]:
    """Places: (length, first rank, end rank, sub_start, sub_length, sequence of the first, offset).

    Pieces of ``length`` ranked from the first up to the end have the ids [sub_start, sub_start +
    sub_length) of theirs in consecutive sequences, at the offset. Every id has one place.
    """
    out: list[tuple[int, ...]] = []
    pool: dict[int, deque] = {}
    counts: dict[int, int] = {}
    seq = 0
    for length, n in histogram.items():
        if length == capacity:
            out.append((length, 0, n, 0, length, seq, 0))
            seq += n
        elif n:
            pool[length] = deque([(length, 0, n, 0)])
            counts[length] = n

    def take(length: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        counts[length] -= n
        while n:
            origin, a, b, sub = pool[length].popleft()
            k = min(n, b - a)
            if a + k < b:
                pool[length].appendleft((origin, a + k, b, sub))
            n -= k
            yield origin, a, a + k, sub
        if not counts[length]:
            del counts[length], pool[length]

    def put(length: int, part: tuple[int, int, int, int]) -> None:
        counts[length] = counts.get(length, 0) + part[2] - part[1]
        pool.setdefault(length, deque()).append(part)

    while counts:
        used = best_fill(counts, capacity)
        total = sum(k * n for k, n in used.items())
        need, cut = dict(used), 0
        if total < capacity:
            # whatever is left is longer than the slack, else it would have been taken
            cut = max((k for k in counts if counts[k] > need.get(k, 0)), default=0)
            if not cut:
                break
            need[cut] = need.get(cut, 0) + 1
        times = min(counts[k] // n for k, n in need.items())
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            for _ in range(n):
                at = seq
                for origin, a, b, sub in take(length, times):
                    out.append((origin, a, b, sub, length, at, offset))
                    at += b - a
                offset += length
        if cut:
            slack, at = capacity - offset, seq
            for origin, a, b, sub in list(take(cut, times)):
                out.append((origin, a, b, sub, slack, at, offset))
                at += b - a
                put(cut - slack, (origin, a, b, sub + slack))
        seq += times
    # what is left fills no window: powers of two, the largest first
    left = sum(k * n for k, n in counts.items())
    size = 1 << left.bit_length() >> 1
    offset = 0
    for length in sorted(counts, reverse=True):
        for origin, a, b, sub in list(pool[length]):
            for rank in range(a, b):
                at, n = sub, length
                while n:
                    k = min(n, size - offset)
                    out.append((origin, rank, rank + 1, at, k, seq, offset))
                    at, n, offset, left = at + k, n - k, offset + k, left - k
                    if offset == size:
                        seq, offset = seq + 1, 0
                        size = 1 << left.bit_length() >> 1
    return out


def ranked(p: DataFrame) -> DataFrame:
    """Adds ``rank``, from 0 among pieces of equal length, without gathering those."""
    total = p.count()
    p = p.withColumn("hb", F.pmod(F.xxhash64("uid"), F.lit(max(SPLITS, total // RANKED + 1))).cast("int"))
    each = p.groupBy("length", "hb").agg(F.count("*").alias("n"))
    # one row per length and split here
    base = each.selectExpr("length", "hb", "sum(n) over (partition by length order by hb) - n as base")
    local = p.selectExpr("*", "row_number() over (partition by length, hb order by uid) - 1 as local")
    return local.join(base, ["length", "hb"]).withColumn("rank", F.col("local") + F.col("base")).drop("hb", "local", "base")


def pack(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Every piece's place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset."""
    docs = docs.select("doc_id", "text")
    p = written(spark, pieces(spark, docs, capacity, end_id, path), "pieces")
    histogram = {r["length"]: r["count"] for r in p.groupBy("length").count().orderBy(F.desc("length")).collect()}
    rows = plan(histogram, capacity)  # bounded by the capacity, not by the data
    # by Arrow, as a list of rows would go through Python workers of another kind, which stay in the executors
    names = ["length", "r0", "r1", "sub", "n", "seq", "offset"]
    columns = zip(*(rows or [(0,) * 7]), strict=True)
    places = spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in columns], names))
    r = ranked(p)
    on = (r["length"] == places["length"]) & (r["rank"] >= places["r0"]) & (r["rank"] < places["r1"])
    placed = r.join(F.broadcast(places), on).select(
        "doc_id",
        "th",
        (F.col("start") + F.col("sub")).alias("start"),
        F.col("n").alias("length"),
        F.when(F.col("n") == r["length"], F.col("crc")).alias("ids_crc32"),
        "doc_tokens",
        (F.col("seq") + F.col("rank") - F.col("r0")).alias("sequence_id"),
        "offset",
    )
    placed = written(spark, placed, "places")
    whole = placed.filter("ids_crc32 is not null").drop("th")
    cut = placed.filter("ids_crc32 is null").drop("ids_crc32")
    sums = _checksums(spark, docs, cut, end_id, path).withColumnRenamed("doc_id", "id2")
    same = cut["doc_id"].eqNullSafe(sums["id2"]) & (cut["th"] == sums["th2"]) & (cut["start"] == sums["s2"]) & (cut["length"] == sums["n2"])
    return whole.unionByName(cut.join(sums, same).select(*whole.columns))


def _checksums(spark, docs, cut, end_id, path) -> DataFrame:
    """(doc_id, th2, s2, n2, ids_crc32) of cut pieces: their documents are encoded again."""
    want = cut.select("doc_id", "th", F.struct("start", "length").alias("s")).distinct()
    # bounded by the pieces of one document
    want = want.groupBy("doc_id", "th").agg(F.collect_list("s").alias("cuts")).toDF("wid", "wth", "cuts")
    if cut.count() <= FEW:
        want = F.broadcast(want)
    src = _source(docs)
    again = src.join(want, (src["th"] == want["wth"]) & src["doc_id"].eqNullSafe(want["wid"]))
    again = again.groupBy("doc_id", "th").agg(F.first("text").alias("text"), F.first("cuts").alias("cuts"))
    sent = _vocabulary(spark, path)
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*sent.value)
        for b in sliced(batches):
            ids, hashes, cuts = (b.column(i).to_pylist() for i in (0, 1, 3))
            for at, texts in _groups(b, 2):
                rows = []
                for i, raw in enumerate(encoder(texts), at):
                    raw += tail
                    for c in cuts[i]:
                        s, n = c["start"], c["length"]
                        rows.append((ids[i], hashes[i], s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    names = ["doc_id", "th2", "s2", "n2", "ids_crc32"]
    return again.select("doc_id", "th", "text", "cuts").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"))
