"""Byte-level BPE: a fold over the ranked merges of each distinct word, and its inverse.

1. Tasks cut blocks of documents into words (matches of the public pattern). Words that are whole
   pieces of the vocabulary have their rank at once; the block's other distinct words are sent, by
   their hash, to where the same words of other blocks go.
2. There they are made distinct, and Spark's higher-order functions fold the ranked merges over each
   one's bytes, looking ranks up in a literal map. Every word's pieces are checked to make up the word.
3. Each block gets its words' ids back; its documents, which travel as numbers of words, become ids.
   Decoding concatenates the binary pieces of the ids.

Words, their ids and numbers of words travel in compressed runs, one for each block and place; no
text does. A word costs one fold however many documents hold it. The fold of an n-byte word costs n
squared: words over FOLD_BYTES bytes take the same merges by a heap, n log n.

Defined cases: null counts as empty, which has no ids; null ids and repeated rows are kept; very long
texts are blocks of their own; extra columns, whatever their names, are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import env_path, table

#: Characters of text in a block; one longer document is a block of its own.
BLOCK_CHARS = 4_000_000
FOLD_BYTES = 8192
#: Buckets of the literal map, so that a lookup reads few entries.
BUCKETS = 1 << 13
#: Ranks are below NONE; in a pair's number the rank stands above SHIFT bits of its start.
NONE, SHIFT = 1 << 30, 20
MASK = (1 << SHIFT) - 1
#: Marks that, after letters, are a word of their own.
MARKS = [".", ",", ";", ":", "!", "?"]


def load_ranks(path: str | None = None) -> dict[bytes, int]:
    """The vocabulary file: a base64 piece and its rank on each line."""
    with open(path or env_path("byte_bpe_multi_50k.tiktoken", "QUILLSPARK_BPE_RANKS"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_literal(ranks: dict[bytes, int]):
    """The ranks as a literal: an array of small maps from hexadecimal piece to rank."""
    maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        h = piece.hex().upper()
        maps[zlib.crc32(h.encode()) % BUCKETS][h] = rank
    return F.from_json(F.lit(json.dumps(maps, separators=(",", ":"))), "array<map<string,int>>")


def _rank(p: str) -> str:
    return f"coalesce(try_element_at(get(rk, cast(crc32(cast({p} as binary)) % {BUCKETS} as int)), {p}), {NONE})"


def _piece(a: str, b: str) -> str:
    """Hexadecimal digits of the bytes from a up to b."""
    return f"substr(hx, cast(2 * ({a}) + 1 as int), cast(2 * (({b}) - ({a})) as int))"


def _pair(a: str, b: str) -> str:
    """The number of a pair of pieces that spans a up to b: its rank, then a."""
    return f"get(transform(array({_piece(a, b)}), x -> shiftleft(cast({_rank('x')} as bigint), {SHIFT}) | ({a})), 0)"


def fold_merges(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Adds ``ids`` (array<int>) to rows with a column ``word`` (bytes); null for a null, and for over FOLD_BYTES bytes.

    A column ``pairs`` may give the ranks of each byte and the next one (NONE if they make no piece,
    and at the end), as :func:`byte_pairs` finds them for many words at once.

    The state is one array: for each piece, the rank of merging it with the next one above the
    piece's start. Its smallest element is the merge to do, leftmost first among equals; a merge
    changes the element before it and its own, and drops the next.
    """
    start = lambda i: f"(get(e, {i}) & {MASK}L)"
    end = lambda i: f"coalesce(get(e, {i}) & {MASK}L, n)"
    none = f"{NONE << SHIFT}L"
    merged = f"""get(transform(array(cast(array_position(e, array_min(e)) as int)), p -> flatten(array(
        slice(e, 1, greatest(p - 2, 0)),
        if(p > 1, array({_pair(start('p - 2'), end('p + 1'))}), slice(e, 1, 0)),
        array(if(p + 1 < size(e), {_pair(start('p - 1'), end('p + 2'))}, {none} | {start('p - 1')})),
        slice(e, p + 2, size(e))))), 0)"""
    keep = [c for c in words.columns]
    size = F.octet_length("word").cast("bigint")
    d = words.withColumns({"rk": rank_literal(ranks), "hx": F.hex("word"), "n": F.when(size.between(1, FOLD_BYTES), size)})
    ahead = f"transform(sequence(0L, n - 1), i -> if(i = n - 1, {none} | i, {_pair('i', 'i + 2')}))"
    if "pairs" in keep:
        ahead = f"if(n is null, null, transform(pairs, (r, i) -> shiftleft(cast(r as bigint), {SHIFT}) | i))"
    d = d.selectExpr(*keep, "rk", "hx", "n", f"{ahead} as e0")
    d = d.selectExpr(*keep, "rk", "hx", "n", f"aggregate(sequence(1L, n), e0, (e, i) -> if(array_min(e) >= {none}, e, {merged})) as e")
    d = d.selectExpr(*keep, "rk", "hx", "n", f"transform(e, x -> x & {MASK}L) as st")
    ids = f"transform(st, (a, i) -> get(transform(array({_piece('a', 'coalesce(get(st, i + 1), n)')}), x -> {_rank('x')}), 0))"
    return d.selectExpr(*keep, f"{ids} as ids")


def byte_pairs(words: list[bytes], ranks: dict[bytes, int]) -> pa.Array:
    """For each word, the rank of every byte with the next one, NONE if there is none."""
    table = np.full(1 << 16, NONE, np.int32)
    for p, i in ranks.items():
        if len(p) == 2:
            table[p[0] << 8 | p[1]] = i
    raw, ends = np.frombuffer(b"".join(words), np.uint8).astype(np.int32), np.cumsum([0, *map(len, words)])
    out = table[raw << 8 | np.append(raw[1:], 0)]
    out[ends[1:][np.diff(ends) > 0] - 1] = NONE
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out))


def merge_by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges as the fold's, for a word of any length."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        j = end[i]  # a piece that was merged away ends nowhere
        if j < 0 or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, -1
        if stop < n:
            before[stop] = i
        for a, b in ((before[i], stop), (i, end[stop] if stop < n else -1)):
            if a >= 0 and b > 0 and (r := ranks.get(word[a:b])) is not None:
                heappush(heap, (r, a, b))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all elements of runs, one run after the other."""
    ends = np.cumsum(lengths)
    out = np.repeat(starts - ends + lengths, lengths)
    out += np.arange(len(out))
    return out


def _splitter():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN).findall


def block_words(texts: pa.Array, findall, numbers: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """A block's distinct words, the number in it of every word of all texts, and each text's count.

    Without ``numbers`` the last two are empty.

    A single space between characters that are not white space always starts a word, so texts are
    cut there first and each different part is matched once; parts of letters, and of letters and a
    mark, need no matching. Texts with other runs of white space are matched as a whole.
    """
    parts = pc.split_pattern(texts, " ")
    starts = parts.offsets.to_numpy()
    starts, count = starts[:-1] - starts[0], np.diff(starts)
    coded = parts.flatten().dictionary_encode()
    at, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    n, doc = len(names), np.repeat(np.arange(len(texts)), count)
    first = np.zeros(len(at), bool)
    first[starts] = True
    rest = np.zeros(n, bool)
    rest[at[~first]] = True

    letters = pc.utf8_is_alpha(names).to_numpy(zero_copy_only=False) & rest
    body = pc.utf8_slice_codeunits(names, 0, -1)
    marked = (pc.is_in(pc.utf8_slice_codeunits(names, -1), value_set=pa.array(MARKS, names.type)).to_numpy(zero_copy_only=False) & pc.utf8_is_alpha(body).to_numpy(zero_copy_only=False)) & rest
    spaced = lambda a: pc.binary_join_element_wise(pa.scalar("", names.type), a, pa.scalar(" ", names.type))
    known = [spaced(names.filter(pa.array(letters))), spaced(body.filter(pa.array(marked))), pc.utf8_slice_codeunits(names.filter(pa.array(marked)), -1)]

    # runs of words: of parts after a space (numbers 0 to n), of first parts, of whole texts
    length, begin = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    one, two = int(letters.sum()), int(marked.sum())
    length[:n][letters], length[:n][marked] = 1, 2
    other: list[str] = []
    size = one + 2 * two
    more_length: list[int] = []

    def run(words: list[str]) -> int:
        other.extend(words)
        more_length.append(len(words))
        return n + len(more_length)

    bad, run_of = np.zeros(n, bool), np.arange(n)
    left = np.flatnonzero(rest & ~letters & ~marked)
    for i, k in zip(left.tolist(), names.take(pa.array(left)).to_pylist(), strict=True):
        if not k or k[0].isspace() or k[-1].isspace():
            bad[i] = True
        else:
            run_of[i] = run(findall(" " + k))
    which = run_of[at]
    heads = np.flatnonzero(first)
    spoilt = np.zeros(len(texts), bool)
    if bad.any():
        spoilt[doc[bad[at] & ~first]] = True
    seen: dict[str, int] = {}
    for i, k in zip(heads.tolist(), names.take(pa.array(at[heads])).to_pylist(), strict=True):
        d = doc[i]
        if spoilt[d] or k and k[-1].isspace() and count[d] > 1:
            spoilt[d] = True
            which[i] = run(findall(texts[int(d)].as_py()))
        else:
            if k not in seen:
                seen[k] = run(findall(k))
            which[i] = seen[k]
    if spoilt.any():
        which[~first & spoilt[doc]] = n  # the empty run
    more = np.array(more_length, np.int64)
    length = np.concatenate([length, more])
    begin = np.concatenate([begin, size + np.cumsum(more) - more])
    begin[:n][letters] = np.arange(one)
    begin[:n][marked] = one + np.arange(two)

    words = pa.concat_arrays([*known, pa.array(other, names.type)]).dictionary_encode()
    if not numbers:
        return words.dictionary, np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = words.indices.to_numpy()
    # a letters-and-mark run has its mark at another place than after its body
    n_words = length[which]
    where = _ragged(begin[which], n_words)
    if two:
        is_marked = np.zeros(len(length), bool)
        is_marked[:n] = marked
        second = (np.cumsum(n_words) - 1)[is_marked[which]]
        where[second] += two - 1
    return words.dictionary, code[where], np.bincount(doc, n_words, len(texts)).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, pa.Array, pa.Array]]:
    """Number, ids and texts of blocks of about ``limit`` characters, by task and order.

    Two scans of one plan's input number alike, as a task's files are fixed when the plan is made;
    :func:`_assembled` checks each block's words all the same.
    """
    from pyspark import TaskContext

    number, held, size = TaskContext.get().partitionId() << 32, [], 0

    def block() -> tuple[int, pa.Array, pa.Array]:
        t = pa.Table.from_batches(held).combine_chunks()
        return number, *(pa.concat_arrays(c.chunks) for c in t.columns)

    for b in batches:
        b = b.set_column(1, "text", b.column(1).cast(pa.large_string()))
        at = 0
        for i, n in enumerate(pc.utf8_length(b.column(1)).to_pylist()):
            if size and size + n > limit:
                if i > at:
                    held.append(b.slice(at, i - at))
                yield block()
                held, size, at, number = [], 0, i, number + 1
            size += n
        if at < b.num_rows:
            held.append(b.slice(at))
    if held:
        yield block()


class _Known:
    """The vocabulary as an array to look words up in."""

    def __init__(self, ranks: dict[bytes, int]):
        self.pieces, self.ids = pa.array(list(ranks), pa.large_binary()), np.array([*ranks.values(), -1], np.int64)

    def __call__(self, words: pa.Array) -> np.ndarray:
        return self.ids[pc.fill_null(pc.index_in(words, value_set=self.pieces), -1).to_numpy(zero_copy_only=False)]


class _Block:
    """A block's words that are no pieces, by bucket and appearance; its texts as numbers of words."""

    def __init__(self, texts: pa.Array, known: _Known, base: int, buckets: int, findall, numbers: bool = True):
        words, which, self.counts = block_words(texts, findall, numbers)
        words = words.cast(pa.large_binary())
        ids = known(words)
        new = np.flatnonzero(ids < 0)
        raw = words.take(pa.array(new)).to_pylist()
        bucket = np.fromiter(map(zlib.crc32, raw), np.int64, len(raw)) % buckets
        order = np.argsort(bucket, kind="stable")
        self.words, self.bucket = [raw[i] for i in order.tolist()], bucket[order]
        ids[new[order]] = base + np.arange(len(new))
        self.numbers = ids[which]

    def check(self) -> int:
        return zlib.crc32(b"".join(self.words))


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    """Sizes, then the bytes of all arrays, compressed."""
    import zstandard

    raw = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(raw), *map(len, raw)], "<u8").tobytes() + b"".join(raw))


def _unpack(packed: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    sizes = np.frombuffer(raw, "<u8", n, 8).astype(np.int64)
    ends = 8 + 8 * n + np.cumsum(sizes)
    return [raw[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def encode(
    spark: SparkSession, docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text",
    digests: bool = False, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and decoded (binary) of every row.

    With ``digests``: doc_id, n_tokens and the SHA-256 of ids and of decoded bytes instead.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    sent = spark.sparkContext.broadcast(ranks)  # bounded by the vocabulary
    base = max(ranks.values(), default=-1) + 1
    # by number, as the packed words are small and their fold is not: no partitions are to be merged
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 2 * parts

    def list_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        findall, known = _splitter(), _Known(sent.value)
        for number, _, texts in _blocks(batches, block_chars):
            block = _Block(texts, known, base, buckets, findall, numbers=False)
            words, bucket = block.words, block.bucket
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(words)] if words else []
            rows = [(int(bucket[a]), _pack(np.array(list(map(len, words[a:b])), "<u4"), b"".join(words[a:b]))) for a, b in zip(cuts, cuts[1:])]  # noqa: B905
            del block, words
            pa.default_memory_pool().release_unused()
            if rows:
                which, packed = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array([number] * len(rows), pa.int64()), pa.array(packed, pa.binary())], ["bucket", "block", "packed"])

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {}
        lists = []
        for b in batches:
            for bucket, block, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                sizes, raw = _unpack(packed)
                ends = np.cumsum(np.frombuffer(sizes, "<u4")).tolist()
                own = [raw[a:e] for a, e in zip([0, *ends], ends)]  # noqa: B905
                lists.append((bucket, block, np.array([number.setdefault(w, len(number)) for w in own], "<u4").tobytes()))
        words, kinds = list(number), (pa.int32(), pa.int64(), pa.binary())
        for at in range(0, len(words), 10_000):
            part = words[at : at + 10_000]
            cols = [pa.array(part, pa.binary()), byte_pairs(part, sent.value), *(pa.nulls(len(part), t) for t in kinds)]
            yield pa.RecordBatch.from_arrays(cols, ["word", "pairs", "bucket", "block", "numbers"])
        for at in range(0, len(lists), 1000):
            part = lists[at : at + 1000]
            cols = [pa.nulls(len(part), pa.binary()), pa.nulls(len(part), pa.list_(pa.int32())), *(pa.array(c, t) for c, t in zip(zip(*part, strict=True), kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(cols, ["word", "pairs", "bucket", "block", "numbers"])

    def give_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task's words come first, in order, then the lists that number them
        names, found, every = _names(sent.value), [], None
        for b in batches:
            is_word = b.column("word").is_valid()
            if words := pc.sum(is_word).as_py():
                found.append(_checked(b.filter(is_word), names, sent.value))
            if words == b.num_rows:
                continue
            if found:
                ids, n = (np.concatenate(c) for c in zip(*found, strict=True))
                every = (ids, np.cumsum(n) - n, n)
                found = []
            rest, rows = b.filter(b.column("block").is_valid()), []
            for bucket, block, numbers in zip(*(rest.column(c).to_pylist() for c in ("bucket", "block", "numbers")), strict=True):
                which = np.frombuffer(numbers, "<u4").astype(np.int64)
                n = every[2][which]
                rows.append((block, bucket, _pack(n.astype("<u4"), _planes(every[0][_ragged(every[1][which], n)]))))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(cols, ["block", "bucket", "packed"])

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        findall, known = _splitter(), _Known(sent.value)
        for number, ids, texts in _blocks(batches, block_chars):
            b = _Block(texts, known, base, buckets, findall)
            body = _pack(np.array([b.check()], "<u4"), b.counts.astype("<u8"), _planes(b.numbers))
            del b
            pa.default_memory_pool().release_unused()
            cols = [pa.array([number], pa.int64()), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([body], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["block", "docs", "body"])

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        names = _names(sent.value)
        right = right.sort_by("bucket")
        given = [(np.frombuffer(n, "<u4").astype(np.int64), _from_planes(ids)) for n, ids in map(_unpack, right.column("packed").to_pylist())]
        n = np.concatenate([np.ones(base, np.int64), *(x for x, _ in given)])
        ids = np.concatenate([np.arange(base), *(x for _, x in given)])
        starts, out = np.cumsum(n) - n, []
        for doc, body in zip(left.column("docs").chunks[0] if left.num_rows else [], left.column("body").to_pylist(), strict=True):
            check, counts, numbers = _unpack(body)
            if zlib.crc32(b"".join(map(names.__getitem__, ids[base:].tolist()))) != np.frombuffer(check, "<u4")[0]:
                raise ValueError("a block's words and its texts differ: the input changed while it was read")
            which, counts = _from_planes(numbers), np.frombuffer(counts, "<u8").astype(np.int64)
            # documents by the million words, so that memory stays bounded
            groups = np.cumsum(counts) // 1_000_000
            edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(counts)]
            ends = np.concatenate([[0], np.cumsum(counts)])
            for a, b in zip(edges, edges[1:]):  # noqa: B905
                own = which[ends[a] : ends[b]]
                tokens = ids[_ragged(starts[own], n[own])]
                stops = np.concatenate([[0], np.cumsum(n[own])])[ends[a : b + 1] - ends[a]].tolist()
                raw, pieces = tokens.astype("<u4").tobytes(), list(map(names.__getitem__, tokens.tolist()))
                spans = list(zip(stops, stops[1:]))  # noqa: B905
                enc, dec = [raw[4 * x : 4 * y] for x, y in spans], [b"".join(pieces[x:y]) for x, y in spans]
                del pieces
                part = doc.values.slice(a, b - a)
                if digests:
                    sha = lambda x: pa.array([hashlib.sha256(v).hexdigest() for v in x], pa.string())
                    out.append(pa.table([part, pa.array([y - x for x, y in spans], pa.int64()), sha(enc), sha(dec)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]))
                else:
                    out.append(pa.table([part, pa.array(enc, pa.binary()), pa.array(dec, pa.binary())], ["doc_id", "ids", "decoded"]))
        return pa.concat_tables(out)

    listed = src.mapInArrow(list_words, "bucket int, block long, packed binary")
    words = listed.repartition(parts, "bucket").mapInArrow(distinct_words, "word binary, pairs array<int>, bucket int, block long, numbers binary")
    codes = fold_merges(words, ranks).mapInArrow(give_back, "block long, bucket int, packed binary")
    whole = src.mapInArrow(bodies, "block long, docs array<long>, body binary")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids binary, decoded binary"
    return whole.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(assemble, schema)


def _names(ranks: dict[bytes, int]) -> list[bytes]:
    names = [b""] * (max(ranks.values(), default=-1) + 1)
    for p, i in ranks.items():
        names[i] = p
    return names


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2^32 with their low and high halves apart, which compresses better."""
    return (x & 0xFFFF).astype("<u2").tobytes() + (x >> 16).astype("<u2").tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    half = np.frombuffer(raw, "<u2").astype(np.int64).reshape(2, -1)
    return half[0] | half[1] << 16


def _checked(b: pa.RecordBatch, names: list[bytes], ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a run of words and their counts; each word's pieces must make up the word."""
    raw, ids = b.column("word"), b.column("ids")
    if ids.null_count:
        lists = [merge_by_heap(w, ranks) if x is None else x for w, x in zip(raw.to_pylist(), ids.to_pylist(), strict=True)]
        ids = pa.array(lists, pa.list_(pa.int32()))
    values, n = ids.flatten().to_numpy().astype(np.int64), pc.list_value_length(ids).to_numpy().astype(np.int64)
    pieces = list(map(names.__getitem__, values.tolist()))
    size = np.cumsum([0, *map(len, pieces)])[np.cumsum(np.concatenate([[0], n]))]
    if b"".join(pieces) != b"".join(raw.to_pylist()) or (np.diff(size) != pc.binary_length(raw).to_numpy()).any():
        raise ValueError("a word's pieces do not make up the word")
    return values, n


def decode(ids: bytes, ranks: dict[bytes, int]) -> bytes:
    """The bytes of little-endian ids: their pieces, one after the other."""
    names = {i: p for p, i in ranks.items()}
    return b"".join(names[x] for x in np.frombuffer(ids, "<u4").tolist())


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark, table(spark, sf_dir, "documents"), load_ranks(), digests=True)
