"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding a few records, and ends in the
seek table of the seekable format: a skippable frame with the compressed and plain size of each
frame and a footer. The index maps a record's id to its frame and the offset inside that frame, so
one record is read by decompressing one frame.

Tasks write bundles into the shared folder, each under a name of its own, and return index rows;
a repeated task writes another bundle and only the one that the index names is ever read.

Defined cases: null html is an empty payload; a null URL becomes an empty target; a null page id is
no target of a revisit and never the largest; repeated rows with the largest id are all responses;
an empty table writes nothing and gives an empty result; extra columns, whatever their names, are
ignored; a payload longer than a frame has a frame of its own. Rows that share a page id share a
record id; the index holds an entry, and so an offset, for each.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table, written

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
LEAST = 1000
#: Groups of equal payloads up to this number are broadcast.
FEW = 500_000
DATE = "1970-01-01T00:00:00Z"
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1


def roles(pages: DataFrame, least: int = LEAST, few: int = FEW) -> DataFrame:
    """(page_id, url, payload, sha1, refers_to): refers_to is the response's id for revisits, else null.

    Only digests and ids are grouped. Up to ``few`` groups of equal payloads are broadcast, so no
    payload is shuffled; of more, the long payloads alone meet them by a shuffle.
    """
    spark = pages.sparkSession
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("sha1", F.sha1("payload"))
    is_long = F.octet_length("payload") >= least
    first = p.filter(is_long).groupBy(F.col("sha1").alias("same")).agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    first = written(spark, first.filter("n > 1 and top is not null").drop("n"), "responses")
    if first.count() <= few:
        d = p.join(F.broadcast(first), (F.col("sha1") == F.col("same")) & is_long, "left")
    else:
        d = p.filter(is_long).join(first, F.col("sha1") == F.col("same"), "left")
        d = d.unionByName(p.filter(~is_long).withColumns({"same": F.lit(None).cast("string"), "top": F.lit(None).cast("long")}))
    again = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return d.select("page_id", "url", "payload", "sha1", F.when(again, F.col("top")).alias("refers_to"))


def record(page_id: int | None, url: str, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no block but names its payload's digest and length."""
    kind = "response" if refers_to is None else "revisit"
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + "".join(c for c in url if c >= " "),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        payload = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "replace") + payload + b"\r\n\r\n"


def parse(raw: bytes, at: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of the record that starts at an offset of a plain frame."""
    end = raw.index(b"\r\n\r\n", at)
    head = raw[at:end].decode("utf-8").split("\r\n")
    if head[0] != "WARC/1.1":
        raise ValueError("no record starts here")
    fields = dict(line.split(": ", 1) for line in head[1:])
    n = int(fields["Content-Length"])
    if raw[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
        raise ValueError("a record does not end where it says")
    return fields, raw[end + 4 : end + 4 + n]


class Bundle:
    """Frames under construction, with their seek table."""

    def __init__(self, level: int = 3):
        import zstandard

        self.zip = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[tuple[int | None, int, int]] = []
        self.plain = bytearray()
        self.total = 0

    def add(self, page_id: int | None, raw: bytes) -> None:
        if self.plain and len(self.plain) + len(raw) > FRAME_BYTES:
            self.close_frame()
        self.index.append((page_id, len(self.sizes), len(self.plain)))
        self.plain += raw

    def close_frame(self) -> None:
        if self.plain:
            f = self.zip.compress(bytes(self.plain))
            self.frames.append(f)
            self.sizes.append((len(f), len(self.plain)))
            self.total += len(f)
            self.plain = bytearray()

    def finish(self) -> bytes:
        self.close_frame()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


def seek_table(tail: bytes, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed, plain) of each frame, from the last bytes of a file of ``size`` bytes."""
    n, flags, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE or flags & 0x80:
        raise ValueError("not a seekable bundle")
    need = 8 + 8 * n + 9
    if len(tail) < min(need, size):
        raise LookupError(need)
    entries = tail[-9 - 8 * n : -9]
    out, at = [], 0
    for i in range(n):
        c, p = struct.unpack_from("<II", entries, 8 * i)
        out.append((at, c, p))
        at += c
    if at + need != size:
        raise ValueError("the seek table does not fit the file")
    return out


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(spark: SparkSession, rows: DataFrame, folder: str | None = None, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Archives the rows of :func:`roles`; returns the index: bundle, page_ids, frames, offsets.

    The folder must be one that executors share; by default one in ``spark.checkpoint.dir``.
    """
    folder = folder or new_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _filesystem(folder)
        store.create_dir(top, recursive=True)

        def close(b: Bundle) -> pa.RecordBatch:
            raw, name = b.finish(), f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{top}/{name}", compression=None) as f:
                f.write(raw)
            ids, frames, offsets = zip(*b.index, strict=True)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{folder}/{name}"]),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([frames], pa.list_(pa.int32())),
                    pa.array([offsets], pa.list_(pa.int64())),
                ],
                ["bundle", "page_ids", "frames", "offsets"],
            )

        bundle = Bundle()
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for row in zip(*cols, strict=True):
                bundle.add(row[0], record(*row))
                if bundle.total >= bundle_bytes:
                    yield close(bundle)
                    bundle = Bundle()
        if bundle.index:
            yield close(bundle)

    index = rows.select("page_id", "url", "payload", "sha1", "refers_to").mapInArrow(
        run, "bundle string, page_ids array<long>, frames array<int>, offsets array<long>"
    )
    return written(spark, index, "warc-index")  # writing happens once, here


def read(index: DataFrame, payloads: bool = False) -> DataFrame:
    """Every indexed record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's length and digest are taken from its payload and must agree with its headers; a
    revisit's are those its headers hold. ``payloads`` adds the block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            for uri, ids, frames, offsets in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, path = _filesystem(uri)
                size = store.get_file_info(path).size
                with store.open_input_file(path) as f:
                    tail = f.read_at(min(size, 1 << 16), max(0, size - (1 << 16)))
                    try:
                        seeks = seek_table(tail, size)
                    except LookupError as e:
                        n = min(size, e.args[0])
                        seeks = seek_table(f.read_at(n, size - n), size)
                    plain, open_frame, rows = b"", -1, []
                    for page_id, frame, offset in zip(ids, frames, offsets, strict=True):
                        if frame != open_frame:
                            at, packed, n = seeks[frame]
                            plain = unzip.decompress(f.read_at(packed, at), max_output_size=n)
                            open_frame = frame
                        rows.append(_checked(page_id, *parse(plain, offset))[: 6 if payloads else 5])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return index.select("bundle", "page_ids", "frames", "offsets").mapInArrow(run, schema)


def _checked(page_id: int | None, head: dict[str, str], block: bytes) -> tuple:
    if head["WARC-Record-ID"] != f"<urn:page:{'' if page_id is None else page_id}>":
        raise ValueError("the index names another record")
    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    n, kind = int(head["WARC-Payload-Length"]), head["WARC-Type"]
    if kind == "response" and (len(block) != n or hashlib.sha1(block).hexdigest() != digest):
        raise ValueError("a payload differs from its record's headers")
    to = head.get("WARC-Refers-To")
    return page_id, n, digest, kind, int(to[10:-1]) if to else None, block


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(spark, roles(table(spark, sf_dir, "pages"))))


SQL = """
with p as (select page_id, coalesce(html, '') as h, strlen(coalesce(html, '')) as n from pages),
d as (select *, sha1(h) as s from p),
g as (select s, max(page_id) as top from d where n >= 1000 group by s)
select d.page_id, d.n as payload_bytes, d.s as payload_digest,
       case when d.n >= 1000 and d.page_id is distinct from g.top and g.top is not null then 'revisit' else 'response' end as record_type,
       case when d.n >= 1000 and d.page_id is distinct from g.top then g.top end as refers_to
from d left join g on d.s = g.s and d.n >= 1000
"""
