"""Shared plumbing of the training-data operators: tables, the shared folder, and small text helpers."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, tempfile.TemporaryDirectory] = {}
_MADE: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by its folder; the reader lists it, so any store that Spark knows works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    Only where the setting is absent (tests, a single machine) a temporary folder of this process
    stands in for it; on a cluster the setting must name a shared store.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.TemporaryDirectory(prefix="quillspark-")
    return "file://" + _OWN["dir"].name


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when this process ends."""
    path = f"{shared_dir(spark)}/quillspark/{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_clean)
    _MADE.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _MADE:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone by then; the folder is scratch space
            return


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch path once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back.

    A lost executor then costs a re-read, never a recomputation of what came before, and
    non-deterministic columns (row numbers) are fixed from here on.
    """
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def spent(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove tables of :func:`written` that nothing will read any more."""
    for t in tables:
        drop_path(spark, t.scratch)
        _MADE[:] = [m for m in _MADE if m[1] != t.scratch]


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores added until no column has it (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def identified(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with two more columns that together name a row for good, and their names.

    They are the file (its path's hash) and the row's place in it, which any later scan gives alike.
    Rows that do not come straight from files are written first.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = written(spark, docs, "rows")
    key = [fresh(docs.columns, "file_key"), fresh(docs.columns, "row_key")]
    meta = docs.metadataColumn("_metadata")
    return docs.select("*", F.xxhash64(meta["file_path"]).alias(key[0]), meta["row_index"].alias(key[1])), key


def without(spark: SparkSession, docs: DataFrame, dropped: DataFrame, key: list[str], few: int = 500_000) -> DataFrame:
    """Rows of :func:`identified` but those whose key is in ``dropped``, without the key.

    Up to ``few`` keys are broadcast, so that no text is shuffled; more are joined by a shuffle of
    ``docs``, with the same result.
    """
    dropped = written(spark, dropped.select(*key), "dropped")
    side = F.broadcast(dropped) if dropped.count() <= few else dropped
    return docs.join(side, key, "left_anti").drop(*key)


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text leaves remainder 2 by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """(doc_id, y) of usable labels outside the held-out part, one row an id (the largest label wins)."""
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col(column).cast("int").alias("y"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out())
    return rows.groupBy("doc_id").agg(F.max("y").alias("y"))


def training_sample(docs: DataFrame, labels: DataFrame, max_rows: int, max_chars: int) -> list[tuple[str, int]]:
    """(text, label) of at most ``max_rows`` labelled rows, and of at most ``max_chars`` characters in all.

    The bound keeps the driver's memory constant. Rows are taken by a hash of their id, so the
    choice does not depend on partitioning; texts over a hundredth of ``max_chars`` are left out of
    training (never out of scoring).
    """
    cut = max_chars // 100
    # the bound on ids makes their broadcast safe, so no other row's text is shuffled
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .filter(F.length("text") <= cut)
        .join(F.broadcast(chosen), "doc_id")
        .select(F.xxhash64("doc_id").alias("h"), "doc_id", "text", "y")
        .orderBy("h", "doc_id", "text")
        .limit(max_rows)
    )
    out, used = [], 0
    for r in rows.toLocalIterator():
        used += len(r["text"])
        if used > max_chars:
            break
        out.append((r["text"], r["y"]))
    return out


def release() -> None:
    """Hand memory that is no longer used back to the system.

    A Python worker serves task after task, and the allocators keep what a task has freed; an executor's
    workers then hold the most that any operator of the session took.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def sliced(batches, rows: int = 256):
    """Arrow batches in slices, so that a task holds few texts as Python objects at once."""
    release()  # what the worker's last task left
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
        del b  # before the next one is read
    release()


def env_path(default: str, name: str) -> str:
    """A tokenizer file: the environment's choice, else the installed public one."""
    import public_tokenizers

    return os.environ.get(name) or public_tokenizers.path(default)
