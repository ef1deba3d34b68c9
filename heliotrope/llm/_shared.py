"""Shared folders, written tables and size-checked joins for the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of rows that go to a Python worker at a time. A batch lies in the executor's JVM, in its worker and there once
#: more as Python strings, for each core; 64 MB, the default, is more than whole texts need.
BATCH_BYTES = 4 << 20


def narrow_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """From now on batches of the session have at most size bytes (one row may be longer); a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key).removesuffix("b"))
    if now <= 0 or now > size:
        spark.conf.set(key, f"{size}b")


@functools.cache
def _libc():
    """The C library if it has malloc_trim (glibc), with arrays from 8 MB on in pages of their own."""
    try:
        libc = ctypes.CDLL(None)
        libc.malloc_trim  # noqa: B018
        libc.mallopt(-3, 1 << 23)  # M_MMAP_THRESHOLD: fixed, else it grows with the arrays freed, whose memory then stays
        return libc
    except (AttributeError, OSError):
        return None


def lean(work):
    """A function over batches for Python workers that gives back to the machine what it frees: workers live on for the
    next tasks, two or more of them beside an executor's JVM."""

    @functools.wraps(work)
    def run(batches):
        import pyarrow as pa

        libc = _libc()
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if libc:
                libc.malloc_trim(0)

    return run


def freed(df: DataFrame, *results: str) -> DataFrame:
    """df with columns that have a result's name (whatever its case) renamed: underscores are added until it is free."""
    taken, names = {c.lower() for c in df.columns} | {r.lower() for r in results}, []
    for c in df.columns:
        if c.lower() in {r.lower() for r in results}:
            while c.lower() in taken:
                c += "_"
            taken.add(c.lower())
        names.append(c)
    return df.toDF(*names)


def work_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share.

    Where that is unset and all run in one process (local mode, tests) a temporary folder serves and is set; on a cluster
    it is an error, as executors would each write to disks of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="heliotrope-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


_scopes: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables of written() that are made inside go at its end; what was computed from them must have been written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: lineage ends here and survives a lost executor."""
    path = work_dir(df.sparkSession, tag)
    if _scopes:
        _scopes[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._heliotrope_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more."""
    delete(df.sparkSession, df._heliotrope_path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bounded(df: DataFrame, rows: int, size: int) -> bool:
    """Whether df has at most so many rows and bytes, found without reading far beyond them."""
    wide = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    if any(t.startswith(("array", "map", "struct")) for _, t in df.dtypes):
        raise ValueError("only flat columns are measured")
    each = sum(wide, F.lit(16 * len(df.columns))).cast("long")
    got = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(each), F.lit(0)).alias("b")).first()
    return got.n <= rows and got.b <= size


def join_checked(big: DataFrame, small: DataFrame, on, how: str, rows: int = 1_000_000, size: int = 64 << 20) -> DataFrame:
    """Joins with a broadcast of small if it is that small, else with a shuffle join that AQE may split."""
    return big.join(F.broadcast(small) if bounded(small, rows, size) else small, on, how)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
