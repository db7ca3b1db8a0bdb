"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters of the class ``[\x20\x09-\x0D]``.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: Texts are worked on in slices of about this many bytes, so that a batch of long texts stays small.
SLICE_BYTES = 16 << 20
#: Spark's setting for removing a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores more as keep it apart from ``columns`` (Spark's names ignore case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage; its shuffle files go, as nothing needs them any more.

    The folder is the cluster's ``spark.checkpoint.dir``. Only a session on one
    machine (``local[..]``), as in tests, may do without and gets a temporary folder.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="loom-checkpoint-"))
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        conf.set(CLEANUP, before)


def give_back() -> None:
    """Return freed memory to the system, as a worker that waits for its next task counts as long as it lives."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut further where the text in ``column`` is long; freed memory goes back to the system after the last."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        rows = max(1, int(n * size / max(batch.column(column).nbytes, 1)))
        for start in range(0, n, rows):
            yield batch.slice(start, rows)
    give_back()


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as bytes; null as an empty text."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def unsigned(column: Column) -> Column:
    """Sixteen lowercase hex digits of a 64-bit value."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
