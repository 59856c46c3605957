"""Shared helpers of the training-data operators.

Operators read the columns they need by name, so extra columns never clash with working columns;
columns added to a pass-through frame get a name that the frame does not have (``free_name``).
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; where none is set a temporary one in local mode (tests), else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tapeworks-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_SCOPES: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession):
    """Tables saved inside are deleted at the end, for steps whose result is written by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def save(df: DataFrame, name: str, outlive: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends at a table that survives lost executors.

    It is deleted with the innermost scope, or with the one around that if it is to ``outlive`` it; else never.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    around = _SCOPES[: -1 if outlive else None]
    if around:
        around[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (never a local one)."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def free_name(df: DataFrame, base: str) -> str:
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def _is_scan(df: DataFrame) -> bool:
    """Only projections and filters over a table, which every run reads in the same partitions and order."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().head()
    return node.children().isEmpty()


def with_uid(df: DataFrame, name: str) -> DataFrame:
    """A row id that any re-run gives again, so repeated rows and null ids stay apart; what is no scan is written first."""
    return (df if _is_scan(df) else save(df, "rows")).withColumn(name, F.monotonically_increasing_id())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> list:
    """The UTF-8 bytes of each text, None for null."""
    return column.cast(pa.binary()).to_pylist()


def slices(texts: pa.Array, most_rows: int = 4096, most_bytes: int = 1 << 23):
    """(start, rows) of runs of texts that are handled together: so many rows and bytes at most, or one longer text."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(size.tolist()):
        if i > start and (held + n > most_bytes or i - start == most_rows):
            yield start, i - start
            start, held = i, 0
        held += n
    if len(size):
        yield start, len(size) - start


def parts(batches, text: int):
    """The batches in runs of bounded bytes of their column ``text``, so that its values can be held as Python objects."""
    for b in batches:
        for start, rows in slices(b.column(text)):
            yield b.slice(start, rows)


def crc_fold(doc_id):
    """crc32 of the id written as text, mod 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def tidy(run):
    """``run`` over Arrow batches; when a task ends, freed memory of its reused Python worker goes back to the system."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return whole
