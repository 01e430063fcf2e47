"""Shared folder, stored tables and Arrow helpers of the operators here."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where all is one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _OWN.setdefault(app, tempfile.mkdtemp(prefix="pageloom-"))
    return f"{base.rstrip('/')}/pageloom"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """What runs in here goes to Python in batches of so many rows, so that a batch of texts stays small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, was)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: what stands before it is not run twice, and no executor's loss undoes it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that stored() wrote and that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: 64-bit words of a bit filter, at most.
FILTER_WORDS = 1 << 20


def narrowed(rows: DataFrame, column: str, keys: DataFrame, n_keys: int) -> DataFrame:
    """rows without most of those whose column isn't in keys (one column, about n_keys rows): a bit filter joined by broadcast.

    The filter has 16 bits a key and FILTER_WORDS words at most. Some other rows may stay, and a full filter lets all
    through: the joins that follow are exact.
    """
    words = min(1 << max(8, (n_keys // 4).bit_length()), FILTER_WORDS)
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(words * 64))
    low = lambda c: f"cast(pmod(xxhash64(`{c}`), {words * 64}L) & 63 as int)"
    key = keys.columns[0]
    mask = keys.groupBy(F.shiftright(bit(key), 6).alias("_w")).agg(F.bit_or(F.expr(f"shiftleft(1L, {low(key)})")).alias("_bits"))
    hit = F.expr(f"(shiftrightunsigned(_bits, {low(column)}) & 1L) = 1L")
    return rows.join(F.broadcast(mask), F.shiftright(bit(column), 6) == F.col("_w")).filter(hit).select(*rows.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def tidy(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """fn for mapInArrow; when a task ends its worker, which lives on, gives the memory that it no longer uses back."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not glibc
                ctypes.CDLL(None).malloc_trim(0)

    return run


def to_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column of at most limit bytes each; a longer text stands alone."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, len(column)
    while at < n:
        before = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + limit, side="right")))
        yield at, to
        at = to
