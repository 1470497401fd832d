"""What the operators share: the cluster's scratch folder, written tables, and row helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import math
import mmap
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parquet written between steps; zstd keeps binary blobs that are already dense as they are.
_CODEC = "zstd"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or that of the context.

    Where both are unset a local master gets a temporary folder (tests); a cluster has no such folder, so this raises."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="pitchgrid-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return root.rstrip("/")


class Scratch:
    """Written tables of one operator call, in a folder of their own.

    A table written here cuts the lineage: an executor lost later costs a reread, not a recomputation. ``release``
    removes one table once what was made from it is written; what is left goes when the driver's process ends, as the
    result that an operator returns still reads it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/pitchgrid-{uuid.uuid4().hex}"
        self._n = 0
        self._tables: list[str] = []
        small_batches(spark)
        atexit.register(self._at_exit)

    def write(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.path}/{self._n}"
        df.write.option("compression", _CODEC).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def write_bucketed(self, df: DataFrame, buckets: int, key: str) -> DataFrame:
        """As ``write``, bucketed by ``key``: joins on it with as many partitions don't shuffle the table again."""
        self._n += 1
        name = f"t_{uuid.uuid4().hex}"
        (
            df.write.option("compression", _CODEC)
            .option("path", f"{self.path}/{self._n}")
            .bucketBy(buckets, key)
            .saveAsTable(name)
        )
        self._tables.append(name)
        return self.spark.table(name)

    def _delete(self, path: str) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)

    def release(self, *tables: DataFrame) -> None:
        """Removes tables that ``write`` returned; nothing may read them any more."""
        for t in tables:
            if path := getattr(t, "_scratch", None):
                self._delete(path)

    def drop(self) -> None:
        """Removes all tables, those of the catalog included."""
        atexit.unregister(self._at_exit)
        for name in self._tables:
            self.spark.sql(f"drop table if exists {name}")
        self._delete(self.path)

    def _at_exit(self) -> None:
        # the session may have been stopped before
        with contextlib.suppress(Exception):
            self.drop()


def settled(df: DataFrame, scratch: Scratch) -> DataFrame:
    """``df`` where a task that is run again reads its rows in the same order, as from files; else ``df`` written.

    Rows that come out of a shuffle may come in another order, so tasks must not number them."""
    return scratch.write(df) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """Only the id and the text, under names that can't clash: ``id`` long and ``text`` string, null text as empty."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def rows_of(batches: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[list[list]]:
    """Columns of rows gathered until the second one's texts reach ``max_bytes`` of UTF-8; a longer text comes last.

    Batches are cut before they become Python objects, so no more than ``max_bytes`` and one text are held as such."""
    out: list[list] = []
    held = 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            # through the row that reaches the limit
            stop = min(batch.num_rows, int(np.searchsorted(ends, before + max_bytes - held)) + 1)
            part = [c.to_pylist() for c in batch.slice(at, stop - at).columns]
            out = [a + b for a, b in zip(out, part, strict=True)] if out else part
            held += int(ends[stop - 1]) - before
            at = stop
            if held >= max_bytes:
                yield out
                out, held = [], 0
                give_back()
    if out:
        yield out


#: Glibc's way to give freed memory back to the system; other C libraries have none.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Bytes that a worker may hold on to: its libraries alone take nearly as much.
_KEPT = 110 << 20
#: Bytes of a batch that goes to a Python worker, and of those that it answers with.
_ARROW = 2 << 20


def give_back() -> None:
    """Gives freed memory of this process back to the system where it holds much: workers live on from stage to stage."""
    try:
        with open("/proc/self/statm") as f:
            fields = f.read().split()
    except OSError:  # no such file system
        return
    # resident pages less those shared with files
    if _TRIM and (int(fields[1]) - int(fields[2])) * mmap.PAGESIZE > _KEPT:
        _TRIM(0)


def small_batches(spark: SparkSession) -> None:
    """From now on the session's batches for Python hold 2 MB, unless it has asked for fewer: rows are counted by ten
    thousands otherwise, whatever their length, and texts are long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = re.match(r"(\d+)b?$", spark.conf.get(key))
    if held and not 0 < int(held[1]) < _ARROW:
        spark.conf.set(key, str(_ARROW))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that leaves no memory behind in its worker when the task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def log2_ceil(n: int) -> int:
    return max(0, math.ceil(math.log2(max(1, n))))
