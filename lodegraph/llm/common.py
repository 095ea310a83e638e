"""Shared plumbing of the training-data operators: shared storage, partition counts, column access."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch: texts can be long, so batches are kept short.
ARROW_ROWS = 512
#: Rows, of a few numbers each, that a join may broadcast.
FEW = 1 << 14
#: Without Hadoop's native library the local file system starts a process for each file and folder that it makes, and
#: one more for each checksum file; the raw one writes none of these. Other file systems don't look at this.
LOCAL_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one where that is unset and all runs on this machine, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="lodegraph-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone when the process ends
        pass


class Scratch:
    """Tables written to the shared folder to cut lineage: a lost executor never recomputes past them."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: list[str] = []
        atexit.register(_delete, spark, self.base)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}-{self.n}"
        self.n += 1
        df.write.options(compression="zstd", **LOCAL_FILES).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.paths.append(path)
        return out

    def keep(self, *paths: str) -> None:
        """Deletes all tables but these."""
        for path in self.paths:
            if path not in paths:
                _delete(self.spark, path)
        self.paths = list(paths)

    def drop(self, df: DataFrame | None) -> None:
        """Deletes a table of write() that no later step reads."""
        if df is not None and getattr(df, "_scratch_path", None):
            _delete(self.spark, df._scratch_path)


def short_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def slices(batch: pa.RecordBatch, column: int, rows: int = 128, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with so many rows and bytes of text at most, or one row; what numpy makes of a part follows its size."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    at = held = 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and (held + n > size or i - at >= rows):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)


def side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A side of a join: broadcast if it has FEW rows at most, shuffled with the other side if it has more or their number isn't known.

    The planner takes a table to be as large as its compressed files, and rows exploded from it no larger; what it
    broadcasts by that measure can be a hundred times its limit and has to fit the driver.
    """
    return F.broadcast(df) if rows is not None and rows <= FEW else df.hint("merge")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def few_tasks(df: DataFrame) -> DataFrame:
    """The same partitions in fewer tasks, one a core at least, for tables of short rows: each task that writes makes a file."""
    spark = df.sparkSession
    return df.coalesce(max(spark.sparkContext.defaultParallelism, shuffle_parts(spark) // 32))


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with null texts as empty ones; other columns are ignored, whatever they are called."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
