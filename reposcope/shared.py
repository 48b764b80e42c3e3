"""Tables in the folder that driver and executors share: lineage is cut by writing and reading back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Rows that one task groups where tasks are counted by rows, so that its memory stays as it is at any size.
ROWS_A_TASK = 1_000_000


def tasks_for(rows: DataFrame) -> int:
    """How many tasks rows are grouped in: by their number (of a table's columns only footers are read), and no
    fewer than there are cores."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_TASK))


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Without one a local folder is made on a local master
    (tests); on a cluster that is an error."""
    found = spark.conf.get(CHECKPOINT_KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_KEY} names no shared folder")
        found = "file://" + tempfile.mkdtemp(prefix="reposcope-")
        spark.conf.set(CHECKPOINT_KEY, found)
    return found.rstrip("/")


class Scratch:
    """Tables that are written and read back, so that what comes after does not make them again, nor does a
    lost executor; ``release`` (or the end of a with block) removes them, the end of the session's JVM
    in any case."""

    def __init__(self):
        self.paths: list = []

    def path(self, spark: SparkSession, label: str) -> str:
        """A new path, removed with the others."""
        path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        disk = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        disk.deleteOnExit(target)
        self.paths.append((disk, target))
        return path

    def written(self, df: DataFrame, label: str) -> DataFrame:
        spark = df.sparkSession
        path = self.path(spark, label)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        for disk, target in self.paths:
            disk.delete(target, True)
            disk.cancelDeleteOnExit(target)
        self.paths = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.release()


def written(df: DataFrame, label: str) -> DataFrame:
    """As ``Scratch.written``, for the rest of the session."""
    return Scratch().written(df, label)
