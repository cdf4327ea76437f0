"""Helpers that the corpus operators share: table access and written intermediate tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch to Python. Texts may be long, so batches stay short.
ARROW_ROWS = 512
ARROW_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Bound the size of the batches that go to Python workers, in rows and (one row at least) in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where it is unset, as in tests on one machine, a temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = getattr(shared_dir, "own", None)
        if root is None:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="chartstone-")
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the process ends."""
    path = f"{shared_dir(spark)}/chartstone/{os.getpid()}-{uuid.uuid4().hex[:12]}/{name}"
    atexit.register(_remove_quietly, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and lost executors cost nothing.

    ``remove(spark, result.written_to)`` frees it early.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def majority(hashes: np.ndarray) -> int:
    """The 64-bit integer of the bits that are set in over half of the hashes; 0 if there are none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):  # those of a very long text go in parts
        part = np.ascontiguousarray(hashes[at : at + (1 << 15)]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def release(spark: SparkSession) -> None:
    """Let shuffle files go whose tables nothing refers to any more: Spark deletes them when the driver's JVM collects."""
    spark.sparkContext._jvm.System.gc()


def growing(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast: files of numbers are small beside what they hold, so the driver would take them in."""
    return df.hint("merge")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores put before it until df has no such column (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def own_columns(df: DataFrame) -> list[Column]:
    """df's columns by their exact names, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def ascii_lower(col):
    """A-Z to a-z, every other character as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
