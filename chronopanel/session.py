"""Session settings and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators rely on; safe to call repeatedly."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    # The JVM does not compile methods above 8000 bytes; a wide feature projection fused into
    # one such method runs many times slower than the same projection split into small ones.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate data; only a local session gets its own."""
    shared = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


# What was stored or cached since each open `stored` block began.
_open: list[tuple[list[str], list[DataFrame]]] = []


def new_folder(spark: SparkSession, kind: str) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    for folders, _ in _open:
        folders.append(path)
    return path


def keep(df: DataFrame) -> DataFrame:
    """Cache a small table; an enclosing `stored` block gives the memory back."""
    for _, tables in _open:
        tables.append(df)
    return df.persist()


@contextmanager
def stored(spark: SparkSession) -> Iterator[None]:
    """On leaving the block, remove the folders and cached tables that were made within it.

    Results must be written or collected inside. Without a block they stay as long as the shared folder does.
    """
    scope: tuple[list[str], list[DataFrame]] = ([], [])
    _open.append(scope)
    try:
        yield
    finally:
        _open.remove(scope)
        for table in scope[1]:
            table.unpersist()
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for folder in scope[0]:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write a result once, as a table in the shared folder, and read it from there.

    Later jobs then neither recompute it nor depend on executors that held it,
    and still read only the columns they use.
    """
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
