"""Tables written between the rounds of iterative plans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="latentfield-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: With this setting Spark deletes a query's shuffle files when the query ends, not when the driver's collector finds them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session with a setting, which is as before afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shuffles_end(spark: SparkSession) -> AbstractContextManager[None]:
    """Queries that begin and end inside leave no shuffle files."""
    return setting(spark, CLEANUP, "true")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and so do its shuffles."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    with shuffles_end(spark):
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table from staged() that no later plan reads. A table that is gone already is left at that."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: A table of up to so many bytes may be one row group, which one task would read and work on alone.
SMALL = 64 << 20


def size_of(df: DataFrame) -> int:
    """The optimizer's estimate of a table's bytes; for one that is read from files, what they hold."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def split_size(spark: SparkSession) -> int:
    """The most bytes of a file that one task reads."""
    return int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))


def spread(df: DataFrame, most: int = SMALL) -> DataFrame:
    """A table of up to so many bytes dealt out evenly if it has fewer files than there are cores; a larger one is left as it is, since its splits are enough."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size_of(df) <= most and len(df.inputFiles()) < cores else df
