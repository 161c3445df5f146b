"""Tables written between steps, in the folder that the cluster shares.

``spark.checkpoint.dir`` names a folder every executor and the driver can read,
so a table written there survives the loss of an executor and cuts the lineage.
Where it is unset, a session on one machine (tests) takes a temporary folder; on
a cluster that is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a finished write go at once, not when the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A file written from staged tables stands for so many of their bytes at least, unless cores would be idle.
LEAST_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session. Where none is set, a session on this machine alone gets a temporary one; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kinspan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """The path and its file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/kinspan/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> None:
    """``df`` as Parquet in a new folder, which goes when the application ends, if not before."""
    df.write.parquet(path)
    target, system = hadoop_path(df.sparkSession, path)
    system.deleteOnExit(target)


def files_for(*tables: DataFrame) -> int:
    """How many files at most are worth writing for what is made of these staged tables: each costs a file system several calls, and on a local one several processes."""
    size = sum(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() for t in tables)
    return max(2 * tables[0].sparkSession.sparkContext.defaultParallelism, -(-size // LEAST_BYTES))


def staged(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back. With ``files``, small partitions share a file where there are more; none is left out."""
    spark = df.sparkSession
    df = df if files is None else df.coalesce(files)
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
        written(df, path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the folders of a staged table that nothing reads any more."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/kinspan/"
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if root.split(":", 1)[-1].lstrip("/") in path:
            target, system = hadoop_path(spark, path)
            system.delete(target, True)
