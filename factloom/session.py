"""Session helpers shared by tests, the bench and the driver entry."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "factloom", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests rely on."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Where neither is set, a local session, which is one process, gets a new
    folder as the context's; a cluster must name one.
    """
    at, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not at:
        at = context.getCheckpointDir()
    if not at:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
        at = context.getCheckpointDir()
    return at.rstrip("/")


def _files(spark: SparkSession, path: str):
    """Hadoop's path and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder."""
    where, files = _files(spark, path)
    return files.exists(where)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back, which cuts its lineage.

    All of an application's tables lie in one folder, which goes when its driver ends.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    where, files = _files(spark, folder)
    if not files.exists(where):
        files.mkdirs(where)
        files.deleteOnExit(where)
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove what materialize() wrote for this frame, which nothing may read any more."""
    for name in df.inputFiles()[:1]:
        where, files = _files(df.sparkSession, name)
        files.delete(where.getParent(), True)
