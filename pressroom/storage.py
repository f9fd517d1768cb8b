"""Folders that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    Where that is unset, a session whose tasks all run in this process gets a temporary folder, as in tests; any other raises, since its machines share none.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, files = _file(spark, path)
    return files.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    p, files = _file(spark, path)
    return files.getFileStatus(p).isDirectory()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_base(spark)}/pressroom/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder, with options of the writer, and read it back."""
    path = new_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
