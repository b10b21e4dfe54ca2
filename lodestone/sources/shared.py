"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What the cluster names in spark.checkpoint.dir; made up only in local mode, where driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not is_local(spark):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lodestone-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """Where this application's tables go."""
    return f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete all of this application's intermediate tables; results that are not read yet are lost with them."""
    fs, at = hadoop_path(spark, run_dir(spark))
    fs.delete(at, True)


def is_local(spark: SparkSession) -> bool:
    master = spark.conf.get("spark.master", "")
    return master == "local" or master.startswith("local[")


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{run_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Written and read again: lineage ends here, and a lost executor costs no more than its tasks."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) as Spark's own readers see it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def write_files(spark: SparkSession, contents: dict[str, bytes]) -> str:
    """A new folder with these small files; its path."""
    folder = scratch(spark, "files")
    for name, data in contents.items():
        fs, at = hadoop_path(spark, f"{folder}/{name}")
        stream = fs.create(at)
        try:
            stream.write(data)
        finally:
            stream.close()
    return folder
