"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a local session (as in tests) gets a temporary folder; on a
    cluster that is an error, as executors would not see it."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written once as a table in the shared folder and read back, and its path: cuts lineage and survives lost
    executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    return store(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that nothing reads any more, by the file system that wrote it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def filesystem(uri: str):
    """pyarrow's file system for a path or URI as Spark writes it, and the path in it; ValueError for an unknown scheme."""
    from pyarrow import ArrowInvalid, fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri.rstrip("/")
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].strip("/")
    scheme, rest = uri.split("://", 1)
    try:
        return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest.rstrip('/')}")
    except ArrowInvalid as e:
        raise ValueError(f"no file system for {scheme}://: {e}") from None


def spread(df: DataFrame) -> DataFrame:
    """A scan over at least as many partitions as there are cores. Rows that take long each (as encoding texts does) would
    keep most cores idle where a table has few files; larger tables, and plans that shuffle already, are left as they are."""
    plan = df._jdf.queryExecution()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if plan.executedPlan().nodeName() == "AdaptiveSparkPlan" or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
