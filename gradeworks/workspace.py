"""Where intermediate tables live, and how lineage is cut.

Intermediate tables are written under the folder in ``spark.checkpoint.dir``, which every executor
of a cluster shares.  Only a local session without that setting gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; raises on a cluster where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='gradeworks-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts the lineage durably."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def forget(*tables: DataFrame | None) -> None:
    """Delete the files behind tables made by :func:`materialize`, which nothing may read any more."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path:
            remove_path(df.sparkSession, path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path made by :func:`scratch_path`."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it needs to tell."""
    return df.limit(rows + 1).count() <= rows
