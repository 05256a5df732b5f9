"""Session helpers: where intermediate tables go, and how lineage is cut.

Everything durable goes below the folder named by ``spark.checkpoint.dir``,
which the cluster shares between driver and executors.  Where that setting is
absent, a local session (tests, notebooks) gets a temporary folder; any other
is refused, as its executors would each write to a folder of their own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quillgrove-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet below the shared folder and read it back.

    Unlike ``checkpoint()`` this runs the plan a single time, keeps columns
    prunable and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillgrove/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table written by :func:`materialize` that nothing reads any more."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/quillgrove/"
    jvm = spark._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if root.split(":", 1)[-1].lstrip("/") in folder.toString():
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
