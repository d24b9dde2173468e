"""Table scans by name."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``base`` (a file or a folder of files)."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Rows dealt out over all cores when the scan has fewer splits than cores.

    A file with a single row group is a single task, which starves Python stages on small inputs: only there
    the rows are shuffled. Large inputs have more splits than cores and pass through without a shuffle.
    """
    spark = df.sparkSession
    least = least or spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= least else df.repartition(least)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one that the cluster names in ``spark.checkpoint.dir``; it goes when the application ends.

    Only where that is unset and the master is local is it a temporary folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    files, place = on_disk(spark, path)
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


def on_disk(spark: SparkSession, path: str):  # noqa: ANN201
    """The file system of a path, whichever it is, and the path as it knows it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table and read back: its lineage is cut, and losing an executor loses nothing of it."""
    path = f"{shared_folder(df.sparkSession, name)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
