"""Tables written once in the shared folder and read again, which cuts lineage for good.

The folder is the session's `spark.checkpoint.dir`; every executor and the driver see it. Each
table gets a folder of its own below the application's id, so a whole run is cleared by removing
one folder once its results are stored (`clear`).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folder of a local master where none is set, by application.
_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """URI of the shared folder; a temporary one only on a local master where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        name = spark.sparkContext.applicationId
        if name not in _local:
            _local[name] = "file://" + tempfile.mkdtemp(prefix="framelake-shared-")
        folder = _local[name]
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet and reads it back: computed once, and kept when executors are lost."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, *by: str) -> DataFrame:
    """Like `stored`, in buckets of some columns: a join or grouping on them reads it without a shuffle.

    The catalog holds the table while it is written and first read only; rows should be dealt by the same columns before, else a
    task writes a file for each bucket.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, *by).option("path", new_path(spark, name)).saveAsTable(table, format="parquet")
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay, as their path was given
    return out


def clear(spark: SparkSession) -> None:
    """Removes every table this application has written here."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
