"""Tables in the folder that driver and executors share; a plan's lineage ends there."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode without it, a new folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="quernstone-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a folder by the session's own file system."""
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended; the folder's owner clears it
        return


def kept(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a table in the shared folder, in folders by a column if asked: a lost executor costs no recomputation.

    The files go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/quernstone-{uuid.uuid4().hex}/{name}"
    (df.write.partitionBy(by) if by else df.write).option("compression", "zstd").parquet(path)
    atexit.register(forget, spark, path.rpartition("/")[0])
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """df as a table of the warehouse in buckets of a key, as many as the session's shuffles have parts: joins, windows and aggregates by the key read it without a shuffle.

    The table goes when the driver ends.
    """
    spark = df.sparkSession
    n, at = max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), f"quernstone_{name}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).format("parquet").option("compression", "zstd").saveAsTable(at)
    atexit.register(_gone, spark, at)
    return spark.table(at)


def _gone(spark: SparkSession, table: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    except Exception:  # the session has ended; the warehouse's owner clears it
        return


def dropped(table: DataFrame) -> None:
    """Deletes a table of kept() that nothing reads any more, before the driver ends."""
    for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
        forget(table.sparkSession, path)
