"""Lineage cuts that survive lost executors: Parquet tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (single-machine tests) a temporary folder is made and remembered.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("a cluster must name a folder that all machines share in spark.checkpoint.dir")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["scratch_path"] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more (all that came of them has been written itself)."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.__dict__["scratch_path"])
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def once(column: Column) -> Column:
    """The same values, computed once a row: the optimiser copies nothing that depends on the task into filters or lambdas."""
    return F.when(F.spark_partition_id() >= 0, column)


def lowest(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest hash of ``key`` (a bounded sample), ties in its order.

    Rows under a threshold that a count gives are sorted, so a task hands on
    about its share of ``n`` rows, not ``n``.
    """
    total = df.count()
    hashed = df.withColumn("__h", F.xxhash64(F.col(key).cast("string"), F.lit(5)))
    if total > 2 * n + 1000:
        # Twice as many as are wanted: the chance to get fewer is nil.
        edge = int((2 * n + 1000) / total * 2.0**64) - (1 << 63)
        hashed = hashed.where(F.col("__h") < F.lit(edge))
    return hashed.orderBy("__h", key).limit(n).drop("__h")
