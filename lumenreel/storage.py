"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own in local mode. On a cluster the setting is required, since a folder of the driver's
    machine would not be seen by executors."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/lumenreel-shared-{os.getuid()}"
        os.makedirs(root.removeprefix("file://"), exist_ok=True)
    return root.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit; what is left is scratch
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/lumenreel/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that one task numbers; more are dealt by ranges.
ONE_TASK = 1 << 16


def in_order(df: DataFrame, order: list[str], value: str | None = None, name: str = "in-order", one_task: int = ONE_TASK) -> DataFrame:
    """df with _n (its row's number from 1 in the order) and, for a value column, _before (the value's sum over the rows before).

    df is stored and counted. Up to one_task rows are numbered by one window. More are dealt by ranges of the order and numbered
    within their range; only a count and a sum of each range meet on the driver, at most as many as there are shuffle partitions.
    Rows that are equal in the order are numbered in any order."""
    df = stored(df, name)
    if df.count() <= one_task:
        w = Window.orderBy(*order)
        out = df.withColumn("_n", F.row_number().over(w).cast("bigint"))
        return out.withColumn("_before", F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) if value else out
    # stored with their numbers, so that both passes see the same ranges
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = stored(rows, name).withColumn("_part", F.shiftright("_id", 33))
    sums = [F.count("*").alias("n"), (F.sum(value) if value else F.lit(0)).alias("v")]
    n = v = 0
    offsets = []
    for r in sorted(rows.groupBy("_part").agg(*sums).collect()):
        offsets.append((r["_part"], n, v))
        n, v = n + r["n"], v + (r["v"] or 0)
    kind = dict(df.dtypes)[value] if value else "bigint"
    known = df.sparkSession.createDataFrame(offsets, f"_part bigint, _rows bigint, _sum {kind}")
    out = rows.join(F.broadcast(known), "_part").withColumn("_n", F.col("_id") - F.shiftleft("_part", 33) + F.col("_rows") + 1)
    if value:
        w = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("_before", F.coalesce(F.sum(value).over(w), F.lit(0)) + F.col("_sum"))
    return out.drop("_id", "_part", "_rows", "_sum")
