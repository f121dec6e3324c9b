"""What several operators share: the shared scratch folder, size-checked joins, and connected components."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: A side of a join is broadcast only if the measured bytes of its rows stay under BROADCAST_BYTES.
BROADCAST_BYTES = 48 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own in local mode (tests). On a cluster
    the setting is required, since a folder of the driver's machine would not be seen by executors."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/lumenreel-shared-{os.getuid()}"
        os.makedirs(root.removeprefix("file://"), exist_ok=True)
    return root.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit; what is left is scratch
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/lumenreel/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def cut(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes df to the shared folder and reads it again: lost executors later cost no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def forget(*dfs: DataFrame) -> None:
    """Removes tables made by cut() that nothing reads any more."""
    for df in dfs:
        if path := getattr(df, "_scratch", None):
            _remove(df.sparkSession, path)


def own_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as make it none of df's columns (Spark doesn't tell upper from lower case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _bytes(kind: DataType, c: Column) -> Column:
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 16
    if isinstance(kind, ArrayType):
        flat = isinstance(kind.elementType, StructType) and len(kind.elementType) * 8 + 16 or 8
        if isinstance(kind.elementType, (StringType, BinaryType, ArrayType)):
            return F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + _bytes(kind.elementType, x)), F.lit(0).cast("long"))
        return F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0)).cast("long") * flat + 32
    return F.lit(16).cast("long")


def measured_bytes(df: DataFrame) -> int:
    """What the rows of a stored table take, by the lengths of its strings and arrays; 0 for no rows."""
    width = F.lit(16).cast("long")
    for f in df.schema.fields:
        width = width + _bytes(f.dataType, F.col(f.name))
    return int(df.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0])


def small_side(df: DataFrame) -> DataFrame:
    """df, a stored table, marked for broadcast if its measured bytes stay under BROADCAST_BYTES, else as it is."""
    return F.broadcast(df) if measured_bytes(df) <= BROADCAST_BYTES else df


#: Rows of a key that one task sums up in earlier().
FAN = 1024


def earlier(df: DataFrame, keys: list[str], at: str, value: str, how: str, top: int, fan: int = FAN) -> DataFrame:
    """df (at most one row of keys and at; at from 0 to top) with _before: what the rows of the same keys at a smaller `at` come to, their sum of value or
    the last that isn't null; null if there are none.

    Windows go over at most `fan` neighbouring places; the windows' totals are treated the same way, so there are log(top) / log(fan) levels and no task
    holds more than `fan` rows of a key, however many there are."""
    pick = {"sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True)}[how]
    rows = (Window.unboundedPreceding, -1)
    if top < fan:
        return df.withColumn("_before", pick(value).over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(at).rowsBetween(*rows)))
    up = f"{at}_up"
    inner = df.withColumn(up, F.floor(F.col(at) / fan)).withColumn("_in", pick(value).over(Window.partitionBy(*keys, up).orderBy(at).rowsBetween(*rows)))
    total = F.sum(value) if how == "sum" else F.max_by(value, F.when(F.col(value).isNotNull(), F.col(at)))
    blocks = df.groupBy(*keys, F.floor(F.col(at) / fan).alias(up)).agg(total.alias("_total"))
    outer = earlier(blocks, keys, up, "_total", how, top // fan, fan).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, up])], F.col("_before").alias("_outer"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, up])]
    both = F.when(F.col("_in").isNull(), F.col("_outer")).when(F.col("_outer").isNull(), F.col("_in")).otherwise(F.col("_in") + F.col("_outer")) if how == "sum" else F.coalesce("_in", "_outer")
    return inner.join(outer, same, "left").select(*df.columns, both.alias("_before"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least reachable index of each of n nodes under links a-b."""
    label = np.arange(n)
    while True:
        lo = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, lo)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def spanning(n: int, a: np.ndarray, b: np.ndarray, chunk: np.ndarray, cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what a-b connect among the n nodes of a cell. A cross cell holds two chunks of a group, each of which has a cell of its
    own: there only what joins components of the two comes out, so that a large group's cells don't all return what one has told."""
    if not cross:
        root = forest(n, a, b)
        i = np.flatnonzero(root != np.arange(n))
        return i, root[i]
    own = chunk[a] == chunk[b]
    label = forest(n, a[own], b[own])
    root = forest(n, label[a[~own]], label[b[~own]])
    i = np.flatnonzero((root != np.arange(n)) & (label == np.arange(n)))
    return i, root[i]


def components(edges: DataFrame, name: str = "cc", a: str = "a", b: str = "b") -> DataFrame:
    """Distributed union-find: (node long, root long) for every node of edges(a long, b long); root is the least node
    of the component.

    Large-star and small-star rounds (Kiveris et al. 2014) until the edge set stops changing, however many that takes. Large-star: every
    node's larger neighbours link to the node's least neighbour. Small-star: the node and its smaller neighbours link to the
    least. Minima are pre-aggregated on the map side. Both sides of each join are stored first, so that AQE can split the
    partition of a hot node. The tables of a round go when the next one stands. Nulls and self-loops are ignored; no edges
    give no rows.
    """
    e = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), name)
    before = None
    while (now := e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()) != before:
        before = now
        both = e.select(F.col("u").alias("n"), F.col("v").alias("m")).union(e.select(F.col("v").alias("n"), F.col("u").alias("m")))
        least = cut(both.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("lo")), name)
        large = cut(both.where("m > n").join(least, "n").where("m != lo").select(F.col("m").alias("u"), F.col("lo").alias("v")).distinct(), name)
        low = cut(large.groupBy("u").agg(F.min("v").alias("lo")), name)
        pair = F.array(F.struct(F.col("u").alias("u"), F.col("lo").alias("v")), F.struct(F.col("v").alias("u"), F.col("lo").alias("v")))
        small = cut(large.join(low, "u").select(F.explode(pair).alias("x")).select("x.*").where("u != v").distinct(), name)
        forget(e, least, large, low)
        e = small
    return cut(e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), name)
