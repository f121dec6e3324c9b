"""Gap sessions over timestamps: appearances and padded reel ranges. One window per key, one shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import Sessions


def appearances(df: DataFrame, keys: list[str], t: str = "timestamp_sec", gap: float = Sessions.appearance_gap) -> DataFrame:
    """The first timestamp of each run of a key in which no step is longer than gap."""
    w = Window.partitionBy(*keys).orderBy(t)
    before = F.lag(t).over(w)
    return df.select(*keys, t).withColumn("_before", before).where(F.col("_before").isNull() | (F.col(t) - F.col("_before") > gap)).select(*keys, t)


def ranges(df: DataFrame, keys: list[str], t: str = "timestamp_sec", p: Sessions = Sessions()) -> DataFrame:
    """(keys, start, end): timestamps merged up to p.merge_gap apart, padded, of p.min_length at least."""
    w = Window.partitionBy(*keys).orderBy(t)
    new = F.when(F.col(t) - F.lag(t).over(w) <= p.merge_gap, 0).otherwise(1)
    runs = df.select(*keys, t).withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = runs.groupBy(*keys, "_run").agg(F.min(t).alias("start"), F.max(t).alias("end"))
    return ends.select(*keys, F.greatest(F.lit(0.0), F.col("start") - p.pad).alias("start"), (F.col("end") + p.pad).alias("end")).where(F.col("end") - F.col("start") >= p.min_length)
