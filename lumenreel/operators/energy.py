"""Clip energy from levels per second: grid, score, bucket, peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..params import Energy


def loudness(samples: DataFrame, key: str = "path", rate: int = 16_000) -> DataFrame:
    """(key, sec, db) of every full second of samples(key, i, x)."""
    sec = F.floor(F.col("i") / rate).cast("int")
    return samples.groupBy(key, sec.alias("sec")).agg(F.avg(F.col("x") * F.col("x")).alias("ms"), F.count("*").alias("n")).where(F.col("n") == rate).select(key, "sec", N.decibels(F.col("ms")).alias("db"))


def grid(audio: DataFrame, motion: DataFrame, key: str = "video_id", p: Energy = Energy()) -> DataFrame:
    """(key, sec, a, m, level): levels on whole seconds, without gaps; motion is pooled by its maximum, what is missing is 0.

    audio: (key, sec, db); motion: (key, t, px). One pre-aggregating shuffle for both inputs, none for the gaps' filling."""
    last = Window.partitionBy(key)
    a = audio.select(key, F.col("sec").cast("int").alias("sec"), N.audio_level(F.col("db"), p).alias("a"), F.lit(0.0).alias("m"), (F.col("sec") + 1).cast("int").alias("n"))
    m = motion.select(key, F.floor("t").cast("int").alias("sec"), F.lit(0.0).alias("a"), N.motion_level(F.col("px"), p).alias("m"), (F.ceil("t") + 1).cast("int").alias("n"))
    some = a.unionByName(m).groupBy(key, "sec").agg(F.max("a").alias("a"), F.max("m").alias("m"), F.max("n").alias("n"))
    n = F.max("n").over(last)
    nxt = F.lead("sec").over(last.orderBy("sec"))
    first = F.row_number().over(last.orderBy("sec")) == 1
    filled = some.withColumn("n", n).withColumn("_to", F.coalesce(nxt, F.col("n")) - 1).withColumn("_from", F.when(first, F.lit(0)).otherwise(F.col("sec")))
    each = filled.select(key, F.explode(F.sequence("_from", "_to")).alias("s"), "sec", "a", "m")
    own = F.col("s") == F.col("sec")
    at, mt = F.when(own, F.col("a")).otherwise(0.0), F.when(own, F.col("m")).otherwise(0.0)
    return each.select(key, F.col("s").alias("sec"), at.alias("a"), mt.alias("m"), N.either(at, mt).alias("level"))


def score(levels: DataFrame, key: str = "video_id", p: Energy = Energy()) -> DataFrame:
    """(key, score, bucket): mean of the top share of the seconds."""
    w = Window.partitionBy(key)
    k = F.greatest(F.lit(1), F.rint(F.count(F.lit(1)).over(w) * p.top_share).cast("int"))
    top = levels.withColumn("_r", F.row_number().over(w.orderBy(F.desc("level"), "sec"))).withColumn("_k", k).where("_r <= _k")
    return top.groupBy(key).agg(F.avg("level").alias("score")).withColumn("bucket", N.bucket(F.col("score"), p))


def peaks(levels: DataFrame, key: str = "video_id", p: Energy = Energy()) -> DataFrame:
    """(key, peaks array<double>): up to p.peak_max local maxima, the highest first chosen, p.peak_gap apart; ascending."""
    w = Window.partitionBy(key).orderBy("sec")
    v = F.col("level")
    high = levels.withColumn("_l", F.lag("level").over(w)).withColumn("_n", F.lead("level").over(w)).where((v >= p.peak_min) & (v >= F.coalesce("_l", v)) & (v >= F.coalesce("_n", v)))
    best = F.array_sort(F.collect_list(F.struct((-v).alias("neg"), F.col("sec").cast("double").alias("sec"))))

    def choose(got, x):
        room = F.size(got) < p.peak_max
        clear = F.forall(got, lambda g: F.abs(g - x["sec"]) >= p.peak_gap)
        return F.when(room & clear, F.concat(got, F.array(x["sec"]))).otherwise(got)

    return high.groupBy(key).agg(best.alias("best")).select(key, F.array_sort(F.aggregate("best", F.array().cast("array<double>"), choose)).alias("peaks"))


def upper_mean(values: DataFrame, key: str, value: str) -> DataFrame:
    """Mean of the largest quarter of a key's values, of one at least."""
    w = Window.partitionBy(key)
    top = values.withColumn("_r", F.row_number().over(w.orderBy(F.desc(value)))).withColumn("_k", F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) / 4).cast("int"))).where("_r <= _k")
    return top.groupBy(key).agg(F.avg(value).alias(value))


def stale(videos: DataFrame, p: Energy = Energy()) -> DataFrame:
    """Videos whose energy must be computed again."""
    return videos.where(F.col("energy_bucket").isNull() | (F.coalesce("energy_version", F.lit(0)) != p.version))
