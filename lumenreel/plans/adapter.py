"""The library's relations, projected from the shared test tables; each DataFrame has its SQL twin in VIEWS.

faces come from events (a face's time is microseconds since 2024 over a million), videos from their users, auto_tags and frames from embeddings, text and paths from
documents and pages. Seconds are computed from integer microseconds, so both engines divide the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLUSTERS = {"click": 0, "view": 1, "purchase": 2, "signup": 3}
PEOPLE = ((0, "Ellie"), (1, "Grayson"), (2, " grayson"), (3, "Rowan"))
TAGS = ("Beach", "kids", " Wedding ", "dog")
ROOTS = ["/lib/3", "/lib/1"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def micros(ts: str = "ts"):
    """Microseconds since 2024 of a zone-less timestamp, by its own fields, whatever the session's zone."""
    return F.expr(f"(datediff(cast({ts} as date), date'2024-01-01') * 86400L + hour({ts}) * 3600L + minute({ts}) * 60L) * 1000000L + cast(extract(second from {ts}) * 1000000 as bigint)")


def faces(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    cluster = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CLUSTERS.items() for x in kv]), F.col("event_type")), F.lit(-1))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("video_id"), (micros() / 1e6).alias("timestamp_sec"), cluster.cast("int").alias("cluster_id"), F.col("value"))


def people(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(c).alias("cluster_id"), F.lit(n).alias("name")) for c, n in PEOPLE])).alias("x")).select("x.*")


def videos(spark: SparkSession, d: str) -> DataFrame:
    """Duration is the last face's time; folders /lib/0 to /lib/11, so that /lib/1 is a prefix of others; a clip's batch tags and energy follow its id."""
    v = faces(spark, d).groupBy(F.col("video_id").alias("id")).agg(F.max("timestamp_sec").alias("duration_sec"), F.round(F.avg("value"), 6).alias("energy_score"))
    tags = F.array(*[F.lit(t) for t in TAGS])
    i = F.col("id")
    return v.select(
        "id", F.concat(F.lit("/lib/"), (i % 12).cast("string"), F.lit("/Clip_"), i.cast("string"), F.lit(".MOV")).alias("path"), "duration_sec",
        F.slice(tags, (i % 4 + 1).cast("int"), F.lit(2)).alias("batch_tags"), F.array(F.lit("own word"), F.concat(F.lit("old "), (i % 3).cast("string"))).alias("written_keywords"),
        "energy_score", F.when(i % 4 == 0, "high").when(i % 4 == 1, "low").when(i % 4 == 2, "medium").alias("energy_bucket"),
        F.when(i % 3 == 0, F.array(F.lit(1.0), F.lit(2.5))).otherwise(F.array().cast("array<double>")).alias("energy_peaks"), (i % 3).cast("int").alias("energy_version"), (i % 7 != 0).alias("scan_complete"),
    )


def hidden(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1).select(F.lit(3).alias("cluster_id"))


def frames(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select((F.col("vec_id") % 50).alias("video_id"), F.floor(F.col("vec_id") / 50).cast("double").alias("timestamp_sec"), F.col("embedding").cast("array<double>").alias("embedding"), "vec_id", "label")


def auto_tags(spark: SparkSession, d: str) -> DataFrame:
    """A score for each (clip, label) that some vector of the clip's has: the share of the clip's vectors."""
    f = frames(spark, d).groupBy("video_id", "label").agg(F.count("*").alias("n"), F.max("vec_id").alias("m"))
    return f.select("video_id", F.concat(F.lit("Tag"), F.col("label").cast("string")).alias("tag"), (F.col("n") / 10 + F.col("m") % 7 / 1000).alias("score"))


VIEWS = {
    "faces": "SELECT event_id AS id, user_id AS video_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS timestamp_sec, CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE -1 END AS INTEGER) AS cluster_id, value FROM events",
    "people": "SELECT * FROM (VALUES (0, 'Ellie'), (1, 'Grayson'), (2, ' grayson'), (3, 'Rowan')) t(cluster_id, name)",
    "videos": "SELECT id, '/lib/' || CAST(id % 12 AS VARCHAR) || '/Clip_' || CAST(id AS VARCHAR) || '.MOV' AS path, duration_sec, list_slice(['Beach', 'kids', ' Wedding ', 'dog'], id % 4 + 1, id % 4 + 2) AS batch_tags, ['own word', 'old ' || CAST(id % 3 AS VARCHAR)] AS written_keywords, energy_score, CASE id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' END AS energy_bucket, CASE WHEN id % 3 = 0 THEN [1.0, 2.5] ELSE [] END AS energy_peaks, CAST(id % 3 AS INTEGER) AS energy_version, id % 7 <> 0 AS scan_complete FROM (SELECT video_id AS id, max(timestamp_sec) AS duration_sec, round(avg(value), 6) AS energy_score FROM faces GROUP BY video_id)",
    "frames": "SELECT vec_id % 50 AS video_id, CAST(vec_id // 50 AS DOUBLE) AS timestamp_sec, CAST(embedding AS DOUBLE[]) AS embedding, vec_id, label FROM embeddings",
    "auto_tags": "SELECT video_id, 'Tag' || CAST(label AS VARCHAR) AS tag, count(*) / 10 + max(vec_id) % 7 / 1000 AS score FROM frames GROUP BY video_id, label",
    "hidden": "SELECT 3 AS cluster_id",
}
NEEDS = {"videos": ["faces"], "auto_tags": ["frames"]}


def sql(body: str, *views: str) -> str:
    """A statement over the views named and those that they read."""
    order: list[str] = []
    for v in views:
        order += [x for x in [*NEEDS.get(v, []), v] if x not in order]
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in order) + "\n" + body if order else body
