"""Structured Streaming: appearance sessions, tumbling windows, label edits, incremental ingestion and cluster assignment.

Streams that are drained (trigger availableNow) write each micro-batch under its number, so a batch that runs twice replaces itself, and the latest
row of a key counts. Checkpoints and output live in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clustering, state
from ..params import Clustering
from ..storage import scratch, stored


def utc(spark: SparkSession) -> SparkSession:
    """A session whose zone is UTC, so zone-less timestamps keep their fields as event times."""
    s = spark.newSession()
    s.conf.set("spark.sql.session.timeZone", "UTC")
    return s


def events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of event files with ts as event time."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(_glob(path))
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _glob(path: str) -> str:
    """The same path as a pattern: a plain one would have to be a folder."""
    head, _, name = path.rpartition("/")
    return f"{head}/[{name[0]}]{name[1:]}"


def appearances(stream: DataFrame, keys: list[str], gap: str = "10 seconds", late: str = "1 hour") -> DataFrame:
    """(keys, start, n): sessions; events exactly a gap apart are one session. In append mode a session comes out, and its state goes, once the
    watermark has passed its end."""
    w = F.session_window("ts", gap)
    return stream.withWatermark("ts", late).groupBy(*keys, w.alias("w")).agg(F.min("ts").alias("start"), F.count("*").alias("n")).select(*keys, "start", "n")


def windows(stream: DataFrame, keys: list[str], size: str = "1 second", late: str = "1 hour") -> DataFrame:
    """(keys, start, n, peak): tumbling windows."""
    return stream.withWatermark("ts", late).groupBy(*keys, F.window("ts", size).alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("peak")).select(*keys, F.col("w.start").alias("start"), "n", "peak")


def drain(result: DataFrame, mode: str, keys: list[str], name: str) -> str:
    """Runs a stream over what there is; returns the folder of its rows, by batch."""
    spark = result.sparkSession
    out, memory = scratch(spark, name), scratch(spark, f"{name}-checkpoint")

    def save(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")

    result.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", memory).trigger(availableNow=True).start().awaitTermination()
    return out


def latest(spark: SparkSession, out: str, keys: list[str], complete: bool) -> DataFrame:
    """What a drained stream's rows come to: the last batch (complete mode), or each key's last row (update mode)."""
    rows = spark.read.parquet(out)
    if complete:
        return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").drop("batch")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")


def drained_appearances(spark: SparkSession, d: str) -> DataFrame:
    s = utc(spark)
    keys = ["user_id", "event_type"]
    r = appearances(events(s, f"{d}/events.parquet"), keys, "6 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))
    return latest(spark, drain(r, "complete", keys, "stream-appearances"), keys, True)


def drained_windows(spark: SparkSession, d: str) -> DataFrame:
    s = utc(spark)
    r = windows(events(s, f"{d}/events.parquet"), ["user_id"], "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))
    return latest(spark, drain(r, "update", ["user_id", "start"], "stream-windows"), ["user_id", "start"], False)


def drained_edits(spark: SparkSession, d: str) -> DataFrame:
    """A log of label edits, the last write of a cluster wins. The state is a row a cluster, as large as the table of people that it keeps, and
    an edit may come at any time, so it has no watermark."""
    s = utc(spark)
    e = events(s, f"{d}/events.parquet").groupBy(F.col("user_id").alias("cluster_id")).agg(F.max_by("event_type", "event_id").alias("name"))
    return latest(spark, drain(e, "update", ["cluster_id"], "stream-edits"), ["cluster_id"], False)


def _new(df: DataFrame, store: state.SnapshotStore, table: str) -> DataFrame | None:
    """A batch's rows whose ids the table doesn't have, one an id; None if there are none. Of the table only folders and row groups whose ids lie in the batch's range
    are read."""
    df = stored(df.dropDuplicates(["id"]), "batch")
    span = df.agg(F.min("id"), F.max("id")).first()
    if span[0] is None:
        return None
    old = store.read(table, key="id", between=tuple(span))
    new = df if old is None else stored(df.join(old.select("id"), "id", "left_anti"), "batch-new")
    return None if new.isEmpty() else new


def ingest(stream: DataFrame, store: state.SnapshotStore, checkpoint: str, table: str = "faces"):
    """Appends what a stream brings to a stored table, a version a batch; only new rows are written. Ids that the table has already are
    skipped, so a repeated batch adds nothing. Rows without an id are left out."""

    def save(df: DataFrame, number: int) -> None:
        new = _new(df.where("id is not null"), store, table)
        if new is not None:
            now = store.current(table)
            store.append(table, new if now is None else new.select(store.read(table, now).columns), key="id")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def assign(stream: DataFrame, store: state.SnapshotStore, checkpoint: str, p: Clustering = Clustering()):
    """Assigns incoming faces(id, embedding) to clusters, forms new ones of the rest, and stores them: a batch reads the sums of each cluster's vectors
    (table face_sums, a row a batch and cluster), not the faces, and writes its own rows. Stored faces without a cluster are assigned with the batch and stored as changes.
    Only without any cluster so far all faces, noise too, are clustered anew. Sums are stored before faces, under the batch's number, so a batch that
    runs again puts the same in their place."""

    def save(df: DataFrame, number: int) -> None:
        new = _new(df.where("id is not null").select("id", "embedding"), store, "faces")
        if new is None:
            return
        known, total = store.read("faces"), store.read("face_sums")
        if known is not None and total is None:
            store.commit("face_sums", _keyed(clustering.sums(known), "first"), "key")
            total = store.read("face_sums")
        total = None if total is None else total.where(F.col("batch") != str(number))
        pending = None if known is None else known.where("cluster_id is null")  # row groups without nulls are skipped
        if total is None or total.isEmpty():
            pending = None if known is None else known
            every = new if known is None else known.select("id", "embedding").unionByName(new)
            labels = clustering.fit(every, p)
        else:
            every = new if pending is None else pending.select("id", "embedding").unionByName(new)
            labels = clustering.join_clusters(every, clustering.summed_centroids(total), p)
        labels = stored(labels, "assign-labels")
        rows = new.join(labels, "id")
        changed = None if pending is None else stored(state.assign_clusters(pending, labels), "assign-changed")
        all_ = rows.select("embedding", "cluster_id") if changed is None else rows.select("embedding", "cluster_id").unionByName(changed.select("embedding", "cluster_id"))
        store.apply("face_sums", stored(_keyed(clustering.sums(all_), str(number)), "assign-sums"), "key")
        if changed is not None and not changed.isEmpty():
            store.apply("faces", changed, "id")
        like = rows if known is None else known
        store.append("faces", rows.select([F.col(c) if c in rows.columns else F.lit(None).cast(dict(like.dtypes)[c]).alias(c) for c in like.columns]), key="id")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _keyed(sums: DataFrame, batch: str) -> DataFrame:
    return sums.select(F.concat_ws(":", F.lit(batch), "cluster_id").alias("key"), F.lit(batch).alias("batch"), "cluster_id", "n", "total")
