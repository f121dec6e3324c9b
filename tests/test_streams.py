"""Ingestion, incremental clusters, versions of tables, and a stream that is drained in several batches."""

from pyspark.sql import functions as F

from lumenreel.operators import state
from lumenreel.streaming import streams


def files(spark, folder, parts, schema):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/in/{i}")


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def test_ingest_adds_new_rows_only(spark, tmp_path):
    schema = "id long, name string"
    files(spark, tmp_path, [[(1, "a"), (2, "b")], [(2, "again"), (3, "c"), (3, "c")], [(4, "d")]], schema)
    store = state.SnapshotStore(spark, f"file://{tmp_path}/store")
    streams.ingest(stream(spark, tmp_path, schema), store, f"{tmp_path}/memory").awaitTermination()
    assert sorted(r["id"] for r in store.read("faces").collect()) == [1, 2, 3, 4]
    n = [store.read("faces", v).count() for v in sorted(store.parts("faces", store.current("faces")))[-1:]]
    assert n == [4] and len(store.parts("faces", store.current("faces"))) == 3
    streams.ingest(stream(spark, tmp_path, schema), store, f"{tmp_path}/other").awaitTermination()  # the same files again
    assert store.read("faces").count() == 4


def test_appends_are_put_together(spark, tmp_path):
    store = state.SnapshotStore(spark, f"file://{tmp_path}/s", keep=2)
    for i in range(6):
        store.append("t", spark.range(i, i + 1), most=3)
    assert sorted(r[0] for r in store.read("t").collect()) == list(range(6))
    assert len(store.parts("t", store.current("t"))) <= 3
    store.commit("t", spark.range(2))
    store.commit("t", spark.range(1))
    assert store.read("t").count() == 1 and len(store.versions("t")) == 2


def test_assign_joins_known_clusters(spark, tmp_path):
    schema = "id long, embedding array<double>"
    near = lambda x, i: [x + i / 1000, 0.0]
    files(spark, tmp_path, [[(i, near(0.0, i)) for i in range(6)], [(100 + i, near(0.0, i)) for i in range(3)] + [(200 + i, near(9.0, i)) for i in range(6)]], schema)
    store = state.SnapshotStore(spark, f"file://{tmp_path}/store")
    store.commit("faces", spark.createDataFrame([(i, near(0.0, i), 4) for i in range(50, 56)], "id long, embedding array<double>, cluster_id int"))
    streams.assign(stream(spark, tmp_path, schema), store, f"{tmp_path}/memory").awaitTermination()
    got = {r["id"]: r["cluster_id"] for r in store.read("faces").collect()}
    assert len(got) == 21 and {got[i] for i in [*range(6), 100, 101, 102]} == {4} and all(got[200 + i] != 4 for i in range(6))


def test_sessions_close_behind_the_watermark(spark, tmp_path):
    s = streams.utc(spark)
    rows = [[(1, f"2024-01-01 00:00:{x:02d}") for x in (0, 10, 30)], [(1, "2024-01-01 05:00:00")], [(1, "2024-01-01 10:00:00")]]
    for i, r in enumerate(rows):
        s.createDataFrame(r, "k int, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    src = s.readStream.schema("k int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = streams.drain(streams.appearances(src, ["k"]), "append", ["k"], "test-sessions")
    got = sorted((str(r["start"])[11:], r["n"]) for r in s.read.parquet(out).collect())
    assert got[:2] == [("00:00:00", 2), ("00:00:30", 1)]
