"""Changes merged when a table is read, ranges of keys, leases, and streams that write in proportion to their batches."""

from pathlib import Path

from lumenreel.operators import state
from lumenreel.streaming import streams
from pyspark.sql import functions as F

from .test_streams import files, stream


def rows(df):
    return sorted(map(tuple, df.collect()))


def written(root, n):
    return sum(p.stat().st_size for p in Path(root, f"v={n}").rglob("*.parquet"))


def test_changes_are_merged_in_order(spark, tmp_path):
    store = state.SnapshotStore(spark, f"file://{tmp_path}/s")
    t = lambda data, schema="id long, v string": spark.createDataFrame(data, schema)
    store.commit("t", t([(i, "base") for i in range(5000)]), "id")
    want = {i: "base" for i in range(5000)}

    def change(data, gone=()):
        store.apply("t", t([(i, v, False) for i, v in data] + [(i, None, True) for i in gone], "id long, v string, _gone boolean"), "id")
        want.update(data)
        for i in gone:
            want.pop(i, None)
        assert dict(rows(store.read("t"))) == want

    change([(1, "one"), (7000, "new")], gone=[2, 99_999])
    store.append("t", t([(8000, "appended")]), key="id")
    want[8000] = "appended"
    change([(1, "again"), (2, "back"), (8000, "changed")], gone=[3])
    v = store.current("t")
    assert written(f"{tmp_path}/s/t", v) * 5 < written(f"{tmp_path}/s/t", store.parts("t", v)[0])
    assert dict(rows(store.read("t", key="id", between=(1, 3)))) == {1: "again", 2: "back"}
    assert rows(store.read("t", key="id", between=(8000, 9000))) == [(8000, "changed")]
    assert rows(store.read("t", key="id", between=(10**6, 10**7))) == []
    for i in range(4):
        store.apply("t", t([(i, f"n{i}")]), "id", most=4)
        want[i] = f"n{i}"
    assert dict(rows(store.read("t"))) == want and len(store.parts("t", store.current("t"))) <= 4


def test_leases_and_restore(spark, tmp_path):
    store = state.SnapshotStore(spark, f"file://{tmp_path}/s", keep=2)
    store.commit("t", spark.range(3))
    first = store.current("t")
    with store.lease("t") as opened:
        for i in range(5):
            store.commit("t", spark.range(10 + i))
        assert opened.count() == 3
        store.restore("t", first)
        assert store.read("t").count() == 3
        store.commit("t", spark.range(1))
    for _ in range(3):
        store.commit("t", spark.range(2))
    assert first not in store.versions("t") and store.read("t").count() == 2


def test_ranges_skip_folders(spark, tmp_path):
    store = state.SnapshotStore(spark, f"file://{tmp_path}/s")
    for i in range(4):
        store.append("t", spark.range(1000 * i, 1000 * i + 10), key="id")
    part = store.read("t", key="id", between=(2000, 2005))
    assert {Path(f).parent.name for f in part.inputFiles()} == {"v=2"} and part.count() == 6
    assert "PushedFilters: [IsNotNull(id), GreaterThanOrEqual(id,2000)" in part._jdf.queryExecution().toString()


def test_a_batch_writes_its_own_rows(spark, tmp_path):
    schema = "id long, embedding array<double>"
    near = lambda x, i: [x + i / 1000, 0.0]
    files(spark, tmp_path, [[(10_000 + i, near(0.0, i)) for i in range(3)], [(20_000 + i, near(9.0, i)) for i in range(6)] + [(21_000 + i, near(-9.0, i)) for i in range(6)], [(30_000, near(9.0, 1)), (20_001, near(0.0, 0))]], schema)
    store = state.SnapshotStore(spark, f"file://{tmp_path}/store")
    base = [(i, near(0.0, i % 50), 4) for i in range(8000)] + [(9000, near(0.0, 1), None)]
    store.commit("faces", spark.createDataFrame(base, f"{schema}, cluster_id int").coalesce(1), "id")
    streams.assign(stream(spark, tmp_path, schema), store, f"{tmp_path}/memory").awaitTermination()
    got = {r["id"]: r["cluster_id"] for r in store.read("faces").collect()}
    assert len(got) == 8017 and {got[i] for i in (9000, 10_000, 10_002)} == {4}
    assert {got[20_000 + i] for i in range(6)} == {got[30_000]} == {5} and {got[21_000 + i] for i in range(6)} == {6}
    now = store.folders("faces", store.current("faces"))
    first = written(f"{tmp_path}/store/faces", now[0]["n"])
    assert all(written(f"{tmp_path}/store/faces", x["n"]) * 5 < first for x in now[1:]) and len(now) == 5
    sums = store.read("face_sums").groupBy("cluster_id").agg(F.sum("n").alias("n"))
    assert rows(sums) == [(4, 8004), (5, 7), (6, 6)]
    streams.assign(stream(spark, tmp_path, schema), store, f"{tmp_path}/other").awaitTermination()  # the same files again
    assert store.read("faces").count() == 8017 and rows(store.read("face_sums").groupBy("cluster_id").agg(F.sum("n"))) == [(4, 8004), (5, 7), (6, 6)]
