"""Clustering by cells against clustering in one task, and its parts against brute force."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from lumenreel.operators import clustering, density
from lumenreel.params import Clustering


def blobs(n, seed, dims=3, copies=0, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(2, n // 40), dims)) * 3
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dims)) * spread
    x[: n // 10] = rng.normal(size=(n // 10, dims)) * 6
    if copies:
        x[-copies:] = x[-copies - 1]
    return x[rng.permutation(n)]


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(range(len(x)) if ids is None else ids, x, strict=True)], "id long, embedding array<double>")


def labelled(df):
    return np.array([r.cluster_id for r in df.orderBy("id").collect()])


@pytest.mark.parametrize("ties", [False, True])
def test_tree_is_the_least(ties):
    rng = np.random.default_rng(2)
    w = rng.integers(1, 5, (60, 60)).astype(float) if ties else rng.random((60, 60))
    w = np.maximum(w, w.T)
    ids = rng.permutation(600)[:60]
    i, j, d = density.tree(60, w.__getitem__, ids)
    a, b = np.triu_indices(60, 1)
    lo, hi = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
    kept = density.kruskal(lo, hi, w[a, b])
    assert sorted(zip(np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), d)) == sorted(zip(lo[kept], hi[kept], w[a, b][kept]))


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("m, n", [(40, 25), (1, 30), (30, 1)])
def test_tree_between_is_the_least(ties, m, n):
    rng = np.random.default_rng(m + ties)
    d = rng.integers(1, 5, (m, n)).astype(float) if ties else rng.random((m, n))
    ids = rng.permutation(600)[: m + n]
    i, j, w = density.tree_between(d, ids[:m], ids[m:])
    a, b = np.divmod(np.arange(m * n), n)
    lo, hi = np.minimum(ids[a], ids[m + b]), np.maximum(ids[a], ids[m + b])
    kept = density.kruskal(lo, hi, d.ravel())
    assert sorted(zip(np.minimum(ids[i], ids[m + j]), np.maximum(ids[i], ids[m + j]), w)) == sorted(zip(lo[kept], hi[kept], d.ravel()[kept]))


@pytest.mark.parametrize("k", [1, 3, 6, 40])
def test_core_distances_by_products(spark, monkeypatch, k):
    monkeypatch.setattr(density, "SIDE", 16)
    x = blobs(150, 7, copies=20)
    pts = frame(spark, x).selectExpr("id", "embedding as v", "cast(id * id % 3 as int) as _g")  # groups of 50, 100 and none
    core = dict(density.core_distances(pts, 3, k).select("id", "core").collect())
    want = np.sort(density.distances(x, x), axis=1)[:, k - 1]
    assert np.allclose([core[i] for i in range(150)], want, atol=1e-9)


def test_a_cell_holds_small_products_only():
    x = np.random.default_rng(3).normal(size=(6000, 8))
    ids, g = np.arange(6000), (np.arange(6000) % 2).astype(np.int32)
    calls = []

    class Cells:
        def applyInArrow(self, f, schema):
            calls.append(f)
            raise StopIteration

    for make in (lambda: density.core_distances(None, 2, 2), lambda: density.cell_edges(None, 2)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(density, "_cells", lambda points, groups: Cells())
            with pytest.raises(StopIteration):
                make()
    v = pa.array(x.tolist(), pa.list_(pa.float64()))
    t = pa.table({"id": ids, "v": v, "core": np.zeros(6000), "_g": g})
    for f in calls:
        tracemalloc.start()
        f((pa.scalar(0), pa.scalar(1)), t)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 4.5 * 8 * density.SIDE**2  # some four matrices of a product


def test_cells_are_tasks_of_their_own(spark):
    points = spark.range(400).selectExpr("id", "array(cast(id as double)) as v", "cast(id % 8 as int) as _g")
    rows = density._cells(points, 8).applyInArrow(lambda t: t.slice(0, 1).select(["_a"]), "_a int")
    assert rows.rdd.getNumPartitions() == 72  # put together by bytes, it would be one


@pytest.mark.parametrize("n, copies, p", [(700, 0, Clustering(epsilon=0.0)), (500, 160, Clustering(epsilon=0.68, min_samples=4))])
def test_cells_give_what_one_task_gives(spark, monkeypatch, n, copies, p):
    monkeypatch.setattr(density, "SIDE", 64)
    x = blobs(n, n + copies, copies=copies)
    want = clustering.labels_of(x, p)
    got = density.fit(frame(spark, x).withColumnRenamed("embedding", "v"), p, group=150, batch=130 if copies else 1 << 18)
    labels = np.full(n, -1)
    for r in got.collect():
        labels[r.id] = r.cluster_id
    assert (labels == want).all() and len(set(want)) > 3


def test_noise_alone_and_odd_rows(spark):
    x = np.stack([1.3 ** np.arange(40), np.zeros(40)], 1)  # gaps that only grow: no two clusters ever meet
    p = Clustering()
    assert (clustering.labels_of(x, p) == -1).all()
    assert (labelled(clustering.fit(frame(spark, x), p, limit=10)) == -1).all()
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [None, 1.0])], "id long, embedding array<double>")
    assert (labelled(clustering.fit(rows, p)) == -1).all() and clustering.fit(rows, p).count() == 42


def test_floats_are_clustered_as_doubles(spark):
    x = blobs(300, 11).astype(np.float32)
    rows = frame(spark, x.astype(float)).selectExpr("id", "cast(embedding as array<float>) as embedding")
    want = clustering.labels_of(x.astype(float))
    assert (labelled(clustering.fit(rows, limit=10)) == want).all() and (labelled(clustering.fit(rows)) == want).all() and want.max() > 1


def test_few_pairs_are_measured_in_64_bits(monkeypatch):
    x = np.random.default_rng(5).normal(size=(8000, 16))
    x[-30:] = x[-31]
    made, measured = [], []

    class Cells:
        def applyInArrow(self, f, schema):
            made.append(f)
            raise StopIteration

    monkeypatch.setattr(density, "_cells", lambda points, groups: Cells())
    with pytest.raises(StopIteration):
        density.core_distances(None, 2, 6)
    for name in ("squares", "squares_of"):
        if f := getattr(density, name, None):
            monkeypatch.setattr(density, name, lambda *a, f=f: (measured.append(f(*a)), measured[-1])[1])
    t = pa.table({"id": np.arange(8000), "v": pa.array(x.tolist(), pa.list_(pa.float64())), "_g": (np.arange(8000) % 2).astype(np.int32)})
    near = made[0]((pa.scalar(0), pa.scalar(1)), t).sort_by("id").column("near").to_pylist()
    assert sum(m.size for m in measured) < 4000 * 4000 / 20  # all of them, before
    for i in (0, 1, 4001, 7969, 7990):
        others = np.flatnonzero(np.arange(8000) % 2 != i % 2)
        d = density.distances(x[i : i + 1], x[others])[0]
        order = np.lexsort((others, d))[:5]
        assert [n["id"] for n in near[i]] == others[order].tolist() and np.allclose([n["d"] for n in near[i]], d[order], rtol=1e-8)


@pytest.mark.parametrize("scale", [1.0, 1e-12, 1e150])
def test_floors_are_below(scale):
    x = np.random.default_rng(6).normal(size=(300, 40)) * scale * 10.0 ** -np.arange(300)[:, None].clip(0, 20)
    x[100:200] = x[50] * (1 + np.random.default_rng(7).normal(size=(100, 1)) * 1e-7)
    floors, every = density.Floors(x), np.arange(300)
    low, square = floors.between(every, every), density.squares(x, x)
    for k in (0, 3, 299):
        limits = np.sort(square, axis=1)[:, k]
        assert (low <= floors.limits(limits)[:, None])[square <= limits[:, None]].all()
    for axis in (0, 1):
        limits = floors.first_limits(low, every, every, 4, axis)
        within = low <= (limits[:, None] if axis else limits)
        assert within[square <= np.sort(square, axis=1)[:, 3][:, None] if axis else (square <= np.sort(square, axis=0)[3])].all()


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("first", [3, 7])
def test_lightest_edges_of_components(ties, first):
    rng = np.random.default_rng(8)
    rows, columns = np.sort(rng.integers(0, 8, 50)), np.sort(rng.integers(first, 9, 37))
    ids = rng.permutation(500)[:87]
    left, right = (i[np.lexsort((i, c))] for i, c in ((ids[:50], rows), (ids[50:], columns)))
    d = rng.integers(1, 4, (50, 37)).astype(float) if ties else rng.random((50, 37))
    want: dict = {}
    for i in range(50):
        for j in range(37):
            if rows[i] != columns[j]:
                e = d[i, j], min(left[i], right[j]), max(left[i], right[j])
                want[rows[i], columns[j]] = min(e, want.get((rows[i], columns[j]), e))
    i, j, w = density.lightest(d, left, right, rows, columns)
    got = {(rows[a], columns[b]): (v, min(left[a], right[b]), max(left[a], right[b])) for a, b, v in zip(i, j, w)}
    assert got == want and len(i) == len(want)


def test_open_points_only_meet_again(spark, monkeypatch):
    """Points that near points join surely aren't compared with all others for edges; those of groups apart are, and give the labels of one task."""
    rng, seen, edges = np.random.default_rng(9), [], density.cell_edges
    x = rng.normal(size=(700, 12)) * 4
    x[600:660] = x[600] + rng.normal(size=(60, 12)) * 0.01
    x[660:] = x[660]
    monkeypatch.setattr(density, "cell_edges", lambda points, groups: (seen.append(points.count()), edges(points, groups))[1])
    p = Clustering(epsilon=0.0)
    want = clustering.labels_of(x, p)
    labels = np.full(700, -1)
    for r in density.fit(frame(spark, x).withColumnRenamed("embedding", "v"), p, group=300).collect():
        labels[r.id] = r.cluster_id
    assert (labels == want).all() and want.max() >= 1 and sum(seen) < 350  # all 700, before


def test_groups_apart(spark):
    rng = np.random.default_rng(10)
    x = np.repeat(rng.normal(size=(25, 4)) * 100, 24, axis=0) + rng.normal(size=(600, 4))
    p = Clustering(epsilon=0.0, min_samples=3)
    want = clustering.labels_of(x, p)
    labels = np.full(600, -1)
    for r in density.fit(frame(spark, x).withColumnRenamed("embedding", "v"), p, group=200).collect():
        labels[r.id] = r.cluster_id
    assert (labels == want).all() and want.max() > 20
