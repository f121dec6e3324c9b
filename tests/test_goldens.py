"""Literal cases of FIXTURES.md."""

import pytest
from pyspark.sql import functions as F

from lumenreel.functions import numbers as N
from lumenreel.functions import paths as P
from lumenreel.functions import text as T
from lumenreel.operators import clustering, energy, library, sessions, state, tagging, timeline, vectors
from lumenreel.params import Clustering, Energy, Tagging


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def long(spark, m):
    return spark.createDataFrame([(v, t, float(x)) for v, r in enumerate(m) for t, x in enumerate(r)], "video_id int, tag int, score double")


def kept(df):
    return {(r[0], r[1]) for r in df.select("video_id", "tag").collect()}


def test_relative_keep(spark):
    m = [[0.25, 0.13, 0.10], [0.10, 0.14, 0.19], [0.16, 0.15, 0.16], [0.11, 0.16, 0.12]]
    assert kept(tagging.relative_keep(long(spark, m), Tagging(k_tag=1.0))) == {(0, 0), (1, 2), (3, 1)}
    assert kept(tagging.relative_keep(long(spark, [[0.08] * 3] * 5))) == set()
    assert kept(tagging.relative_keep(long(spark, [[0.25, 0.05], [0.10, 0.20]]), Tagging(floor=0.15))) == {(0, 0), (1, 1)}
    strong = kept(tagging.relative_keep(long(spark, [[0.30, 0.10], [0.25, 0.11], [0.25, 0.30], [0.24, 0.10]]), Tagging(k_tag=1.0)))
    assert (0, 0) in strong and len([x for x in strong if x[1] == 0]) < 4
    cap = Tagging(floor=0.1, strong=0.99, k_tag=0.0, clip_margin=-1.0, max_coverage=0.5)
    got = kept(tagging.relative_keep(long(spark, [[0.10], [0.10], [0.25], [0.26], [0.27], [0.28], [0.29], [0.30]]), cap))
    assert len(got) == 4 and {(6, 0), (7, 0)} <= got and not {(2, 0), (3, 0)} & got


def test_enrich_and_energy_levels(spark):
    assert list(one(spark, *[T.enrich(F.lit(x)) for x in ("pool", "Pool", "wedding", "baby", "kayaking")])) == ["a swimming pool", "a swimming pool", "a wedding ceremony", "a baby", "kayaking"]
    assert list(one(spark, *[N.bucket(F.lit(x)) for x in (0.9, 0.52, 0.0, 0.24, 0.38)])) == ["high", "high", "low", "low", "medium"]
    assert list(one(spark, *[N.audio_level(F.lit(x)) for x in (-55.0, -14.0, -200.0, 0.0)])) == [0, 1, 0, 1]
    a, b, c, d, e = one(spark, *[N.motion_level(F.lit(x)) for x in (0.0, 0.5, 4.0, 36.0, 999.0)])
    assert (a, b, d, e) == (0, 0, 1, 1) and 0 < c < 1


def levels(spark, xs):
    return spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(xs)], "video_id int, sec int, level double")


def test_peaks(spark):
    xs = [0.1, 0.6, 0.2, 0.55, 0.2, 0.7, 0.1]
    assert energy.peaks(levels(spark, xs)).first()["peaks"] == [5.0]
    assert energy.peaks(levels(spark, [0.1, 0.2, 0.3, 0.1])).first() is None
    assert energy.peaks(levels(spark, xs), p=Energy(peak_max=3)).first()["peaks"] == [1.0, 5.0]


def test_appearances(spark):
    rows = [("Ellie", float(t)) for t in [*range(20), *range(50, 60)]] + [("Mo", 1.0)]
    got = sessions.appearances(spark.createDataFrame(rows, "name string, timestamp_sec double"), ["name"]).collect()
    assert sorted(map(tuple, got)) == [("Ellie", 0.0), ("Ellie", 50.0), ("Mo", 1.0)]


def test_scope(spark):
    paths = ["/Users/x/Footage/May/a", "/Users/x/Footage/May/sub/b", "/Users/x/Footage/April/c", "/Users/x/Footage/MayOld/d"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    root = "/Users/x/Footage/May"
    assert {r[0] for r in df.where(P.under(F.col("path"), [root])).collect()} == set(paths[:2])
    assert {r[0] for r in P.in_scope(df, spark.createDataFrame([(root + "/",)], "root string")).collect()} == set(paths[:2])
    assert df.where(P.under(F.col("path"), None)).count() == 4 and df.where(P.under(F.col("path"), [])).count() == 0
    assert P.resolve_scope(["a"], True, ["b"], "c") == ["a"] and P.resolve_scope(None, True, ["b"], "c") is None
    assert P.resolve_scope(None, False, ["b"], "c") == ["b"] and P.resolve_scope(None, False, None, "c") == ["c"] and P.resolve_scope(None, False, None, None) is None


def test_merge_people(spark):
    faces = spark.createDataFrame([(i, 1 if i < 5 else 2) for i in range(7)], "id int, cluster_id int")
    people = spark.createDataFrame([(1, "Grayson"), (2, "grayson")], "cluster_id int, name string")
    f, p = library.merge_people(faces, people)
    assert [tuple(r) for r in p.collect()] == [(1, "Grayson")] and f.where("cluster_id = 1").count() == 7
    assert library.merge_map(f, p).count() == 0
    assert [r[0] for r in library.known_names(spark.createDataFrame([(1, "Grayson"), (2, "grayson"), (3, "")], "cluster_id int, name string")).collect()] == ["Grayson"]


def rate(spark, *rates):
    rows = [(i, n, d, k, f"p{i}") for i, (n, d, k) in enumerate(rates)]
    return tuple(timeline.timeline_rate(spark.createDataFrame(rows, "i int, num int, den int, clips long, first_path string")).first())


@pytest.mark.parametrize("rates,want", [
    ([(1, 30, 2), (1, 60, 1)], (1, 60)), ([(1001, 30000, 1), (1001, 60000, 2)], (1001, 60000)), ([(1, 25, 1), (1, 50, 1)], (1, 50)), ([(1001, 60000, 4)], (1001, 60000)),
    ([(1, 30, 2), (1001, 60000, 1)], (1, 30)), ([(1, 24, 3), (1, 30, 1), (1, 60, 1)], (1, 120)), ([(1, 24, 2), (1, 30, 1)], (1, 120)), ([(1001, 24000, 1), (1001, 30000, 1), (1001, 60000, 1)], (1001, 120000)),
])
def test_timeline_rate(spark, rates, want):
    assert rate(spark, *rates) == want


def test_timecode(spark):
    fps = 60000 / 1001
    a, b, c = one(spark, N.timecode_seconds(F.lit("01:17:36;36"), F.lit(fps)), N.timecode_seconds(F.lit("01:00:00:00"), F.lit(30.0)), N.timecode_seconds(F.lit("19:22:57;14"), F.lit(30000 / 1001)))
    assert round(a * fps) == ((1 * 60 + 17) * 60 + 36) * 60 + 36 - 4 * (77 - 7) and b == 3600.0
    assert round(c * fps) == 4_182_464
    assert one(spark, N.rational(N.frame(F.lit(c), F.lit(1001), F.lit(60000)), F.lit(1001), F.lit(60000)))[0] == "4186646464/60000s"


def test_layout_and_exports(spark):
    clips = spark.createDataFrame([(x, 59.94, 10.01) for x in "abc"], "path string, fps double, duration double")
    none = spark.createDataFrame([], "path string, t double, label string")
    r = timeline.timeline_rate(timeline.clip_rates(clips))
    lay = timeline.layout(clips, none, r)
    assert [(x["offset_frames"], x["dur_frames"]) for x in lay.orderBy("path").collect()] == [(0, 600), (600, 600), (1200, 600)]
    spf = 1001 / 60000
    assert list(one(spark, *[N.frames_needed(F.lit(767 * spf + e), F.lit(1001), F.lit(60000)) for e in (0.0, 1e-7, -1e-7)])) == [767] * 3
    two = spark.createDataFrame([("/m/a.mov", 30.0, 0.0), ("/m/b.mov", 30.0, 0.0)], "path string, fps double, duration double")
    marks = spark.createDataFrame([("/m/a.mov", 1.0, "Ellie"), ("/m/b.mov", 1.0, "Energy peak")], "path string, t double, label string")
    lay = timeline.layout(two, marks, timeline.timeline_rate(timeline.clip_rates(two)))
    rows = timeline.edl_rows(lay, marks).orderBy("n").collect()
    assert [(x["tc_in"], x["color"]) for x in rows] == [("00:00:01:00", "Blue"), ("00:00:03:00", "Yellow")]
    assert timeline.edl(lay, marks.where("false")).first() is None
    evil = marks.withColumn("label", F.lit("Mom |D:9 |M:evil"))
    text = timeline.edl(lay, evil).first()[0]
    assert text.count("|M:") == 2 and text.count("|D:") == 2
    starts = spark.createDataFrame([("/m/a.mov", 3600.0)], "path string, start_sec double")
    xml = timeline.fcpxml(lay, marks.withColumn("label", F.lit('Mom & Dad <"x">')), starts).first()[0]
    assert 'start="108000/30s"' in xml and 'marker start="108030/30s"' in xml and "Mom &amp; Dad &lt;&quot;x&quot;&gt;" in xml


def test_tags_and_pairs(spark):
    tags = spark.createDataFrame([(1, "beach", 0.4), (1, "wedding", 0.4), (2, "Wedding", 0.4)], "video_id int, tag string, score double")
    videos = spark.createDataFrame([(1, "/a"), (2, "/b")], "id int, path string")
    assert tags.count() - state.delete_tags(tags, spark.createDataFrame([("Wedding",), (" ",)], "tag string")).count() == 2
    left = state.delete_pairs(tags, videos, spark.createDataFrame([("/b", "WEDDING"), ("/a", ""), ("/c", "beach")], "path string, tag string"))
    assert kept(left) == {(1, "beach"), (1, "wedding")}
    v = spark.createDataFrame([("/a", ["Beach", "kids"]), ("/b", ["kids", "dog"])], "path string, batch_tags array<string>")
    assert sorted(r[0] for r in library.vocabulary(v).collect()) == ["beach", "dog", "kids"]


def test_expired_backups(spark):
    names = ["b-1000000000", "b-999999999", "b-5", "b-x", "c-1"]
    assert {r["name"] for r in state.expired(spark.createDataFrame([(n,) for n in names], "name string")).collect()} == {"b-x"}


def test_snapshots(spark, tmp_path):
    store = state.SnapshotStore(spark, f"file://{tmp_path}/s")
    assert store.read("t") is None
    for i in range(5):
        store.commit("t", spark.range(i + 1))
    assert store.read("t").count() == 5 and len(store.versions("t")) == 3


def test_vectors(spark):
    frames = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (1, [0.0, 3.0, 0.0])], "video_id int, embedding array<double>")
    prompts = spark.createDataFrame([("a", [0.0, 1.0, 0.0]), ("b", [0.0, 0.0, 1.0])], "tag string, prompt array<double>")
    got = {r["tag"]: r["score"] for r in vectors.frame_scores(frames, prompts).collect()}
    assert got["a"] == pytest.approx(1.0) and got["b"] < 0.99
    v = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>")
    assert [r[0] for r in v.select(vectors.from_f32(vectors.to_f32("v"))).collect()] == [[1.5, -2.0], None]


def test_clusters_and_naive_distances():
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.05, (20, 8)), rng.normal(3, 0.05, (20, 8)), rng.normal(9, 4, (4, 8))])
    y = clustering.labels_of(x, Clustering(epsilon=0.68))
    assert len(set(y[:20])) == 1 and len(set(y[20:40])) == 1 and y[0] != y[20] and (y[40:] == -1).all()
    assert clustering.labels_of(x[:3]).tolist() == [0, 0, 0]


def test_nearest_is_naive(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    p, c = rng.normal(size=(60, 16)), rng.normal(size=(9, 16))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(p)], "id long, embedding array<double>")
    cents = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cluster_id int, centroid array<double>")
    want = np.linalg.norm(p[:, None] - c, axis=2).argmin(1).tolist()
    for f in (vectors.nearest, lambda a, b: vectors.nearest_blocks(a, b, block=4), lambda a, b: vectors.nearest(a, b, most=8)):
        assert [r["cluster_id"] for r in f(points, cents).orderBy("id").collect()] == want


def test_vectors_of_any_shape(spark):
    frames = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 2.0]), (2, None), (2, []), (2, [1.0, None]), (3, [1.0, 1.0, 1.0]), (None, [1.0, 0.0])], "video_id int, embedding array<double>")
    prompts = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [2.0, 0.0]), ("c", [1.0, 1.0, 1.0])], "tag string, prompt array<double>")
    want = {(1, "a"): 1.0, (1, "b"): 1.0, (3, "c"): 1.0, (None, "a"): 0.0, (None, "b"): 1.0}
    for most in (vectors.BROADCAST_COMPONENTS, 2):
        got = {(r["video_id"], r["tag"]): r["score"] for r in vectors.frame_scores(frames.where("not exists(embedding, x -> x is null) or embedding is null"), prompts, most).collect()}
        assert got == pytest.approx(want)
    assert vectors.frame_scores(frames, prompts).where("video_id = 2").count() == 0
    assert vectors.frame_scores(frames.where("false"), prompts).count() == 0 and vectors.frame_scores(frames, prompts.where("false")).count() == 0
    cents = spark.createDataFrame([(7, [0.0, 0.0]), (3, [2.0, 0.0]), (9, [1.0, 1.0, 1.0])], "cluster_id int, centroid array<double>")
    points = frames.withColumnRenamed("video_id", "id").where("id is not null")
    for f in (vectors.nearest, vectors.nearest_blocks):
        got = {tuple(r) for r in f(points.where("id != 2"), cents).collect()}
        assert got == {(1, 3, 1.0), (3, 9, 0.0)}  # a tie


def test_codecs(spark):
    v = spark.createDataFrame([([1.5, -2.0, 65504.0],), (None,), ([],)], "v array<float>")
    assert [r[0] for r in v.select(vectors.from_f16(vectors.to_f16("v"))).collect()] == [[1.5, -2.0, 65504.0], None, []]


def test_best_share_is_the_plain_ranking(spark):
    import random

    rng = random.Random(5)
    rows = [(v, t, round(rng.random(), rng.choice([1, 2, 5]))) for v in range(60) for t in range(6) if rng.random() < 0.8]
    for share in (0.05, 0.3, 0.5, 1.0):
        want = {(v, t) for t in range(6) for v, _, _ in sorted((r for r in rows if r[1] == t), key=lambda r: (-r[2], r[0]))[: max(1, int(60 * share))]}
        df = spark.createDataFrame([(*r, 60) for r in rows], "video_id int, tag int, score double, n long")
        for bins in (4096, 3):
            assert kept(tagging._best_share(df, share, bins)) == want


def test_scope_labels_and_folders():
    assert P.scope_label(None) == "everything" and P.scope_label(["/x/May/"]) == "May"
    assert P.scope_label(["/x/May/a.mov", "/x/May/b.mov"]) == "2 clip(s) in May" and P.scope_label(["/x/a", "/y/b"]) == "2 item(s)"
    assert P.export_folder([("/x/May", True)]) == "/x/May" and P.export_folder([("/x/May/a.mov", False), ("/x/April/b.mov", False)]) == "/x"
    assert P.export_folder([("/a/x.mov", False), ("/b/y.mov", False)]) == "/a" and P.export_folder([]) is None


def test_json_columns(spark):
    got = one(spark, T.json_roots(F.lit('["/a","/b"]')), T.json_peaks(F.lit("[1, 2.5]")), T.json_peaks(F.lit("{oops")), T.rejections(F.lit('[["/a","dog"]]')), T.rejections(F.lit("oops")), T.html(F.lit("<a href='x'>&")))
    assert list(got) == [["/a", "/b"], [1.0, 2.5], [], [["/a", "dog"]], None, "&lt;a href=&#39;x&#39;&gt;&amp;"]


def test_numbers_in_order(spark):
    from lumenreel.storage import in_order

    df = spark.createDataFrame([(f"p{i:03d}", i) for i in range(200)], "path string, n long").repartition(7)
    for most in (1 << 16, 0):
        got = in_order(df, ["path"], "n", one_task=most).orderBy("path").collect()
        assert [(r["_n"], r["_before"]) for r in got] == [(i + 1, i * (i - 1) // 2) for i in range(200)]
        assert in_order(df.where("false"), ["path"], "n", one_task=most).count() == 0
