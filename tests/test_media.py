"""Listing, probes' answers and sinks, without media tools."""

import json

from pyspark.sql import functions as F

from lumenreel.sources import media, sinks


def answers(spark, *streams):
    rows = [(f"/{i}.mov", json.dumps({"streams": s, "format": {"duration": "12.5"}})) for i, s in enumerate(streams)]
    return spark.createDataFrame(rows, "path string, json string")


def test_walk(spark, tmp_path):
    for n in ("a.MOV", "sub/b.mp4", "c.txt", "d.r3d"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(b"x")
    assert [r[0].rsplit("/", 1)[1] for r in media.walk(spark, str(tmp_path)).orderBy("path").collect()] == ["a.MOV", "b.mp4"]
    paths = spark.createDataFrame([("/x/d.R3D",), ("/x/a.mov",)], "path string")
    assert [r[0] for r in media.camera_raw(paths).collect()] == [".r3d"]


def test_not_downloaded(spark):
    stats = spark.createDataFrame([("/x/a", 5, 0, True), ("/x/b", None, None, False), ("/x/c", None, None, False), ("/x/d", 0, 0, True)], "path string, size long, blocks long, on_disk boolean")
    listing = spark.createDataFrame([("/x/.b.icloud",)], "path string")
    assert sorted(r[0] for r in media.not_downloaded(stats, listing).collect()) == ["/x/a", "/x/b"]


def test_probe(spark):
    v = {"codec_type": "video", "width": 1920, "height": 1080, "r_frame_rate": "60000/1001", "avg_frame_rate": "60000/1001", "nb_frames": "768"}
    a = answers(spark, [v | {"side_data_list": [{"rotation": -90}]}], [v | {"side_data_list": [{"rotation": 180}]}], [v | {"tags": {"rotate": "270"}, "nb_frames": "N/A", "duration": "12.8128"}], [v, {"codec_type": "data", "codec_tag_string": "tmcd", "r_frame_rate": "30000/1001", "tags": {"timecode": "19:22:57;14"}}])
    got = {r["path"]: r for r in media.probed(a).collect()}
    assert (got["/0.mov"]["width"], got["/0.mov"]["height"]) == (1080, 1920) and got["/1.mov"]["width"] == 1920 and got["/2.mov"]["width"] == 1080
    assert round(got["/0.mov"]["picture_sec"] * 60000 / 1001) == 768 and got["/2.mov"]["picture_sec"] == 12.8128
    c = media.timeline_clips(media.probed(a)).where("path = '/3.mov'").first()
    assert round(c["start_sec"] * 60000 / 1001) == 4_182_464


def test_keywords_fail_closed(spark):
    a = spark.createDataFrame([("/a.mov", '[{"Subject":["x","old"],"Keywords":"y, x"}]', None), ("/b.mov", None, "boom"), ("/c.mkv", "[{}]", None)], "path string, json string, error string")
    read = media.keywords_read(a)
    want = spark.createDataFrame([(p, ["new"]) for p in ("/a.mov", "/b.mov", "/c.mkv")], "path string, keywords array<string>")
    ours = spark.createDataFrame([("/a.mov", ["old"])], "path string, keywords array<string>")
    got = {r["path"]: (r["action"], r["keywords"]) for r in sinks.keyword_plan(want, read, ours).collect()}
    assert got["/a.mov"] == ("write", ["new", "x", "y"]) and got["/b.mov"][0] == "failed" and got["/c.mkv"][0] == "unwritable"


def test_marker_structs_and_lines(spark):
    df = spark.createDataFrame([("{Name=a,StartTime=1},{StartTime=2},{Name=b}",)], "raw string")
    assert [m["Name"] for m in df.select(media.marker_structs(F.col("raw"))).first()[0]] == ["a", "b"]
    lines = spark.createDataFrame([('__EVENT__ {"n":3}',), ("noise",), ("__EVENT__ {bad",)], "value string")
    got = [r[0].n if r[0] else None for r in media.event_lines(lines, "n int").collect()]
    assert got == [3, None]
    back = media.event_lines(sinks.event_lines(spark.createDataFrame([(5,)], "n int")), "n int").first()[0]
    assert back.n == 5


def test_text_and_report(spark, tmp_path):
    out = f"{tmp_path}/x.edl"
    assert sinks.write_text(spark.createDataFrame([("one",)], "text string"), out) and open(out).read() == "one"
    assert sinks.write_text(spark.createDataFrame([("two",)], "text string"), out) and open(out).read() == "two"
    assert not sinks.write_text(spark.createDataFrame([], "text string"), f"{tmp_path}/none")
    empty = spark.createDataFrame([], "path string, file string, folder string, people string, tags string, energy string, peaks int, keywords string")
    sinks.write_report(empty, f"{tmp_path}/r.csv")
    assert open(f"{tmp_path}/r.csv").read().startswith("file,folder,")


def test_comment_and_tags(spark):
    r = spark.range(1).select(
        sinks.merged_comment(F.lit("mine\nKeywords: a, b"), F.array(F.lit("c"))), sinks.merged_tags(F.array(F.lit("Red\n6"), F.lit("old")), F.array(F.lit("old")), F.array(F.lit("new"), F.lit("Red")))
    ).first()
    assert r[0] == "mine\nKeywords: c" and r[1] == ["Red\n6", "new"]


def test_sound(spark):
    import numpy as np

    x = (np.sin(np.arange(40_000)) * 16384).astype("<i2").tobytes()
    got = media.sound_levels(spark.createDataFrame([("/a", bytearray(x))], "path string, samples binary")).collect()
    assert len(got) == 2 and abs(got[0]["db"] - 20 * np.log10(0.5 / 2**0.5)) < 0.1


PROBE = """#!{python}
import json, sys
path = sys.argv[-1]
if "broken" in path:
    sys.stderr.write("no such stream")
    sys.exit(1)
print(json.dumps({{"streams": [{{"codec_type": "video", "width": 8, "height": 4, "r_frame_rate": "30/1"}}], "format": {{"duration": "2.0"}}}}))
"""
DECODE = """#!{python}
import sys
out = sys.stdout.buffer
if "-vn" in sys.argv:
    out.write(bytes([0, 64]) * (16000 * 3))
else:
    depth = 1 if "gray" in sys.argv else 3
    for i in range(9):
        out.write(bytes([i]) * (8 * 4 * depth))
"""


def tools(folder):
    import sys

    for name, text in (("ffprobe", PROBE), ("ffmpeg", DECODE)):
        (folder / name).write_text(text.format(python=sys.executable))
        (folder / name).chmod(0o755)
    return str(folder)


def test_frames_by_a_stub_tool(spark, tmp_path):
    t = tools(tmp_path)
    got = media.pictures(spark, ["/a.mov", "/b.mov"], tools=t).orderBy("path", "frame").collect()
    # two seconds and one more, at a frame a second
    assert [(r["path"], r["frame"], r["t"]) for r in got] == [(p, i, float(i)) for p in ("/a.mov", "/b.mov") for i in range(4)]
    assert all((r["h"], r["w"], len(r["pixels"]), r["pixels"][0]) == (4, 8, 96, r["frame"]) for r in got)
    gray = media.pictures(spark, ["/a.mov"], fps=4.0, gray=True, tools=t).collect()
    assert len(gray) == 9 and {len(r["pixels"]) for r in gray} == {32}
    assert media.pictures(spark, []).count() == 0
    clips = spark.createDataFrame([("/a.mov", 2.0), ("/c.mov", 9.0)], "path string, duration double")
    short = {r["path"]: (r["got"], r["short"]) for r in media.quality(media.pictures(spark, ["/a.mov", "/b.mov"], tools=t), clips).collect()}
    assert short == {"/a.mov": (4, False), "/c.mov": (0, True)}
    pairs = media.next_frames(media.pictures(spark, ["/a.mov"], tools=t)).orderBy("t").collect()
    assert [(r["before"][0], r["pixels"][0]) for r in pairs] == [(0, 1), (1, 2), (2, 3)]


def test_probe_and_sound_by_a_stub_tool(spark, tmp_path):
    t = tools(tmp_path)
    paths = spark.createDataFrame([("/a.mov",), ("/broken.mov",)], "path string")
    got = {r["path"]: r for r in media.probe(paths, t).collect()}
    assert got["/broken.mov"]["json"] is None and "no such" in got["/broken.mov"]["error"] and json.loads(got["/a.mov"]["json"])["format"]["duration"] == "2.0"
    levels = media.sound_levels(media.pcm(paths.limit(1), tools=t)).orderBy("sec").collect()
    assert [r["sec"] for r in levels] == [0, 1, 2] and all(abs(r["db"] - 20 * __import__("math").log10(0.5)) < 0.01 for r in levels)


def test_stat(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"abc")
    got = {r["path"]: r for r in media.stat(spark.createDataFrame([(str(tmp_path / "a"),), ("/no/such",)], "path string")).collect()}
    assert got[str(tmp_path / "a")]["size"] == 3 and got[str(tmp_path / "a")]["on_disk"] and not got["/no/such"]["on_disk"]


def test_models_of_the_caller(spark, tmp_path):
    import numpy as np

    frames = media.pictures(spark, ["/a.mov"], tools=tools(tmp_path))

    def faces():
        return lambda x: [(1, 2, 0, 3, 0.9, [3.0, 4.0]), (0, 0, 5, 5, 0.4, [1.0, 0.0])]

    got = media.detect(frames, faces).collect()
    assert len(got) == 4 and all((r["w"], r["h"]) == (1, 3) and np.allclose(r["embedding"], [0.6, 0.8]) for r in got)

    def images():
        return lambda xs: [[float(x.mean()) + 1.0, 0.0] for x in xs]

    clips = spark.createDataFrame([(1, "/a.mov"), (2, "/b.mov")], "id int, path string")
    had = spark.createDataFrame([(2, 0.0, [1.0, 0.0])], "video_id int, t double, embedding array<float>")

    def frames_of(c):
        t = str(tmp_path)
        return media.pictures(spark, [r["path"] for r in c.collect()], tools=t).join(c, "path")

    after = media.backfill(clips, had, frames_of, images)
    assert sorted((r["video_id"], tuple(r["embedding"])) for r in after.collect()) == [(1, (1.0, 0.0))] * 4 + [(2, (1.0, 0.0))]

    def texts():
        return lambda xs: [[float("beach" in x), 1.0] for x in xs]

    prompts = {r["tag"]: r["prompt"] for r in media.encode_texts(spark.createDataFrame([("beach",), ("dog",)], "tag string"), texts).collect()}
    assert np.allclose(prompts["beach"], [0.5**0.5, 0.5**0.5]) and np.allclose(prompts["dog"], [0.0, 1.0])


def test_token_ids(spark):
    from lumenreel.functions import text as T

    def encode():
        return lambda t: [10 + len(w) for w in t.split()]

    df = spark.createDataFrame([("  A  dog\n",), (None,), ("x " * 100,)], "t string").select(T.token_ids(F.col("t"), encode, 1, 2, 8).alias("i"))
    assert [r[0] for r in df.collect()] == [[1, 11, 13, 2, 0, 0, 0, 0], [1, 2, 0, 0, 0, 0, 0, 0], [1, 11, 11, 11, 11, 11, 11, 2]]


def test_writers_and_sidecars(spark, tmp_path):
    plan = spark.createDataFrame([("/a.mov", ["x", "y"]), ("/b.mov", [])], "path string, keywords array<string>")
    got = {r["path"]: r["a"] for r in plan.select("path", sinks.keyword_arguments(F.col("keywords")).alias("a")).collect()}
    assert got["/a.mov"] == ["-XMP-dc:Subject=x, y", "-Keys:Keywords=x,y"]
    ran = {r["path"]: (r["failed"], r["error"]) for r in sinks.run_tool(plan, lambda row: "boom" if row["path"] == "/b.mov" else None).collect()}
    assert ran == {"/a.mov": (False, None), "/b.mov": (True, "boom")}
    marks = spark.createDataFrame([("/m/a.mov", 1.5, "A & B"), ("/m/a.mov", 0.25, "C")], "path string, t double, label string")
    row = sinks.sidecar(marks).first()
    assert row["path"] == "/m/a.xmp" and row["text"].index(">250<") < row["text"].index(">1500<") and "A &amp; B" in row["text"]
    own = spark.createDataFrame([(row["text"],), ("<x/>",)], "t string").select(sinks.own_sidecar(F.col("t"))).collect()
    assert [r[0] for r in own] == [True, False]
    kept = sinks.stale_exports(spark.createDataFrame([("/k/m.edl",), ("/o/m.edl",), ("/o/mine.txt",)], "path string"), ["/k"], ["m.edl"])
    assert [r[0] for r in kept.collect()] == ["/o/m.edl"]
