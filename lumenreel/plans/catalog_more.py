"""Queries over energy, vectors, timelines, text and state; registered with catalog."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bpe
from ..functions import numbers as N
from ..functions import paths as P
from ..functions import text as T
from ..operators import clustering, energy, library, state, tagging, timeline, vectors
from ..params import Clustering, Energy, Tagging, Timeline
from ..storage import scratch
from ..streaming import streams
from . import adapter as A
from .catalog import _SQL, _query, _STRIP, _with

# energy: clicks and views are loudness, purchases motion, an hour is a second ------------------------------------------


def _audio(s, d):
    e = A.faces(s, d).where("cluster_id in (0, 1)")
    return e.groupBy("video_id", F.floor(F.col("timestamp_sec") / 3600).cast("int").alias("sec")).agg((F.max("value") * 0.3 - 55.0).alias("db"))


def _motion(s, d):
    return A.faces(s, d).where("cluster_id = 2").select("video_id", (F.col("timestamp_sec") / 3600).alias("t"), (F.col("value") / 5).alias("px"))


def _levels(s, d):
    return energy.grid(_audio(s, d), _motion(s, d))


_GRID = """, au AS (SELECT video_id, CAST(floor(timestamp_sec / 3600) AS INTEGER) AS sec, greatest(least((max(value) * 0.3 - 55.0 + 55.0) / 41.0, 1.0), 0.0) AS a FROM faces WHERE cluster_id IN (0, 1) GROUP BY ALL),
mo AS (SELECT video_id, CAST(floor(timestamp_sec / 3600) AS INTEGER) AS sec, max(greatest(least((sqrt(greatest(value / 5, 0.0)) - sqrt(0.5)) / (sqrt(36.0) - sqrt(0.5)), 1.0), 0.0)) AS m, max(ceil(timestamp_sec / 3600)) + 1 AS n FROM faces WHERE cluster_id = 2 GROUP BY ALL),
ns AS (SELECT video_id, CAST(max(n) AS INTEGER) AS n FROM (SELECT video_id, sec + 1 AS n FROM au UNION ALL SELECT video_id, n FROM mo) GROUP BY video_id),
gr AS (SELECT ns.video_id, CAST(g.sec AS INTEGER) AS sec, coalesce(a, 0.0) AS a, coalesce(m, 0.0) AS m, 1.0 - (1.0 - coalesce(a, 0.0)) * (1.0 - coalesce(m, 0.0)) AS level FROM ns, LATERAL (SELECT unnest(range(ns.n)) AS sec) g LEFT JOIN au ON au.video_id = ns.video_id AND au.sec = g.sec LEFT JOIN mo ON mo.video_id = ns.video_id AND mo.sec = g.sec)"""
_SCORE = ", sc AS (SELECT video_id, avg(level) AS score FROM (SELECT video_id, level, row_number() OVER (PARTITION BY video_id ORDER BY level DESC, sec) AS r, count(*) OVER (PARTITION BY video_id) AS c FROM gr) WHERE r <= greatest(1, round_even(c * 0.3, 0)) GROUP BY video_id)"


@_query(None)
def energy_grid(s, d):
    g = _levels(s, d)
    return g.groupBy("video_id").agg(F.count("*").alias("n"), F.count_if(F.col("level") > 0).alias("filled"), F.round(F.sum("level"), 6).alias("total"), F.max("sec").cast("bigint").alias("last"))


_SQL["energy_grid"] = _with(_GRID, "SELECT video_id, count(*) AS n, count(*) FILTER (level > 0) AS filled, round(sum(level), 6) AS total, CAST(max(sec) AS BIGINT) AS last FROM gr GROUP BY video_id", "faces")


@_query(None)
def energy_score(s, d):
    return energy.score(_levels(s, d)).select("video_id", F.round("score", 6).alias("score"), "bucket")


_SQL["energy_score"] = _with(_GRID + _SCORE, "SELECT video_id, round(score, 6) AS score, CASE WHEN score >= 0.52 THEN 'high' WHEN score <= 0.24 THEN 'low' ELSE 'medium' END AS bucket FROM sc", "faces")


@_query(None)
def energy_buckets(s, d):
    p = Energy(high=0.13, low=0.12)
    return energy.score(_levels(s, d), p=p).groupBy("bucket").agg(F.count("*").alias("clips"))


_SQL["energy_buckets"] = _with(_GRID + _SCORE, "SELECT CASE WHEN score >= 0.13 THEN 'high' WHEN score <= 0.12 THEN 'low' ELSE 'medium' END AS bucket, count(*) AS clips FROM sc GROUP BY 1", "faces")


@_query(None)
def energy_peaks(s, d):
    return energy.peaks(_levels(s, d)).select("video_id", F.element_at("peaks", 1).alias("peak"))


_SQL["energy_peaks"] = _with(_GRID, "SELECT video_id, CAST(sec AS DOUBLE) AS peak FROM (SELECT *, coalesce(lag(level) OVER w, level) AS l, coalesce(lead(level) OVER w, level) AS r FROM gr WINDOW w AS (PARTITION BY video_id ORDER BY sec)) WHERE level >= 0.5 AND level >= l AND level >= r QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY level DESC, sec) = 1", "faces")


@_query("SELECT user_id, avg(value) AS residual FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC) AS r, count(*) OVER (PARTITION BY user_id) AS c FROM events) WHERE r <= greatest(1, c // 4) GROUP BY user_id")
def motion_residual(s, d):
    return energy.upper_mean(A.table(s, d, "events"), "user_id", "value").withColumnRenamed("value", "residual").withColumn("residual", F.round("residual", 9))


_SQL["motion_residual"] = _SQL["motion_residual"].replace("avg(value) AS residual", "round(avg(value), 9) AS residual")


@_query("SELECT user_id, CAST(i // 8 AS INTEGER) AS sec, round(20 * log10(sqrt(avg(x * x) + 1e-12) + 1e-9), 6) AS db FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value / 1000 AS x FROM events) GROUP BY user_id, i // 8 HAVING count(*) = 8")
def audio_loudness(s, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = A.table(s, d, "events").select("user_id", (F.row_number().over(w) - 1).alias("i"), (F.col("value") / 1000).alias("x"))
    return energy.loudness(e, "user_id", 8).withColumn("db", F.round("db", 6))


# vectors ----------------------------------------------------------------------------------------------------------


@_query("SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS norm, round(e[1] / greatest(sqrt(list_sum(list_transform(e, lambda x: x * x))), 1e-8), 6) AS first FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)")
def l2_normalise(s, d):
    e = vectors.doubles(F.col("embedding"))
    return A.table(s, d, "embeddings").select("vec_id", F.round(vectors.norm(e), 6).alias("norm"), F.round(vectors.unit(e)[0], 6).alias("first"))


_UNIT = ", fu AS (SELECT video_id, vec_id, label, list_transform(embedding, lambda x: x / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y * y))), 1e-8)) AS u FROM frames)"
_ENS = _UNIT + ", me AS (SELECT label, i, avg(u[i]) AS x FROM fu, LATERAL (SELECT unnest(range(1, len(u) + 1)) AS i) GROUP BY label, i), pr AS (SELECT label, list(x / n ORDER BY i) AS p FROM (SELECT label, i, x, greatest(sqrt(sum(x * x) OVER (PARTITION BY label)), 1e-8) AS n FROM me) GROUP BY label)"
_FP = _ENS + ", fs AS (SELECT video_id, 'T' || CAST(pr.label AS VARCHAR) AS tag, max(list_inner_product(u, p)) AS score FROM fu, pr GROUP BY ALL)"


def _prompts(s, d):
    return vectors.ensemble(A.frames(s, d), ["label"], "embedding").select(F.concat(F.lit("T"), F.col("label").cast("string")).alias("tag"), F.col("embedding").alias("prompt"))


def _scores(s, d):
    return vectors.frame_scores(A.frames(s, d), _prompts(s, d))


@_query(None)
def prompt_ensemble(s, d):
    return vectors.ensemble(A.frames(s, d), ["label"], "embedding").select("label", F.posexplode("embedding").alias("i", "x")).select("label", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x"))


_SQL["prompt_ensemble"] = _with(_ENS, "SELECT label, CAST(i - 1 AS BIGINT) AS i, round(p[i], 6) AS x FROM pr, LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i)", "frames")


@_query(None)
def frame_prompt_max(s, d):
    return _scores(s, d).withColumn("score", F.round("score", 6))


_SQL["frame_prompt_max"] = _with(_FP, "SELECT video_id, tag, round(score, 6) AS score FROM fs", "frames")


def _rel(p: Tagging) -> str:
    return f""", st AS (SELECT tag, avg(score) + {p.k_tag} * stddev_pop(score) AS c FROM fs GROUP BY tag), cl AS (SELECT video_id, median(score) AS m FROM fs GROUP BY video_id),
kp AS (SELECT fs.* FROM fs JOIN st USING (tag) JOIN cl USING (video_id) WHERE score >= {p.floor} AND score >= c AND (score >= m + {p.clip_margin} OR score >= {p.strong}) QUALIFY row_number() OVER (PARTITION BY tag ORDER BY score DESC, video_id) <= greatest(1, floor((SELECT count(DISTINCT video_id) FROM fs) * {p.max_coverage})))"""


@_query(None)
def relative_keep(s, d):
    return tagging.relative_keep(_scores(s, d)).withColumn("score", F.round("score", 6))


_SQL["relative_keep"] = _with(_FP + _rel(Tagging()), "SELECT video_id, tag, round(score, 6) AS score FROM kp", "frames")

_LOW = Tagging(max_coverage=0.06, k_tag=0.5)


@_query(None)
def relative_keep_capped(s, d):
    return tagging.relative_keep(_scores(s, d), _LOW).withColumn("score", F.round("score", 6))


_SQL["relative_keep_capped"] = _with(_FP + _rel(_LOW), "SELECT video_id, tag, round(score, 6) AS score FROM kp", "frames")


@_query(None)
def absolute_keep(s, d):
    return tagging.absolute_keep(_scores(s, d)).withColumn("score", F.round("score", 6))


_SQL["absolute_keep"] = _with(_FP, "SELECT video_id, tag, round(score, 6) AS score FROM (SELECT *, median(score) OVER (PARTITION BY video_id) AS m FROM fs) WHERE score >= 0.13 AND score >= m + 0.01", "frames")


@_query(None)
def top_tags_per_clip(s, d):
    return tagging.top_per_clip(tagging.relative_keep(_scores(s, d))).select("video_id", "tag", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


_SQL["top_tags_per_clip"] = _with(_FP + _rel(Tagging()), "SELECT video_id, tag, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, tag) AS rank FROM kp) WHERE rank <= 3", "frames")


@_query("SELECT id AS video_id, tag, CAST(1.0 AS DOUBLE) AS score FROM videos, (VALUES ('beach'), ('dog')) t(tag)", "faces", "videos")
def degraded_tags(s, d):
    return tagging.every_tag(A.videos(s, d), s.createDataFrame([("beach",), ("dog",)], "tag string"))


def _vecs(s, d):
    e = A.table(s, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "embedding", F.when(F.col("vec_id") % 5 != 0, F.col("label")).alias("cluster_id"))


_CENT = "WITH x AS (SELECT label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 5 <> 0), c AS (SELECT label AS cluster_id, i, avg(e[i]) AS x FROM x, LATERAL (SELECT unnest(range(1, len(e) + 1)) AS i) GROUP BY ALL)"
_NEAR = _CENT + ", n AS (SELECT v.vec_id AS id, cluster_id, sqrt(sum((e[i] - x) * (e[i] - x))) AS distance FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 5 = 0) v, c GROUP BY ALL), b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(distance, 9), cluster_id) = 1)"
_MATCH = Clustering(match_threshold=0.984)


@_query(_CENT + " SELECT cluster_id, CAST(i - 1 AS BIGINT) AS i, round(x, 6) AS x FROM c")
def centroids(s, d):
    return clustering.centroids(_vecs(s, d)).select("cluster_id", F.posexplode("centroid").alias("i", "x")).select("cluster_id", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x"))


@_query(_NEAR + " SELECT id, cluster_id, round(distance, 6) AS distance FROM b")
def nearest_centroid(s, d):
    v = _vecs(s, d)
    return vectors.nearest(v.where("cluster_id is null"), clustering.centroids(v)).withColumn("distance", F.round("distance", 6))


@_query(_NEAR + " SELECT id, cluster_id, round(distance, 6) AS distance FROM b")
def nearest_centroid_blocks(s, d):
    v = _vecs(s, d)
    return vectors.nearest_blocks(v.where("cluster_id is null"), clustering.centroids(v), block=4).withColumn("distance", F.round("distance", 6))


@_query(_NEAR + " SELECT id, CASE WHEN distance < 0.984 THEN cluster_id END AS cluster_id, round(distance, 6) AS distance FROM b")
def incremental_match(s, d):
    return clustering.assign(_vecs(s, d), _MATCH).withColumn("distance", F.round("distance", 6))


@_query("SELECT vec_id AS id, CASE WHEN vec_id % 10 = 3 THEN CAST(-1 AS BIGINT) WHEN vec_id % 5 <> 0 THEN CAST(label AS BIGINT) END AS cluster_id FROM embeddings WHERE vec_id % 50 <> 7 UNION ALL SELECT vec_id + 1000000000, CAST(label AS BIGINT) FROM embeddings")
def changed_assignments(s, d):
    """A table of assignments, appended to, then changed and thinned out by folders of changes that are merged when it is read."""
    base = _vecs(s, d).select("id", F.col("cluster_id").cast("bigint").alias("cluster_id"))
    store = state.SnapshotStore(s, scratch(s, "changed-assignments"))
    store.commit("a", base, "id")
    store.apply("a", base.where("id % 10 = 3").withColumn("cluster_id", F.lit(5).cast("bigint")), "id")
    store.append("a", A.table(s, d, "embeddings").select((F.col("vec_id") + 1_000_000_000).alias("id"), F.col("label").cast("bigint").alias("cluster_id")), key="id")
    store.apply("a", base.where("id % 50 = 7 or id % 10 = 3").select("id", F.lit(-1).cast("bigint").alias("cluster_id"), (F.col("id") % 50 == 7).alias("_gone")), "id")
    return store.read("a")


@_query(None)
def hdbscan_labels(s, d):
    return clustering.fit(_vecs(s, d).select("id", "embedding"), Clustering(epsilon=0.0))


@_query(None)
def cluster_incremental(s, d):
    return clustering.incremental(_vecs(s, d), _MATCH)


# timeline ---------------------------------------------------------------------------------------------------------

_FPS = {0: 29.97, 1: 59.94, 2: 30000 / 1001, 3: 59.9}


def _clips(s, d):
    fps = F.create_map(*[F.lit(x) for kv in _FPS.items() for x in kv])
    return A.videos(s, d).select("path", F.element_at(fps, (F.col("id") % 4).cast("int")).alias("fps"), F.when(F.col("id") % 10 == 0, 0.0).otherwise(F.bround(F.col("duration_sec") / 100_000, 3)).alias("duration"))


def _markers(s, d):
    t = F.bround(F.col("timestamp_sec") / 90_000, 3)
    return A.faces(s, d).join(A.people(s, d), "cluster_id").join(A.videos(s, d).select(F.col("id").alias("video_id"), "path"), "video_id").select("path", t.alias("t"), F.col("name").alias("label")).distinct()


def _rate(s, d):
    return timeline.timeline_rate(timeline.clip_rates(_clips(s, d)))


def _lay(s, d):
    return timeline.layout(_clips(s, d), _markers(s, d), _rate(s, d))


_STANDARD = ", ".join(f"({r}, {n}, {d})" for r, n, d in Timeline().rates)
#: rt: the batch's rate by the rule; clip rates are the nearest standard ones.
_RATE = f""", sr AS (SELECT * FROM (VALUES {_STANDARD}) t(nominal, num, den)),
fr AS (SELECT path, CASE id % 4 WHEN 0 THEN 29.97 WHEN 1 THEN 59.94 WHEN 2 THEN CAST(30000 AS DOUBLE) / 1001 ELSE 59.9 END AS fps FROM videos),
nr AS (SELECT path, num, den FROM fr, sr QUALIFY row_number() OVER (PARTITION BY path ORDER BY abs(fps - nominal), nominal) = 1),
cr AS (SELECT num, den, count(*) AS clips, min(path) AS first_path FROM nr GROUP BY num, den),
cd AS (SELECT num, den, 1 AS tier, -CAST(den AS DOUBLE) / num AS o FROM cr UNION ALL SELECT num, den, 2, CAST(den AS DOUBLE) / num FROM sr),
ft AS (SELECT num, den, tier, o FROM (SELECT cd.*, (CAST(cd.den AS DOUBLE) / cd.num) / (CAST(cr.den AS DOUBLE) / cr.num) AS q FROM cd, cr) GROUP BY ALL HAVING bool_and(abs(q - round_even(q, 0)) < 1e-6 AND round_even(q, 0) >= 1)),
rt AS (SELECT num, den FROM (SELECT * FROM ft UNION ALL (SELECT num, den, 3, 0.0 FROM cr ORDER BY clips DESC, first_path LIMIT 1)) ORDER BY tier, o LIMIT 1)"""
_TL = _RATE + """, cp AS (SELECT path, CASE WHEN id % 10 = 0 THEN 0.0 ELSE round_even(duration_sec / 100000, 3) END AS duration FROM videos),
mk AS (SELECT DISTINCT path, round_even(timestamp_sec / 90000, 3) AS t, name AS label FROM faces JOIN people USING (cluster_id) JOIN videos ON videos.id = video_id),
ly AS (SELECT path, num, den, CAST(num AS DOUBLE) / den AS spf, df AS dur_frames, coalesce(sum(df) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offset_frames FROM (SELECT cp.path, num, den, CAST(greatest(1, ceil((CASE WHEN duration > 0 THEN duration ELSE coalesce(m, 0.0) + 1.0 END) / (CAST(num AS DOUBLE) / den) - 0.001)) AS BIGINT) AS df FROM cp CROSS JOIN rt LEFT JOIN (SELECT path, max(t) AS m FROM mk GROUP BY path) USING (path))),
pm AS (SELECT ly.*, t, label, least(t, greatest(dur_frames * spf - spf, 0.0)) AS pos FROM ly JOIN mk USING (path))"""
_TC = "printf('%02d:%02d:%02d:%02d', CAST({0} // {1} // 3600 AS BIGINT), CAST({0} // {1} // 60 % 60 AS BIGINT), CAST({0} // {1} % 60 AS BIGINT), CAST({0} % {1} AS BIGINT))"
_FR = "CAST(round(CAST(den AS DOUBLE) / num) AS BIGINT)"


@_query(None)
def timeline_rate(s, d):
    return _rate(s, d)


_SQL["timeline_rate"] = _with(_RATE, "SELECT num, den FROM rt", "videos")


@_query(None)
def timeline_layout(s, d):
    return _lay(s, d).select("path", "offset_frames", "dur_frames")


_SQL["timeline_layout"] = _with(_TL, "SELECT path, CAST(offset_frames AS BIGINT) AS offset_frames, dur_frames FROM ly", "faces", "people", "videos")


@_query(None)
def edl_rows(s, d):
    return timeline.edl_rows(_lay(s, d), _markers(s, d)).withColumn("n", F.col("n").cast("bigint"))


_AT = "CAST(round_even((offset_frames * spf + pos{0}) * den / num, 0) AS BIGINT)"
_EDL = f"SELECT row_number() OVER (ORDER BY path, t, label) AS n, path, label, {_TC.format(_AT.format(''), _FR)} AS tc_in, {_TC.format(_AT.format(' + spf'), _FR)} AS tc_out, CASE WHEN label = 'Energy peak' THEN 'Yellow' ELSE 'Blue' END AS color FROM pm"
_SQL["edl_rows"] = _with(_TL, _EDL, "faces", "people", "videos")


def _starts(s, d):
    return A.videos(s, d).select("path", N.timecode_seconds(F.format_string("%02d:%02d:%02d;%02d", F.col("id") % 24, F.col("id") % 60, (F.col("id") * 7) % 60, F.col("id") % 60), F.lit(60000.0) / 1001).alias("start_sec"))


_DF = "((((id % 24) * 60 + id % 60) * 60 + (id * 7) % 60) * 60 + id % 60 - 4 * ((id % 24) * 60 + id % 60 - ((id % 24) * 60 + id % 60) // 10)) / (CAST(60000 AS DOUBLE) / 1001)"


@_query(None)
def fcpxml_times(s, d):
    return timeline.fcpxml_times(_lay(s, d), _starts(s, d))


_RT = "CAST(CAST({} AS BIGINT) * num AS VARCHAR) || '/' || CAST(den AS VARCHAR) || 's'"
_SX = f", sx AS (SELECT path, {_DF} AS start_sec FROM videos)"
_SQL["fcpxml_times"] = _with(_TL + _SX, f"SELECT path, {_RT.format('offset_frames')} AS \"offset\", {_RT.format('round_even(coalesce(start_sec, 0.0) * den / num, 0)')} AS start, {_RT.format('dur_frames')} AS duration FROM ly LEFT JOIN sx USING (path)", "faces", "people", "videos")


@_query(f"SELECT path, round({_DF}, 6) AS start_sec FROM videos", "videos")
def timecode_seconds(s, d):
    return _starts(s, d).withColumn("start_sec", F.round("start_sec", 6))


@_query(None)
def fcpxml_text(s, d):
    return timeline.fcpxml(_lay(s, d), _markers(s, d), _starts(s, d))


@_query(None)
def edl_text(s, d):
    return timeline.edl(_lay(s, d), _markers(s, d))


_SQL["edl_text"] = _with(_TL + f", ed AS ({_EDL})", "SELECT 'TITLE: Markers' || chr(10) || 'FCM: NON-DROP FRAME' || chr(10) || chr(10) || string_agg(printf('%03d', n) || '  001      V     C        ' || tc_in || ' ' || tc_out || ' ' || tc_in || ' ' || tc_out || chr(10) || ' |C:ResolveColor' || color || ' |M:' || " + _STRIP.format("translate(label, '|' || chr(10), '- ')") + " || ' |D:1' || chr(10), chr(10) ORDER BY n) AS text FROM ed HAVING count(*) > 0", "faces", "people", "videos")


@_query(None)
def marker_table(s, d):
    return timeline.marker_table(_markers(s, d))


@_query(None)
def marker_sources(s, d):
    return timeline.all_markers(_markers(s, d), timeline.peak_markers(A.videos(s, d)))


_SQL["marker_sources"] = _with(_TL, "SELECT path, t, label FROM mk UNION SELECT path, energy_peaks[1] AS t, 'Energy peak' AS label FROM videos WHERE energy_bucket IS NOT NULL AND len(energy_peaks) > 0", "faces", "people", "videos")


@_query(None)
def markers_deduped(s, d):
    return timeline.clean_markers(A.faces(s, d).join(A.people(s, d), "cluster_id").select(F.col("video_id").cast("string").alias("path"), (F.col("timestamp_sec") / 1e6).alias("t"), F.col("name").alias("label")), 20)


_SQL["markers_deduped"] = _with(", mo AS (SELECT CAST(video_id AS VARCHAR) AS path, label, min(t) AS t FROM (SELECT video_id, timestamp_sec / 1e6 AS t, name AS label FROM faces JOIN people USING (cluster_id)) GROUP BY video_id, label, round_even(t * 1000, 0))", "SELECT path, t, label, CAST(dropped AS BIGINT) AS dropped FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY t, label) AS r, greatest(0, count(*) OVER (PARTITION BY path) - 20) AS dropped FROM mo) WHERE r <= 20", "faces", "people")


@_query(None)
def foreign_markers(s, d):
    return timeline.foreign_markers(_markers(s, d), A.people(s, d).where("cluster_id < 2"))


_SQL["foreign_markers"] = _with(_TL, "SELECT path, t, label FROM mk WHERE label NOT IN ('Ellie', 'Grayson')", "faces", "people", "videos")


def _inodes(s, d):
    return A.videos(s, d).select("path", F.lit(1).alias("dev"), F.when(F.col("id") % 5 == 0, 0).otherwise(F.floor(F.col("id") / 3)).alias("ino"), (F.col("id") % 9 != 0).alias("on_disk"))


@_query("SELECT path, min(path) OVER (PARTITION BY CASE WHEN id % 5 = 0 OR id < 3 THEN path ELSE CAST(id // 3 AS VARCHAR) END) AS survivor FROM videos", "videos")
def dedupe_files(s, d):
    return timeline.same_files(_inodes(s, d))


@_query(None)
def markers_summary(s, d):
    i = _inodes(s, d)
    return timeline.marker_summary(i, _markers(s, d), timeline.same_files(i))


_SQL["markers_summary"] = _with(_TL + ", sv AS (SELECT path, id % 9 <> 0 AS on_disk, min(path) OVER (PARTITION BY CASE WHEN id % 5 = 0 OR id < 3 THEN path ELSE CAST(id // 3 AS VARCHAR) END) AS survivor FROM videos), hs AS (SELECT DISTINCT survivor AS path FROM mk JOIN sv USING (path))", "SELECT *, timeline - marked AS unmarked FROM (SELECT count(*) AS scanned, count(*) FILTER (on_disk AND survivor <> path) AS deduped, count(*) FILTER (NOT on_disk) AS missing, count(*) FILTER (on_disk AND survivor = path) AS timeline, count(*) FILTER (on_disk AND survivor = path AND path IN (SELECT path FROM hs)) AS marked FROM sv)", "faces", "people", "videos")


@_query(None)
def majority_rate(s, d):
    return library.mode(_clips(s, d).select("path", N.nearest_rate(F.col("fps")).alias("r")).select("path", "r.num", "r.den"), ["num", "den"], "path")


_SQL["majority_rate"] = _with("", "SELECT 1001 AS num, CASE WHEN id % 4 IN (0, 2) THEN 30000 ELSE 60000 END AS den, count(*) AS n FROM videos GROUP BY ALL ORDER BY n DESC, min(path) LIMIT 1", "videos")


# text and paths ---------------------------------------------------------------------------------------------------


@_query(r"""SELECT doc_id, md5(replace(replace(replace(replace(h, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS xml, md5(""" + _STRIP.format("translate(h, ',={[}]', '  (())')") + ") AS marker, md5(" + _STRIP.format("translate(h, '|' || chr(10), '- ')") + r""") AS edl, md5('"' || replace(replace(replace(h, '\', '\\'), '"', '\"'), chr(10), '\n') || '"') AS lua, md5(lower(""" + _STRIP.format(r"regexp_replace(h, '\s+', ' ', 'g')") + ")) AS prompt FROM (SELECT page_id AS doc_id, html AS h FROM pages)")
def text_safe(s, d):
    h = F.col("html")
    return A.table(s, d, "pages").select(F.col("page_id").alias("doc_id"), F.md5(T.xml(h)).alias("xml"), F.md5(T.marker_name(h)).alias("marker"), F.md5(T.edl_name(h)).alias("edl"), F.md5(T.lua(h)).alias("lua"), F.md5(T.clean_prompt(h)).alias("prompt"))


@_query("SELECT id, regexp_extract(path, '[^/]+$', 0) AS file, regexp_replace(path, '/[^/]*$', '') AS folder, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS suffix, 'Clip_' || CAST(id AS VARCHAR) AS stem, true AS video, 'file://' || path AS url FROM videos", "videos")
def path_parts(s, d):
    p = F.col("path")
    return A.videos(s, d).select("id", P.basename(p).alias("file"), P.parent(p).alias("folder"), P.suffix(p).alias("suffix"), P.stem(p).alias("stem"), P.is_kind(p, (".mov", ".mp4")).alias("video"), P.file_url(p).alias("url"))


@_query(r"SELECT page_id, array_to_string(list_slice(list_filter(w, lambda x, i: list_position(w, x) = i), 1, 5), ', ') AS tags FROM (SELECT page_id, list_filter(string_split_regex(lower(regexp_extract(url, '([^/]*)/*$', 1)), '[-_.\s]+'), lambda x: length(x) > 1 AND NOT regexp_full_match(x, '[0-9]+') AND x NOT IN ('the','and','a','an','of','in','on','at','for','to','test','tests','video','videos','footage','clip','clips','mov','mp4','avi','m4v','raw','edit','final','draft','v1','v2','v3')) AS w FROM pages)")
def suggest_tags(s, d):
    return A.table(s, d, "pages").select("page_id", P.suggest_tags(F.col("url")).alias("tags"))


@_query("SELECT DISTINCT tag, CASE lower(" + _STRIP.format("tag") + ") WHEN 'beach' THEN 'a beach' WHEN 'kids' THEN 'kids playing' WHEN 'wedding' THEN 'a wedding ceremony' WHEN 'dog' THEN 'a pet dog' ELSE tag END AS phrase FROM (SELECT unnest(batch_tags) AS tag FROM videos)", "videos")
def enrich_tags(s, d):
    return A.videos(s, d).select(F.explode("batch_tags").alias("tag")).distinct().select("tag", T.enrich(F.col("tag")).alias("phrase"))


@_query("SELECT path, CASE WHEN c = 1 THEN stem ELSE f || '/' || stem END AS name FROM (SELECT path, f, stem, count(*) OVER (PARTITION BY stem) AS c FROM (SELECT '/v/' || CAST(id % 2 AS VARCHAR) || '/IMG_' || CAST(id % 100 AS VARCHAR) || '.MOV' AS path, CAST(id % 2 AS VARCHAR) AS f, 'IMG_' || CAST(id % 100 AS VARCHAR) AS stem FROM videos))", "videos")
def display_names(s, d):
    i = F.col("id")
    v = A.videos(s, d).select(F.concat(F.lit("/v/"), (i % 2).cast("string"), F.lit("/IMG_"), (i % 100).cast("string"), F.lit(".MOV")).alias("path"))
    return v.select("path", P.display_name(F.col("path")).alias("name"))


@_query("SELECT event_id, CAST(sw - sw % 2 AS INTEGER) AS w, CAST(sh - sh % 2 AS INTEGER) AS h FROM (SELECT event_id, round_even(w * least(1.0, 960.0 / greatest(w, h)), 0) AS sw, round_even(h * least(1.0, 960.0 / greatest(w, h)), 0) AS sh FROM (SELECT event_id, 400 + event_id % 3500 AS w, 300 + event_id % 1700 AS h FROM events))")
def output_scale(s, d):
    e = A.table(s, d, "events").select("event_id", (400 + F.col("event_id") % 3500).alias("w"), (300 + F.col("event_id") % 1700).alias("h"))
    w, h = N.scaled(F.col("w"), F.col("h"))
    return e.select("event_id", w.alias("w"), h.alias("h"))


# state ------------------------------------------------------------------------------------------------------------


@_query("SELECT id, path FROM videos WHERE starts_with(path, '/lib/1/') AND id % 2 = 0", "videos")
def forget_missing(s, d):
    v = A.videos(s, d)
    return state.forget_missing(v, v.where("id % 2 = 1"), "/lib/1")


@_query("SELECT count(*) AS faces FROM faces WHERE NOT (video_id % 12 = 1 AND video_id % 2 = 0 OR video_id % 12 = 3)", "faces")
def forget_cascade(s, d):
    v = A.videos(s, d)
    gone = state.forget_missing(v, v.where("id % 12 != 3"), "/lib/3")
    return state.cascade({"videos": v, "faces": A.faces(s, d)}, gone)["faces"].agg(F.count("*").alias("faces"))


@_query("SELECT video_id, tag, score FROM auto_tags WHERE video_id % 5 <> 0 UNION ALL SELECT video_id, 'new' AS tag, 0.5 AS score FROM (SELECT DISTINCT video_id FROM auto_tags WHERE video_id % 10 = 0)", "auto_tags")
def replace_tags(s, d):
    a = A.auto_tags(s, d)
    new = a.where("video_id % 10 = 0").select("video_id").distinct().select("video_id", F.lit("new").alias("tag"), F.lit(0.5).alias("score"))
    return state.replace_by(a, new, a.where("video_id % 5 = 0"), "video_id")


@_query("SELECT video_id, tag, score FROM auto_tags WHERE tag NOT IN ('Tag1', 'Tag2')", "auto_tags")
def delete_tags(s, d):
    return state.delete_tags(A.auto_tags(s, d), s.createDataFrame([(" tag1",), ("TAG2",), (" ",)], "tag string"))


@_query("SELECT video_id, tag, score FROM auto_tags WHERE NOT (tag = 'Tag1' AND video_id IN (SELECT id FROM videos WHERE starts_with(path, '/lib/3/')))", "videos", "auto_tags")
def delete_pairs(s, d):
    v = A.videos(s, d)
    return state.delete_pairs(A.auto_tags(s, d), v, v.where(F.col("path").startswith("/lib/3/")).select("path", F.lit("TAG1").alias("tag")))


@_query("SELECT id, path, CASE WHEN id % 2 = 0 THEN 9.5 ELSE duration_sec END AS duration_sec FROM videos", "videos")
def add_videos(s, d):
    v = A.videos(s, d)
    old = v.select("id", "path", "duration_sec", F.lit("then").alias("scanned_at"))
    return state.add_videos(old, v.where("id % 2 = 0").select("path", F.lit(9.5).alias("duration_sec"), F.lit("now").alias("scanned_at"))).select("id", "path", "duration_sec")


@_query("SELECT path, CASE WHEN id % 11 = 0 THEN 'away' WHEN id % 13 = 0 THEN 'new' WHEN id % 7 = 0 THEN 'rescan' WHEN id % 2 = 0 THEN 'backfill' ELSE 'done' END AS action FROM videos", "videos")
def scan_plan(s, d):
    v = A.videos(s, d)
    listing = v.select("path", F.col("path").alias("real_path"), (F.col("id") % 11 != 0).alias("on_disk"))
    again = listing.withColumn("path", F.concat("path", F.lit("~link")))
    return library.scan_plan(listing.union(again), v.where("id % 13 != 0").withColumn("has_embeddings", F.col("id") % 2 == 1))


@_query("SELECT id, CASE WHEN id % 2 = 0 THEN 'high' ELSE energy_bucket END AS energy_bucket, CASE WHEN id % 2 = 0 THEN 2 ELSE energy_version END AS energy_version FROM videos", "videos")
def set_energy(s, d):
    v = A.videos(s, d)
    scored = v.where("id % 2 = 0").select("id", F.lit(0.7).alias("score"), F.lit("high").alias("bucket"), F.array(F.lit(1.23456)).alias("peaks"))
    return state.set_energy(v, scored, 2).select("id", "energy_bucket", "energy_version")


@_query("SELECT id, CASE WHEN id % 3 = 0 THEN 7 ELSE cluster_id END AS cluster_id FROM faces", "faces")
def assign_clusters(s, d):
    f = A.faces(s, d)
    return state.assign_clusters(f, f.where("id % 3 = 0").select("id", F.lit(7).alias("cluster_id"))).select("id", "cluster_id")


@_query("SELECT name, regexp_replace(name, '-[^-]*$', '') AS prefix, stamp FROM (SELECT 'backup-' || CAST(o_orderkey AS VARCHAR) AS name, o_orderkey AS stamp FROM orders) ORDER BY stamp DESC OFFSET 3")
def backup_retention(s, d):
    o = A.table(s, d, "orders")
    return state.expired(o.select(F.concat(F.lit("backup-"), F.col("o_orderkey").cast("string")).alias("name")))


@_query("SELECT count(*) AS total, count(*) FILTER (user_id % 10 = 0) AS failed, count(*) FILTER (user_id % 10 <> 0) AS ok, true AS partial FROM events")
def failure_tally(s, d):
    return library.failures(A.table(s, d, "events").select((F.col("user_id") % 10 == 0).alias("failed")))


@_query("SELECT count(*) FILTER (cluster_id BETWEEN 0 AND 1) AS matched, count(DISTINCT CASE WHEN cluster_id > 1 THEN cluster_id END) AS formed, count(*) FILTER (cluster_id = -1) AS noise FROM faces", "faces")
def cluster_run_stats(s, d):
    return clustering.run_stats(A.faces(s, d), 1)


# streams, drained once --------------------------------------------------------------------------------------------


@_query("SELECT user_id, event_type, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY user_id, event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT user_id, event_type, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events)) GROUP BY user_id, event_type, g")
def stream_appearances(s, d):
    return streams.drained_appearances(s, d)


@_query("SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, max(value) AS peak FROM events GROUP BY ALL")
def stream_energy_windows(s, d):
    return streams.drained_windows(s, d)


@_query("SELECT user_id AS cluster_id, arg_max(event_type, event_id) AS name FROM events GROUP BY user_id")
def stream_label_edits(s, d):
    return streams.drained_edits(s, d)


# filters, geometry, labels ----------------------------------------------------------------------------------------


@_query("SELECT event_id, round(CASE WHEN d >= 2 THEN e / d * (t - d) END, 6) AS left_sec FROM (SELECT event_id, event_id % 7 AS d, 9 AS t, value AS e FROM events)")
def eta_remaining(s, d):
    e = A.table(s, d, "events")
    return e.select("event_id", F.round(N.remaining(F.col("event_id") % 7, F.lit(9), F.col("value")), 6).alias("left_sec"))


@_query("""SELECT event_id, CAST(greatest(0, floor(x * u - w * u * 0.3)) AS INTEGER) AS x0, CAST(greatest(0, floor(y * u - h * u * 0.3)) AS INTEGER) AS y0, CAST(least(fw, floor((x + w) * u + w * u * 0.3)) AS INTEGER) AS x1, CAST(least(fh, floor((y + h) * u + h * u * 0.3)) AS INTEGER) AS y1
FROM (SELECT *, greatest(CAST(1.0 AS DOUBLE), greatest(fw, fh) / CAST(960 AS DOUBLE)) AS u FROM (SELECT event_id, event_id % 900 AS x, event_id % 500 AS y, 10 + event_id % 90 AS w, 12 + event_id % 80 AS h, 800 + event_id % 3100 AS fw, 600 + event_id % 1500 AS fh FROM events))""")
def crop_boxes(s, d):
    i = F.col("event_id")
    e = A.table(s, d, "events").select("event_id", (i % 900).alias("x"), (i % 500).alias("y"), (10 + i % 90).alias("w"), (12 + i % 80).alias("h"), (800 + i % 3100).alias("fw"), (600 + i % 1500).alias("fh"))
    box = N.crop(*[F.col(c) for c in ("x", "y", "w", "h", "fw", "fh")])
    return e.select("event_id", *[b.alias(n) for b, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)])


@_query("SELECT cluster_id, n, name FROM (SELECT cluster_id, count(*) AS n, any_value(name) AS name FROM faces LEFT JOIN people USING (cluster_id) WHERE cluster_id >= 0 GROUP BY cluster_id) WHERE contains(CAST(cluster_id AS VARCHAR), 'ra') OR contains(lower(name), 'ra')", "faces", "people")
def labeler_search(s, d):
    return library.labeler_search(library.cluster_summary(A.faces(s, d), A.people(s, d)), " RA")


@_query("SELECT tag, path FROM (SELECT tag, path, row_number() OVER (PARTITION BY tag ORDER BY score, path) AS r FROM auto_tags JOIN videos ON videos.id = video_id) WHERE r > 6", "videos", "auto_tags")
def rest_of_clips(s, d):
    t = A.auto_tags(s, d).join(A.videos(s, d).select(F.col("id").alias("video_id"), "path"), "video_id")
    return tagging.rest(t)


@_query("SELECT den AS rate_den, count(*) AS clips FROM (SELECT CASE WHEN id % 4 IN (0, 2) THEN 30000 ELSE 60000 END AS den FROM videos) GROUP BY den", "faces", "videos")
def rate_histogram(s, d):
    return timeline.clip_rates(_clips(s, d)).select(F.col("den").alias("rate_den"), "clips")


@_query("SELECT id, path FROM videos WHERE id NOT IN (SELECT video_id FROM frames) AND id % 11 <> 0", "faces", "videos", "frames")
def needs_embedding(s, d):
    return library.need_embedding(A.videos(s, d).where("id % 11 != 0"), A.frames(s, d))


@_query("SELECT video_id, timestamp_sec, vec_id FROM frames WHERE video_id = 7", "frames")
def clip_frames(s, d):
    return A.frames(s, d).where("video_id = 7").select("video_id", "timestamp_sec", "vec_id")


@_query("SELECT vec_id, round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total FROM embeddings")
def blob_codec(s, d):
    e = A.table(s, d, "embeddings").select("vec_id", vectors.from_f32(vectors.to_f32("embedding")).alias("e"))
    return e.select("vec_id", F.round(F.aggregate(vectors.doubles(F.col("e")), F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@_query("SELECT video_id, names || CASE WHEN n > 3 THEN ' +' || CAST(n - 3 AS VARCHAR) || ' more' ELSE '' END AS seen FROM (SELECT video_id, array_to_string(list_slice(list_sort(list_distinct(list('e' || CAST(id AS VARCHAR)))), 1, 3), ', ') AS names, count(DISTINCT id) AS n FROM faces GROUP BY video_id)", "faces")
def seen_in_labels(s, d):
    f = A.faces(s, d).groupBy("video_id").agg(F.sort_array(F.collect_set(F.concat(F.lit("/x/e"), F.col("id").cast("string")))).alias("p"))
    return f.select("video_id", T.seen_in(F.col("p")).alias("seen"))


@_query("SELECT id, sha256(path || 'salt') AS hashed, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN CAST(CAST(round(m) AS BIGINT) AS VARCHAR) || CASE WHEN round(m) = 1 THEN ' minute' ELSE ' minutes' END || ' ago' WHEN round(m / 60) < 24 THEN CAST(CAST(round(m / 60) AS BIGINT) AS VARCHAR) || CASE WHEN round(m / 60) = 1 THEN ' hour' ELSE ' hours' END || ' ago' ELSE CAST(CAST(round(m / 1440) AS BIGINT) AS VARCHAR) || CASE WHEN round(m / 1440) = 1 THEN ' day' ELSE ' days' END || ' ago' END AS age FROM (SELECT id, path, CAST(id * id AS DOUBLE) / 2 AS m FROM videos)", "faces", "videos")
def ids_and_ages(s, d):
    m = (F.col("id") * F.col("id")).cast("double") / 2
    return A.videos(s, d).select("id", T.hashed_id(F.col("path"), "salt").alias("hashed"), T.age(m).alias("age"))


@_query("SELECT event_id, greatest(1, CAST(value AS INTEGER) % 40 - 20) AS w, value / 100 AS score FROM events WHERE value / 100 >= 0.5")
def detection_filter(s, d):
    e = A.table(s, d, "events").select("event_id", F.greatest(F.lit(1), F.rint("value").cast("int") % 40 - 20).alias("w"), (F.col("value") / 100).alias("score"))
    return e.where("score >= 0.5")


# what there is, totals, runs -----------------------------------------------------------------------------------------


@_query("SELECT id, scan_complete AS scanned, id IN (SELECT video_id FROM faces WHERE cluster_id >= 0) AS clustered, id IN (SELECT video_id FROM frames) AS embedded, energy_bucket IS NOT NULL AS energy, energy_bucket IS NOT NULL AND energy_version = 2 AS current FROM videos", "faces", "videos", "frames")
def existence(s, d):
    return library.existence(A.videos(s, d), A.faces(s, d), A.frames(s, d), 2)


@_query("SELECT (SELECT count(*) FROM videos) AS total, count(*) AS tagged, regexp_extract(min(path), '[^/]+$', 0) AS file, arg_min(tags, path) AS tags FROM (SELECT path, array_to_string(list(tag ORDER BY score DESC, tag), '; ') AS tags FROM auto_tags JOIN videos ON videos.id = video_id GROUP BY path)", "videos", "auto_tags")
def tagged_totals(s, d):
    return library.tagged_totals(A.videos(s, d), A.auto_tags(s, d)).withColumn("tags", F.array_join("tags", "; "))


@_query("SELECT DISTINCT event_type AS event FROM events WHERE event_type NOT IN ('click', 'view')")
def undeclared_events(s, d):
    declared = s.createDataFrame([("click",), ("view",), ("never",)], "event string")
    return library.undeclared(A.table(s, d, "events").select(F.col("event_type").alias("event")), declared)


@_query("SELECT view, count(*) AS clusters FROM (SELECT CASE WHEN name IS NOT NULL AND name <> '' THEN 'labeled' WHEN n >= 3 THEN 'needs' ELSE 'other' END AS view FROM (SELECT cluster_id, count(*) AS n, any_value(name) AS name FROM faces LEFT JOIN (SELECT * FROM people WHERE cluster_id <> 2) USING (cluster_id) WHERE cluster_id >= 0 GROUP BY cluster_id)) GROUP BY view", "faces", "people")
def labeler_counts(s, d):
    return library.view_counts(library.labeler_view(library.cluster_summary(A.faces(s, d), A.people(s, d).where("cluster_id != 2"))))


@_query("SELECT id, cluster_id, rank FROM (SELECT f.id, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY md5(CAST(f.id AS VARCHAR) || ':0'), f.id) AS rank FROM faces f JOIN videos v ON v.id = video_id WHERE cluster_id >= 0 AND (path = '/lib/3' OR starts_with(path, '/lib/3/') OR path = '/lib/1' OR starts_with(path, '/lib/1/') OR cluster_id NOT IN (SELECT cluster_id FROM faces JOIN videos ON videos.id = video_id WHERE path = '/lib/3' OR starts_with(path, '/lib/3/') OR path = '/lib/1' OR starts_with(path, '/lib/1/')))) WHERE rank <= 9", "faces", "videos")
def representatives_scoped(s, d):
    return library.scoped_representatives(A.faces(s, d), A.videos(s, d), A.ROOTS).select("id", "cluster_id", F.col("rank").cast("bigint").alias("rank"))


@_query(None)
def tag_run(s, d):
    stored = A.videos(s, d).select(F.col("id").alias("video_id"), F.lit("old").alias("tag"), F.lit(0.5).alias("score"))
    return tagging.tag_run(A.frames(s, d), _prompts(s, d), stored).withColumn("score", F.round("score", 6))


_SQL["tag_run"] = _with(_FP + _rel(Tagging()), "SELECT video_id, tag, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, tag) AS rank FROM kp) WHERE rank <= 3 UNION ALL SELECT id, 'old', 0.5 FROM videos WHERE id NOT IN (SELECT video_id FROM frames)", "faces", "videos", "frames")


@_query("SELECT event_id, CASE WHEN event_type = 'click' OR event_type = 'signup' THEN 'someone came' WHEN event_type = 'view' THEN 'someone looked' ELSE event_type END AS said FROM events")
def explained_errors(s, d):
    said = T.explained(F.col("event_type"), [(("CLICK", "sign"), "someone came"), (("view",), "someone looked")])
    return A.table(s, d, "events").select("event_id", said.alias("said"))


@_query("SELECT id, id % 2 = 0 OR scan_complete AS scan_complete FROM videos", "videos")
def completion_flags(s, d):
    v = A.videos(s, d)
    return state.mark_complete(v, v.where("id % 2 = 0")).select("id", "scan_complete")


@_query("SELECT id, array_to_string(CASE WHEN id % 2 = 0 THEN ['new', 'old ' || CAST(id AS VARCHAR)] ELSE written_keywords END, '; ') AS keywords FROM videos", "videos")
def keyword_record(s, d):
    v = A.videos(s, d)
    lines = F.concat(F.lit("new\n\nold "), F.col("id").cast("string"), F.lit("\n"))
    return state.set_keywords(v, v.where("id % 2 = 0").select("id", T.from_lines(lines).alias("keywords"))).select("id", F.array_join("written_keywords", "; ").alias("keywords"))


@_query("SELECT name, arg_max(v, event_id) AS value FROM (SELECT event_id, event_type AS name, CAST(value AS VARCHAR) AS v FROM events) GROUP BY name")
def settings(s, d):
    e = A.table(s, d, "events").select("event_id", F.col("event_type").alias("name"), F.col("value").cast("string").alias("value"))
    last = e.groupBy("name").agg(F.max_by("value", "event_id").alias("value"))
    return state.upsert(s.createDataFrame([("click", "before"), ("view", "before")], "name string, value string"), last, "name")


@_query(None)
def text_token_ids(s, d):
    """Every document as a text encoder's ids, by the merges of a public vocabulary; no SQL merges pairs."""
    import public_tokenizers

    merges = bpe.read_merges(public_tokenizers.path("word_bpe_49k.json"))
    ids = A.table(s, d, "documents").select("doc_id", bpe.bpe_ids(F.col("text"), merges).alias("ids"))
    end = F.lit(bpe.Encoder(merges).id[bpe.END])  # what comes behind the last end is padding; a zero before it is a letter's id
    return ids.select("doc_id", (F.size("ids") + 1 - F.array_position(F.reverse("ids"), end)).cast("long").alias("n"), "ids")
