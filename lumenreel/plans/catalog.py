"""Named queries over the shared test tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import paths as P
from ..functions import text as T
from ..operators import clustering, energy, library, sessions, state, tagging, timeline, vectors
from ..params import Clustering, Sessions, Tagging
from . import adapter as A

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(body: str | None, *views: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if body is not None:
            _SQL[f.__name__] = A.sql(body, *views)
        return f

    return add


def queries() -> dict[str, Query]:
    from . import catalog_more  # noqa: F401  registers the rest

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import catalog_more  # noqa: F401

    return dict(_SQL)


def _join(c, sep: str = "; "):
    return F.array_join(c, sep)


_IN = "(path = '/lib/3' OR starts_with(path, '/lib/3/') OR path = '/lib/1' OR starts_with(path, '/lib/1/'))"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


# people -----------------------------------------------------------------------------------------------------------


@_query("SELECT video_id, path, count(*) AS hits FROM faces JOIN people USING (cluster_id) JOIN videos ON videos.id = video_id WHERE name = 'Ellie' GROUP BY video_id, path", "faces", "people", "videos")
def search_person(s, d):
    return library.search_person(A.faces(s, d), A.people(s, d), A.videos(s, d), "Ellie")


@_query("SELECT cluster_id, count(*) AS n, any_value(name) AS name FROM faces LEFT JOIN people USING (cluster_id) WHERE cluster_id >= 0 AND cluster_id NOT IN (SELECT cluster_id FROM hidden) GROUP BY cluster_id", "faces", "people", "hidden")
def cluster_summary(s, d):
    return library.cluster_summary(A.faces(s, d), A.people(s, d), A.hidden(s, d))


@_query(f"SELECT f.cluster_id, count(*) AS n, any_value(name) AS name, array_to_string(list_sort(list_distinct(list(path))), '; ') AS paths FROM faces f LEFT JOIN people p ON f.cluster_id = p.cluster_id JOIN videos v ON v.id = video_id WHERE f.cluster_id >= 0 GROUP BY f.cluster_id HAVING bool_or({_IN})", "faces", "people", "videos")
def cluster_summary_scoped(s, d):
    return library.cluster_summary_with_paths(A.faces(s, d), A.people(s, d), A.videos(s, d), None, A.ROOTS).withColumn("paths", _join("paths"))


@_query("SELECT cluster_id, n, name, CASE WHEN name IS NOT NULL AND name <> '' THEN 'labeled' WHEN n >= 3 THEN 'needs' ELSE 'other' END AS view FROM (SELECT cluster_id, count(*) AS n, any_value(name) AS name FROM faces LEFT JOIN (SELECT * FROM people WHERE cluster_id <> 2) USING (cluster_id) WHERE cluster_id >= 0 GROUP BY cluster_id)", "faces", "people")
def labeler_view(s, d):
    return library.labeler_view(library.cluster_summary(A.faces(s, d), A.people(s, d).where("cluster_id != 2")))


@_query("SELECT (SELECT count(*) FROM videos) AS videos, count(*) AS faces, count(DISTINCT CASE WHEN cluster_id >= 0 THEN cluster_id END) AS clusters, (SELECT count(*) FROM people) AS named FROM faces", "faces", "people", "videos")
def status_library(s, d):
    return library.totals(A.videos(s, d), A.faces(s, d), A.people(s, d))


@_query(f"SELECT (SELECT count(*) FROM videos WHERE {_IN}) AS videos, count(*) AS faces, count(DISTINCT CASE WHEN f.cluster_id >= 0 THEN f.cluster_id END) AS clusters, count(DISTINCT name) AS named FROM faces f JOIN videos v ON v.id = video_id LEFT JOIN people p ON p.cluster_id = f.cluster_id WHERE {_IN}", "faces", "people", "videos")
def status_batch(s, d):
    return library.batch_totals(A.videos(s, d), A.faces(s, d), A.people(s, d), A.ROOTS)


@_query("SELECT name, min(cluster_id) AS cluster_id, count(DISTINCT video_id) AS clips, count(*) AS faces FROM faces JOIN people USING (cluster_id) GROUP BY name", "faces", "people")
def status_people(s, d):
    return library.person_rollup(A.faces(s, d), A.people(s, d))


@_query("SELECT name, video_id, count(*) AS n, min(timestamp_sec) AS first, max(timestamp_sec) AS last, array_to_string(list_sort(list(CAST(round(timestamp_sec * 1e6) AS BIGINT))), ' ') AS times FROM faces JOIN people USING (cluster_id) GROUP BY name, video_id", "faces", "people")
def status_person_times(s, d):
    t = library.person_times(A.faces(s, d), A.people(s, d))
    return t.select("name", "video_id", F.size("times").cast("bigint").alias("n"), F.array_min("times").alias("first"), F.array_max("times").alias("last"), F.array_join(F.transform("times", lambda x: F.round(x * 1e6).cast("bigint").cast("string")), " ").alias("times"))


@_query("SELECT path, array_to_string(list_sort(list_distinct(list(name))), '; ') AS names FROM faces JOIN people USING (cluster_id) JOIN videos ON videos.id = video_id GROUP BY path", "faces", "people", "videos")
def videos_with_names(s, d):
    return library.videos_with_names(A.faces(s, d), A.people(s, d), A.videos(s, d)).withColumn("names", _join("names"))


@_query("SELECT p.cluster_id, count(f.id) AS n, p.name FROM people p LEFT JOIN faces f USING (cluster_id) GROUP BY p.cluster_id, p.name", "faces", "people")
def people_face_counts(s, d):
    return A.people(s, d).join(A.faces(s, d).select("cluster_id", "id"), "cluster_id", "left").groupBy("cluster_id", "name").agg(F.count("id").alias("n"))


@_query("SELECT coalesce(max(cluster_id), -1) AS max_cluster FROM faces WHERE cluster_id IS NOT NULL", "faces")
def max_cluster(s, d):
    return A.faces(s, d).agg(F.coalesce(F.max("cluster_id"), F.lit(-1)).alias("max_cluster"))


_MERGE = "m AS (SELECT p.cluster_id, name, lower(" + _STRIP.format("name") + ") AS k, (SELECT count(*) FROM faces f WHERE f.cluster_id = p.cluster_id) AS n FROM people p), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, name, cluster_id) AS i, count(*) OVER (PARTITION BY k) AS c FROM m WHERE k <> '')"


@_query("SELECT a.cluster_id, b.cluster_id AS into_cluster, b.name FROM r a JOIN r b ON a.k = b.k AND b.i = 1 WHERE a.c > 1")
def person_merge(s, d):
    return library.merge_map(A.faces(s, d), A.people(s, d)).withColumnRenamed("into", "into_cluster")


_SQL["person_merge"] = A.sql("SELECT 1", "faces", "people").replace("\nSELECT 1", ",\n" + _MERGE + "\nSELECT a.cluster_id, b.cluster_id AS into_cluster, b.name FROM r a JOIN r b ON a.k = b.k AND b.i = 1 WHERE a.c > 1")


@_query("SELECT name FROM (SELECT " + _STRIP.format("name") + " AS name, cluster_id FROM people) WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY cluster_id) = 1", "people")
def known_names(s, d):
    return library.known_names(A.people(s, d))


@_query("SELECT id, cluster_id, rank FROM (SELECT id, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY md5(CAST(id AS VARCHAR) || ':0'), id) AS rank FROM faces WHERE cluster_id >= 0) WHERE rank <= 9", "faces")
def representative_faces(s, d):
    return library.representatives(A.faces(s, d)).select("id", "cluster_id", F.col("rank").cast("bigint").alias("rank"))


@_query("SELECT * FROM (VALUES (0, 'Ellie'), (1, 'Grayson the Great'), (3, 'Rowan')) t(cluster_id, name)")
def label_edits(s, d):
    edits = s.createDataFrame([(1, 1, "name", "x"), (2, 1, "name", " Grayson the Great "), (3, 2, "name", ""), (4, 3, "hide", None), (5, 3, "name", "Rowan"), (6, 3, "unhide", None)], "seq int, cluster_id int, action string, name string")
    return state.apply_edits(A.people(s, d), A.hidden(s, d).where("false"), edits)[0]


@_query("SELECT cluster_id, CASE WHEN name = 'Ellie' THEN 'Elinor' ELSE name END AS name FROM people WHERE name <> 'Rowan'", "people")
def rename_delete_person(s, d):
    return state.delete_person(state.rename_person(A.people(s, d), " Ellie", "Elinor "), "Rowan")


# keywords and tags ------------------------------------------------------------------------------------------------

_KW = """, k AS (SELECT path, name AS k FROM faces JOIN people USING (cluster_id) JOIN videos ON videos.id = video_id
UNION SELECT path, tag FROM auto_tags JOIN videos ON videos.id = video_id WHERE lower(tag) <> 'tag3'
UNION SELECT path, energy_bucket || ' energy' FROM videos WHERE energy_bucket IS NOT NULL AND energy_bucket <> 'low')"""


def _with(ctes: str, body: str, *views: str) -> str:
    return A.sql("SELECT 1", *views).removesuffix("\nSELECT 1") + ctes + "\n" + body


def _keywords(s, d):
    return library.keywords(A.faces(s, d), A.people(s, d), A.videos(s, d), A.auto_tags(s, d), ["TAG3 "], True, ["Low"])


@_query(None)
def keyword_merge(s, d):
    return _keywords(s, d).withColumn("keywords", _join("keywords"))


_SQL["keyword_merge"] = _with(_KW, "SELECT path, array_to_string(list_sort(list(k)), '; ') AS keywords FROM k GROUP BY path", "faces", "people", "videos", "auto_tags")


@_query(None)
def keyword_diff(s, d):
    now = _keywords(s, d)
    prior = F.array(F.concat(F.lit("old "), (F.col("id") % 2).cast("string")))
    return A.videos(s, d).join(now, "path").select("path", _join(library.merged_keywords(F.col("written_keywords"), prior, F.col("keywords"))).alias("keywords"))


_SQL["keyword_diff"] = _with(_KW, "SELECT path, array_to_string(list_sort(list(x)), '; ') AS keywords FROM (SELECT path, k AS x FROM k UNION SELECT path, w FROM (SELECT path, id, unnest(written_keywords) AS w FROM videos WHERE path IN (SELECT path FROM k)) WHERE w <> 'old ' || CAST(id % 2 AS VARCHAR)) GROUP BY path", "faces", "people", "videos", "auto_tags")


@_query("SELECT DISTINCT lower(" + _STRIP.format("t") + ") AS tag FROM (SELECT unnest(batch_tags) AS t FROM videos WHERE " + _IN + ")", "videos")
def batch_vocabulary(s, d):
    return library.vocabulary(A.videos(s, d), A.ROOTS)


@_query("SELECT DISTINCT lower(" + _STRIP.format("t") + ") AS tag FROM (SELECT unnest(batch_tags) AS t FROM videos)", "videos")
def batch_vocabulary_fallback(s, d):
    return library.vocabulary(A.videos(s, d), ["/nowhere"])


@_query("SELECT tag, count(*) AS clips, round_even(max(score), 3) AS peak, arg_max(path, (score, -video_id)) AS sample, (SELECT array_to_string(list(p ORDER BY s, p), '; ') FROM (SELECT b.score AS s, w.path AS p FROM auto_tags b JOIN videos w ON w.id = b.video_id WHERE b.tag = a.tag ORDER BY b.score, w.path LIMIT 6)) AS weakest FROM auto_tags a JOIN videos v ON v.id = a.video_id GROUP BY tag", "videos", "auto_tags")
def tag_rollup(s, d):
    t = A.auto_tags(s, d).join(A.videos(s, d).select(F.col("id").alias("video_id"), "path"), "video_id")
    return tagging.rollup(t).withColumn("weakest", _join("weakest"))


_SQL["tag_rollup"] = _with(", t AS (SELECT tag, score, path, row_number() OVER (PARTITION BY tag ORDER BY score, path) AS up, row_number() OVER (PARTITION BY tag ORDER BY score DESC, path) AS down FROM auto_tags JOIN videos ON videos.id = video_id)", "SELECT tag, count(*) AS clips, round_even(max(score), 3) AS peak, max(CASE WHEN down = 1 THEN path END) AS sample, array_to_string(list(path ORDER BY up) FILTER (up <= 6), '; ') AS weakest FROM t GROUP BY tag", "videos", "auto_tags")


@_query(f"SELECT path, round_even(score, 3) AS score FROM auto_tags JOIN videos ON videos.id = video_id WHERE lower(tag) = 'tag3' AND {_IN}", "videos", "auto_tags")
def tag_clips(s, d):
    return library.tag_clips(A.auto_tags(s, d), A.videos(s, d), " TAG3", A.ROOTS)


@_query("SELECT path, array_to_string(list(tag ORDER BY score DESC, tag), '; ') AS tags FROM auto_tags JOIN videos ON videos.id = video_id GROUP BY path", "videos", "auto_tags")
def auto_tags_by_clip(s, d):
    return library.tags_by_clip(A.auto_tags(s, d), A.videos(s, d)).withColumn("tags", _join("tags"))


@_query("SELECT id, array_to_string(list_sort(list_distinct(list_transform(batch_tags, lambda t: lower(" + _STRIP.format("t") + ")))), ',') AS tags FROM videos", "videos")
def batch_tags_update(s, d):
    v = A.videos(s, d)
    return state.set_batch_tags(v, v.select("id", F.col("batch_tags").alias("tags"))).select("id", _join("batch_tags", ",").alias("tags"))


# scopes, search, report -------------------------------------------------------------------------------------------


@_query("WITH p AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages) SELECT path FROM p WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT regexp_extract(path, '^[^/]*/[^/]*', 0) AS root FROM p WHERE hash_root(path)) r WHERE path = root OR starts_with(path, root || '/'))")
def scope_semi_join(s, d):
    p = A.table(s, d, "pages").select(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("path")).distinct()
    roots = p.where(F.length("path") % 5 == 0).select(F.regexp_extract("path", "^[^/]*/[^/]*", 0).alias("root")).distinct()
    return P.in_scope(p, roots)


_SQL["scope_semi_join"] = _SQL["scope_semi_join"].replace("hash_root(path)", "length(path) % 5 = 0")


@_query(f"SELECT id, path FROM videos WHERE {_IN}", "videos")
def scope_filter(s, d):
    return A.videos(s, d).where(P.under(F.col("path"), A.ROOTS)).select("id", "path")


@_query("SELECT v.path, regexp_extract(v.path, '[^/]+$', 0) AS file, regexp_replace(v.path, '/[^/]*$', '') AS folder, coalesce(p.people, '') AS people, coalesce(t.tags, '') AS tags, coalesce(energy_bucket, '') AS energy, CAST(len(energy_peaks) AS INTEGER) AS peaks, array_to_string(written_keywords, '; ') AS keywords FROM videos v LEFT JOIN (SELECT video_id, array_to_string(list_sort(list_distinct(list(name))), '; ') AS people FROM faces JOIN people USING (cluster_id) GROUP BY video_id) p ON p.video_id = v.id LEFT JOIN (SELECT video_id, array_to_string(list(tag ORDER BY score DESC, tag), '; ') AS tags FROM auto_tags GROUP BY video_id) t ON t.video_id = v.id", "faces", "people", "videos", "auto_tags")
def report_rows(s, d):
    return library.report(A.faces(s, d), A.people(s, d), A.videos(s, d), A.auto_tags(s, d))


def _found(s, d):
    return library.library_search(_keywords(s, d), "Tag7")


@_query(None)
def library_search(s, d):
    return library.capped(_found(s, d).select("path"), ["path"], 200)


_SQL["library_search"] = _with(_KW, "SELECT path, (SELECT count(DISTINCT path) FROM k WHERE contains(lower(k), 'tag7') OR contains(lower(regexp_extract(path, '[^/]+$', 0)), 'tag7')) AS total FROM (SELECT DISTINCT path FROM k WHERE contains(lower(k), 'tag7') OR contains(lower(regexp_extract(path, '[^/]+$', 0)), 'tag7')) ORDER BY path LIMIT 200", "faces", "people", "videos", "auto_tags")


@_query(None)
def people_search(s, d):
    return library.people_search(A.faces(s, d), A.people(s, d), A.videos(s, d), _keywords(s, d), "clip_7.")


_SQL["people_search"] = _with(_KW, "SELECT name FROM people WHERE contains(lower(name), 'clip_7.') UNION SELECT name FROM faces JOIN people USING (cluster_id) JOIN videos ON videos.id = video_id WHERE contains(lower(path), 'clip_7.')", "faces", "people", "videos", "auto_tags")


@_query("SELECT CASE energy_bucket WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS rank, energy_bucket AS bucket, count(*) AS clips, max(CASE WHEN i = 1 THEN path END) AS sample, array_to_string(list(path ORDER BY i) FILTER (i <= 4), '; ') AS thumbs FROM (SELECT *, row_number() OVER (PARTITION BY energy_bucket ORDER BY energy_score DESC, path) AS i FROM videos WHERE energy_bucket IS NOT NULL) GROUP BY energy_bucket", "videos")
def energy_summary(s, d):
    return library.energy_groups(A.videos(s, d)).withColumn("thumbs", _join("thumbs"))


@_query("SELECT id, path FROM videos WHERE len(energy_peaks) > 0 AND energy_bucket IS NOT NULL AND energy_bucket NOT IN ('low')", "videos")
def energy_peak_clips(s, d):
    return A.videos(s, d).where((F.size("energy_peaks") > 0) & F.col("energy_bucket").isNotNull() & ~T.tag(F.col("energy_bucket")).isin("low")).select("id", "path")


@_query("SELECT id, energy_version FROM videos WHERE energy_bucket IS NULL OR coalesce(energy_version, 0) <> 2", "videos")
def energy_stale(s, d):
    return energy.stale(A.videos(s, d)).select("id", "energy_version")


# sessions ---------------------------------------------------------------------------------------------------------

_GAP = 21_600.0


@_query(f"SELECT video_id, name, timestamp_sec FROM (SELECT video_id, name, timestamp_sec, lag(timestamp_sec) OVER (PARTITION BY video_id, name ORDER BY timestamp_sec) AS b FROM faces JOIN people USING (cluster_id)) WHERE b IS NULL OR timestamp_sec - b > {_GAP}", "faces", "people")
def appearances(s, d):
    return sessions.appearances(library.named(A.faces(s, d), A.people(s, d)), ["video_id", "name"], gap=_GAP)


_REEL = Sessions(merge_gap=_GAP, pad=900.0, min_length=3000.0)
_RANGES = f"""SELECT video_id, greatest(0, min(t) - 900) AS start, max(t) + 900 AS "end" FROM (SELECT video_id, t, sum(n) OVER (PARTITION BY video_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT video_id, timestamp_sec AS t, CASE WHEN timestamp_sec - lag(timestamp_sec) OVER (PARTITION BY video_id ORDER BY timestamp_sec) <= {_GAP} THEN 0 ELSE 1 END AS n FROM faces WHERE cluster_id = 0)) GROUP BY video_id, g HAVING max(t) + 900 - greatest(0, min(t) - 900) >= 3000"""


@_query(_RANGES, "faces")
def reel_segments(s, d):
    return sessions.ranges(A.faces(s, d).where("cluster_id = 0"), ["video_id"], p=_REEL)


@_query(f"""SELECT path, hits, start, "end" FROM ({_RANGES}) JOIN (SELECT video_id, count(*) AS hits FROM faces WHERE cluster_id = 0 GROUP BY video_id) USING (video_id) JOIN videos ON videos.id = video_id WHERE {_IN}""", "faces", "videos")
def reel_clips(s, d):
    who = library.search_person(A.faces(s, d), A.people(s, d), A.videos(s, d).where(P.under(F.col("path"), A.ROOTS)), "Ellie")
    return sessions.ranges(A.faces(s, d).where("cluster_id = 0"), ["video_id"], p=_REEL).join(who, "video_id").select("path", "hits", "start", "end")
