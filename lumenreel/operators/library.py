"""

Faces count only when they belong to a cluster: cluster_id null is not clustered yet, -1 is noise. Tables of people and hidden clusters
are joined as ordinary equi-joins; Spark broadcasts them while they are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T


def clustered(faces: DataFrame) -> DataFrame:
    return faces.where(F.col("cluster_id").isNotNull() & (F.col("cluster_id") >= 0))


def named(faces: DataFrame, people: DataFrame) -> DataFrame:
    return faces.join(people, "cluster_id")


def search_person(faces: DataFrame, people: DataFrame, videos: DataFrame, name: str) -> DataFrame:
    """(video_id, path, hits) of the clips that show a person."""
    hits = named(faces, people.where(F.col("name") == name)).groupBy("video_id").agg(F.count("*").alias("hits"))
    return hits.join(videos.select(F.col("id").alias("video_id"), "path"), "video_id").select("video_id", "path", "hits")


def cluster_summary(faces: DataFrame, people: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """(cluster_id, n, name)."""
    n = clustered(faces).groupBy("cluster_id").agg(F.count("*").alias("n"))
    n = n if hidden is None else n.join(hidden, "cluster_id", "left_anti")
    return n.join(people, "cluster_id", "left").select("cluster_id", "n", "name")


def cluster_summary_with_paths(faces: DataFrame, people: DataFrame, videos: DataFrame, hidden: DataFrame | None = None, roots: list[str] | None = None) -> DataFrame:
    """(cluster_id, n, name, paths): clusters with any clip in scope, and all their clips."""
    seen = clustered(faces).select("cluster_id", "video_id").distinct().join(videos.select(F.col("id").alias("video_id"), "path"), "video_id")
    per = seen.groupBy("cluster_id").agg(F.sort_array(F.collect_set("path")).alias("paths"), F.max(P.under(F.col("path"), roots)).alias("_in")).where("_in").drop("_in")
    return cluster_summary(faces, people, hidden).join(per, "cluster_id")


def labeler_view(summary: DataFrame, least: int = 3) -> DataFrame:
    """summary with its view: needs a name (unnamed and large enough), labeled, or other."""
    has = F.col("name").isNotNull() & (F.col("name") != "")
    return summary.withColumn("view", F.when(has, "labeled").when(F.col("n") >= least, "needs").otherwise("other"))


def totals(videos: DataFrame, faces: DataFrame, people: DataFrame) -> DataFrame:
    """One row for the whole library: named counts the rows of people."""
    f = faces.agg(F.count("*").alias("faces"), F.count_distinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("clusters"))
    return videos.agg(F.count("*").alias("videos")).join(f).join(people.agg(F.count("*").alias("named")))


def batch_totals(videos: DataFrame, faces: DataFrame, people: DataFrame, roots: list[str] | None) -> DataFrame:
    """One row for a batch: named counts the distinct names seen in it."""
    v = videos.where(P.under(F.col("path"), roots)).select(F.col("id").alias("video_id"))
    f = faces.join(v, "video_id", "left_semi").join(people, "cluster_id", "left")
    out = f.agg(F.count("*").alias("faces"), F.count_distinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("clusters"), F.count_distinct("name").alias("named"))
    return v.agg(F.count("*").alias("videos")).join(out)


def person_rollup(faces: DataFrame, people: DataFrame) -> DataFrame:
    """(name, cluster_id, clips, faces): the least cluster id stands for a name."""
    return named(faces, people).groupBy("name").agg(F.min("cluster_id").alias("cluster_id"), F.count_distinct("video_id").alias("clips"), F.count("*").alias("faces"))


def person_times(faces: DataFrame, people: DataFrame) -> DataFrame:
    """(name, video_id, times array): sorted times."""
    return named(faces, people).groupBy("name", "video_id").agg(F.sort_array(F.collect_list("timestamp_sec")).alias("times"))


def clip_names(faces: DataFrame, people: DataFrame, videos: DataFrame) -> DataFrame:
    """(path, name), each pair once."""
    pairs = named(faces, people).select("video_id", "name").distinct()
    return pairs.join(videos.select(F.col("id").alias("video_id"), "path"), "video_id").select("path", "name").distinct()


def videos_with_names(faces: DataFrame, people: DataFrame, videos: DataFrame) -> DataFrame:
    return clip_names(faces, people, videos).groupBy("path").agg(F.sort_array(F.collect_set("name")).alias("names"))


def keywords(faces: DataFrame, people: DataFrame, videos: DataFrame, auto_tags: DataFrame, exclude_tags: list[str] = (), with_energy: bool = True, exclude_energy: list[str] = ()) -> DataFrame:
    """(path, keywords sorted): names, tags and '<bucket> energy' of each clip, without the excluded ones (any case)."""
    v = videos.select(F.col("id").alias("video_id"), "path", "energy_bucket")
    lower = [t.strip().lower() for t in exclude_tags]
    parts = clip_names(faces, people, videos).withColumnRenamed("name", "k")
    parts = parts.unionByName(auto_tags.where(~T.tag(F.col("tag")).isin(lower)).join(v, "video_id").select("path", F.col("tag").alias("k")))
    if with_energy:
        some = F.col("energy_bucket").isNotNull() & (F.col("energy_bucket") != "") & ~T.tag(F.col("energy_bucket")).isin([b.strip().lower() for b in exclude_energy])
        parts = parts.unionByName(v.where(some).select("path", F.concat("energy_bucket", F.lit(" energy")).alias("k")))
    return parts.groupBy("path").agg(F.sort_array(F.collect_set("k")).alias("keywords"))


def merged_keywords(in_file: Column, ours_before: Column, ours_now: Column) -> Column:
    """What a file should hold: a person's own words, and ours as they are now. A read that failed must not arrive here as an empty list."""
    return F.array_sort(F.array_union(F.array_except(in_file, ours_before), ours_now))


def merge_map(faces: DataFrame, people: DataFrame) -> DataFrame:
    """(cluster_id, into, name): clusters whose names are equal but for case and space, and the one with most faces, whose spelling wins."""
    n = people.join(faces.groupBy("cluster_id").agg(F.count("*").alias("n")), "cluster_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("k", T.tag(F.col("name"))).where("k != ''")
    best = n.groupBy("k").agg(F.min(F.struct((-F.col("n")).alias("neg"), "name", "cluster_id")).alias("b"), F.count("*").alias("times")).where("times > 1")
    return n.join(best, "k").select("cluster_id", F.col("b.cluster_id").alias("into"), F.col("b.name").alias("name"))


def merge_people(faces: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """faces and people after the merge; a second merge changes nothing."""
    m = merge_map(faces, people)
    moved = m.select("cluster_id", "into")
    f = faces.join(moved, "cluster_id", "left").withColumn("cluster_id", F.coalesce("into", "cluster_id")).select(faces.columns)
    p = people.join(m.where("cluster_id != into").select("cluster_id"), "cluster_id", "left_anti")
    return f, p


def known_names(people: DataFrame) -> DataFrame:
    """(name): trimmed, once each whatever the case, the spelling of the least cluster id."""
    t = people.select("cluster_id", T.strip(F.col("name")).alias("name")).where("name != ''")
    return t.groupBy(F.lower("name").alias("k")).agg(F.min_by("name", "cluster_id").alias("name")).select("name")


def vocabulary(videos: DataFrame, roots: list[str] | None = None) -> DataFrame:
    """(tag): batch tags of the clips in scope, of the whole library if those have none."""
    each = videos.select(P.under(F.col("path"), roots).alias("inside"), F.explode("batch_tags").alias("tag")).select("inside", T.tag(F.col("tag")).alias("tag")).where("tag != ''")
    per = each.groupBy("tag").agg(F.max("inside").alias("inside"))
    any_inside = per.agg(F.coalesce(F.max("inside"), F.lit(False)).alias("some"))
    return per.join(F.broadcast(any_inside)).where(F.col("inside") | ~F.col("some")).select("tag")


def tag_clips(auto_tags: DataFrame, videos: DataFrame, tag: str, roots: list[str] | None = None) -> DataFrame:
    """(path, score at 3 places) of a tag's clips; order by score, path for the weakest first."""
    a = auto_tags.where(F.lower("tag") == tag.strip().lower())
    v = videos.where(P.under(F.col("path"), roots)).select(F.col("id").alias("video_id"), "path")
    return a.join(v, "video_id").select("path", F.bround("score", 3).alias("score"))


def tags_by_clip(auto_tags: DataFrame, videos: DataFrame) -> DataFrame:
    """(path, tags): best first."""
    rows = auto_tags.join(videos.select(F.col("id").alias("video_id"), "path"), "video_id")
    return rows.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "tag"))), lambda x: x["tag"]).alias("tags"))


def energy_groups(videos: DataFrame, thumbs: int = 4) -> DataFrame:
    """(bucket, rank, clips, sample, thumbs): high, medium, low, with their best clips."""
    rank = F.when(F.col("energy_bucket") == "high", 1).when(F.col("energy_bucket") == "medium", 2).otherwise(3)
    r = F.row_number().over(Window.partitionBy("energy_bucket").orderBy(F.desc("energy_score"), "path"))
    some = videos.where("energy_bucket is not null and energy_bucket != ''")
    best = some.withColumn("_r", r).where(F.col("_r") <= thumbs).groupBy("energy_bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "path"))), lambda x: x["path"]).alias("thumbs"))
    return some.groupBy("energy_bucket").agg(F.count("*").alias("clips")).join(best, "energy_bucket").select(F.col("energy_bucket").alias("bucket"), rank.alias("rank"), "clips", F.col("thumbs")[0].alias("sample"), "thumbs")


def report(faces: DataFrame, people: DataFrame, videos: DataFrame, auto_tags: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """A row a clip: file, folder, people, tags, energy, score, peaks, keywords."""
    people_of = videos_with_names(faces, people, videos).select("path", F.array_join("names", "; ").alias("people"))
    tags_of = tags_by_clip(auto_tags, videos).select("path", F.array_join("tags", "; ").alias("tags"))
    return videos.join(people_of, "path", "left").join(tags_of, "path", "left").select(
        "path", P.basename(F.col("path")).alias("file"), P.parent(F.col("path")).alias("folder"), F.coalesce("people", F.lit("")).alias("people"), F.coalesce("tags", F.lit("")).alias("tags"),
        F.coalesce("energy_bucket", F.lit("")).alias("energy"), F.coalesce(F.size("energy_peaks"), F.lit(0)).alias("peaks"), F.coalesce(F.array_join("written_keywords", "; "), F.lit("")).alias("keywords"),
    )


def library_search(clips: DataFrame, query: str) -> DataFrame:
    """Clips(path, keywords) whose file name or any keyword holds the query, any case; a blank query finds all."""
    q = query.strip().lower()
    return clips if not q else clips.where(F.lower(P.basename(F.col("path"))).contains(q) | F.exists("keywords", lambda k: F.lower(k).contains(q)))


def capped(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first rows in an order, with the true total beside them."""
    return df.orderBy(*order).limit(most).join(F.broadcast(df.agg(F.count("*").alias("total"))))


def people_search(faces: DataFrame, people: DataFrame, videos: DataFrame, clips: DataFrame, query: str) -> DataFrame:
    """(name): people whose name holds the query or who are in a clip that library_search finds."""
    q = query.strip().lower()
    seen = clip_names(faces, people, videos).join(library_search(clips, query).select("path"), "path", "left_semi").select("name")
    return people.where(F.lower("name").contains(q)).select("name").union(seen).distinct()


def representatives(faces: DataFrame, n: int = 9, seed: str = "0") -> DataFrame:
    """n faces of each cluster, drawn by a hash of id and seed that any engine can compute."""
    draw = F.md5(F.concat(F.col("id").cast("string"), F.lit(":" + seed)))
    r = F.row_number().over(Window.partitionBy("cluster_id").orderBy("_draw", "id"))
    return clustered(faces).withColumn("_draw", draw).withColumn("rank", r).where(F.col("rank") <= n).drop("_draw")


def mode(df: DataFrame, value: list[str], order: str) -> DataFrame:
    """The most frequent value; of equals the one that comes first in the order."""
    return df.groupBy(*value).agg(F.count("*").alias("n"), F.min(order).alias("_first")).orderBy(F.desc("n"), "_first").limit(1).select(*value, "n")


def scan_plan(listing: DataFrame, videos: DataFrame) -> DataFrame:
    """listing(path, real_path, on_disk) -> (path, action): the first path of each real file: done, backfill (no embeddings yet), rescan (incomplete), new,
    or away (not on disk)."""
    first = listing.groupBy("real_path").agg(F.min_by(F.struct("path", "on_disk"), "path").alias("f")).select("f.path", "f.on_disk")
    seen = first.join(videos.select("path", "scan_complete", "has_embeddings"), "path", "left")
    return seen.select("path", F.when(~F.col("on_disk"), "away").when(F.col("scan_complete").isNull(), "new").when(~F.col("scan_complete"), "rescan").when(~F.col("has_embeddings"), "backfill").otherwise("done").alias("action"))


def failures(results: DataFrame) -> DataFrame:
    """results(failed) -> one row: total, failed, ok, partial (some failed and some not)."""
    t = results.agg(F.count("*").alias("total"), F.count_if("failed").alias("failed"))
    return t.select("total", "failed", (F.col("total") - F.col("failed")).alias("ok"), F.col("failed").between(1, F.col("total") - 1).alias("partial"))


def existence(videos: DataFrame, faces: DataFrame, frames: DataFrame, version: int) -> DataFrame:
    """(id, scanned, clustered, embedded, energy, current): what there is of each clip, by semi-joins on the distinct ids of each side."""
    some = lambda df, name: df.select(F.col("video_id").alias("id")).distinct().withColumn(name, F.lit(True))
    known = videos.join(some(clustered(faces), "_c"), "id", "left").join(some(frames, "_e"), "id", "left")
    has = F.col("energy_bucket").isNotNull()
    return known.select("id", F.coalesce("scan_complete", F.lit(False)).alias("scanned"), F.col("_c").isNotNull().alias("clustered"), F.col("_e").isNotNull().alias("embedded"), has.alias("energy"), (has & F.coalesce(F.col("energy_version") == version, F.lit(False))).alias("current"))


def tagged_totals(videos: DataFrame, tagged: DataFrame) -> DataFrame:
    """One row on a tagging run: total clips, tagged clips, and the first tagged path's file and tags (best first; null if there is none)."""
    per = tags_by_clip(tagged, videos)
    first = per.agg(F.count("*").alias("tagged"), F.min_by(F.struct(P.basename(F.col("path")).alias("file"), "tags"), "path").alias("s"))
    return videos.agg(F.count("*").alias("total")).join(F.broadcast(first)).select("total", "tagged", F.col("s.file").alias("file"), F.col("s.tags").alias("tags"))


def undeclared(emitted: DataFrame, declared: DataFrame) -> DataFrame:
    """(event): events that are emitted and not declared, once each."""
    return emitted.select("event").distinct().join(declared.select("event"), "event", "left_anti")


def need_embedding(videos: DataFrame, frames: DataFrame) -> DataFrame:
    """(id, path) of clips without any frame embedding."""
    return videos.join(frames.select(F.col("video_id").alias("id")), "id", "left_anti").select("id", "path")


def labeler_search(summary: DataFrame, query: str) -> DataFrame:
    """Clusters of a summary(cluster_id, n, name) whose number or name holds the query, any case."""
    q = query.strip().lower()
    return summary.where(F.col("cluster_id").cast("string").contains(q) | F.lower("name").contains(q))


def view_counts(views: DataFrame) -> DataFrame:
    """(view, clusters) of a labeler_view."""
    return views.groupBy("view").agg(F.count("*").alias("clusters"))


def scoped_representatives(faces: DataFrame, videos: DataFrame, roots: list[str] | None, n: int = 9, seed: str = "0") -> DataFrame:
    """n faces of each cluster from clips in scope; of a cluster that has none there, from all clips."""
    inside = videos.select(F.col("id").alias("video_id"), P.under(F.col("path"), roots).alias("_in"))
    marked = clustered(faces).join(inside, "video_id", "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    some = marked.groupBy("cluster_id").agg(F.max("_in").alias("_some"))
    return representatives(marked.join(some, "cluster_id").where(F.col("_in") | ~F.col("_some")).drop("_in", "_some"), n, seed)
