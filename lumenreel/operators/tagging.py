"""Selection of tags from long clip-by-tag scores (video_id, tag, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import Tagging
from . import state, vectors


def relative_keep(scores: DataFrame, p: Tagging = Tagging()) -> DataFrame:
    """Rows that pass the floor, stand out among their tag's clips, and stand out in their clip or are strong; then at most a share of
    the clips per tag, the best first. With fewer than three clips only the floor counts.

    The per-tag cut is a mean and deviation that are aggregated (map side first) and joined back, not a window over a tag's clips; the per-clip median
    is a window over one clip's tags."""
    n = scores.select(F.count_distinct("video_id").alias("n"))
    tags = scores.groupBy("tag").agg((F.avg("score") + p.k_tag * F.stddev_pop("score")).alias("tag_cut"))
    clip_cut = F.median("score").over(Window.partitionBy("video_id")) + p.clip_margin
    rows = scores.withColumn("clip_cut", clip_cut).join(tags, "tag").join(F.broadcast(n))
    out = (F.col("score") >= F.col("tag_cut")) & ((F.col("score") >= F.col("clip_cut")) | (F.col("score") >= p.strong))
    kept = rows.where((F.col("score") >= p.floor) & ((F.col("n") < 3) | out))
    return _best_share(kept, p.max_coverage).select("video_id", "tag", "score")


def _best_share(kept: DataFrame, share: float, bins: int = 4096) -> DataFrame:
    """Of each tag's rows (n: the number of clips) the best floor(n * share), one at least; all, if n < 3. Ties go to the smaller video_id.

    Scores are counted by tag and bin first, so only the rows of the bin in which a tag's limit falls are ranked together; rows of other
    bins stay or go by their bin and are dealt out by clip."""
    row = kept.withColumn("_bin", F.floor(F.col("score") * bins).cast("long")).withColumn("_most", F.greatest(F.lit(1), F.floor(F.col("n") * share)).cast("long"))
    counts = row.groupBy("tag", "_bin", "_most").agg(F.count("*").alias("_c"))
    above = F.sum("_c").over(Window.partitionBy("tag").orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1))
    edge = counts.withColumn("_above", F.coalesce(above, F.lit(0))).where((F.col("_above") < F.col("_most")) & (F.col("_above") + F.col("_c") >= F.col("_most"))).select("tag", F.col("_bin").alias("_edge"), "_above")
    known = row.join(edge, "tag", "left")
    on = F.coalesce(F.col("_bin") == F.col("_edge"), F.lit(False))
    w = Window.partitionBy("tag", F.when(on, -1).otherwise(F.pmod(F.xxhash64("video_id"), F.lit(1024)))).orderBy(F.desc("score"), "video_id")
    stays = F.col("_edge").isNull() | (F.col("_bin") > F.col("_edge")) | (on & (F.col("_above") + F.col("_r") <= F.col("_most")))
    return known.withColumn("_r", F.row_number().over(w)).where((F.col("n") < 3) | stays)


def absolute_keep(scores: DataFrame, p: Tagging = Tagging()) -> DataFrame:
    """Rows at the threshold and a margin over their clip's median at least."""
    m = F.median("score").over(Window.partitionBy("video_id"))
    return scores.withColumn("_m", m).where((F.col("score") >= p.threshold) & (F.col("score") >= F.col("_m") + p.margin)).select("video_id", "tag", "score")


def top_per_clip(scores: DataFrame, k: int = Tagging.top, order: str = "tag") -> DataFrame:
    """A clip's k best tags; equal scores in the order given."""
    r = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("score"), order))
    return scores.withColumn("rank", r).where(F.col("rank") <= k)


def auto_tags(scores: DataFrame, p: Tagging = Tagging(), relative: bool = True, k: int | None = None) -> DataFrame:
    """(video_id, tag, score) of the tags each clip gets."""
    kept = relative_keep(scores, p) if relative else absolute_keep(scores, p)
    return top_per_clip(kept, k or p.top).select("video_id", "tag", "score")


def every_tag(videos: DataFrame, tags: DataFrame) -> DataFrame:
    """What is left without a model, on request only: each typed tag on each clip at score 1. Tags are a person's typed list; they are counted first."""
    n = tags.count()
    if n > 10_000:
        raise ValueError(f"{n} typed tags")
    return videos.select(F.col("id").alias("video_id"), F.explode(F.array(*[F.lit(r["tag"]) for r in tags.select("tag").distinct().collect()])).alias("tag")).withColumn("score", F.lit(1.0))


def rollup(tagged: DataFrame, shown: int = 6) -> DataFrame:
    """(tag, clips, peak, sample, weakest array): per tag its clips, best score, best clip, and its weakest clips in rising order."""
    sized = tagged.groupBy("tag").agg(F.count("*").alias("clips"), F.bround(F.max("score"), 3).alias("peak"), F.min(F.struct((-F.col("score")).alias("s"), "path")).alias("_best"))
    r = F.row_number().over(Window.partitionBy("tag").orderBy("score", "path"))
    weak = tagged.withColumn("_r", r).where(F.col("_r") <= shown).groupBy("tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("score", "path"))), lambda x: x["path"]).alias("weakest"))
    return sized.join(weak, "tag").select("tag", "clips", "peak", F.col("_best.path").alias("sample"), "weakest")


def rest(tagged: DataFrame, shown: int = 6) -> DataFrame:
    """(tag, path) of the clips that a rollup doesn't show."""
    weak = rollup(tagged, shown).select("tag", F.explode("weakest").alias("path"))
    return tagged.select("tag", "path").join(weak, ["tag", "path"], "left_anti")


def tag_run(frames: DataFrame, prompts: DataFrame, stored: DataFrame, p: Tagging = Tagging(), relative: bool = True) -> DataFrame:
    """The stored auto tags(video_id, tag, score) after a run: clips that have frames get the tags that their scores give them, in place of
    what they had; other clips keep theirs."""
    new = auto_tags(vectors.frame_scores(frames, prompts), p, relative)
    return state.replace_by(stored, new, frames.select("video_id"), "video_id")
