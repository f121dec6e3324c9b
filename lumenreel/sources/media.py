"""Media files and what probes say of them. Listing is Spark's; probing and decoding call the tools ffprobe and ffmpeg from workers, which must have them.

Parsing is in column functions over the probes' JSON, so it is tested without the tools. A probe that fails gives an error column, never an empty answer.
"""

from __future__ import annotations

import json
import shutil
import subprocess
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import numbers as N
from ..functions import paths as P
from ..functions import text as T
from ..operators.library import need_embedding
from ..operators.vectors import ensemble
from ..params import Media, Timeline

PROBE = "struct<streams:array<struct<codec_type:string,codec_tag_string:string,width:int,height:int,duration:string,nb_frames:string,r_frame_rate:string,avg_frame_rate:string,side_data_list:array<struct<rotation:string>>,tags:struct<rotate:string,timecode:string>>>,format:struct<duration:string,tags:struct<timecode:string>>>"


def walk(spark: SparkSession, root: str, p: Media = Media()) -> DataFrame:
    """(path, length, modified) of the video files under a folder, or of the file that root is. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    return files.select(path.alias("path"), "length", F.col("modificationTime").alias("modified")).where(P.is_kind(F.col("path"), p.video))


def camera_raw(paths: DataFrame, p: Media = Media()) -> DataFrame:
    """(suffix): the camera-raw endings among paths(path)."""
    return paths.select(P.suffix(F.col("path")).alias("suffix")).where(F.col("suffix").isin(*p.camera_raw)).distinct()


def stat(paths: DataFrame) -> DataFrame:
    """(path, size, blocks, dev, ino, on_disk) from the workers' filesystem."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for b in batches:
            rows = []
            for path in b["path"]:
                try:
                    s = os.stat(path)
                    rows.append((path, s.st_size, s.st_blocks, s.st_dev, s.st_ino, True))
                except OSError:
                    rows.append((path, None, None, None, None, False))
            yield pd.DataFrame(rows, columns=["path", "size", "blocks", "dev", "ino", "on_disk"]).astype({"size": "Int64", "blocks": "Int64", "dev": "Int64", "ino": "Int64"})

    return paths.select("path").mapInPandas(run, "path string, size long, blocks long, dev long, ino long, on_disk boolean")


def not_downloaded(stats: DataFrame, listing: DataFrame) -> DataFrame:
    """(path) of stats whose data isn't here: a size without blocks, or no file but a placeholder '.<name>.icloud' beside it in listing(path)."""
    p = F.col("path")
    empty = stats.where((F.col("size") > 0) & (F.col("blocks") == 0)).select("path")
    mark = F.concat(P.parent(p), F.lit("/."), P.basename(p), F.lit(".icloud"))
    gone = stats.where(~F.col("on_disk")).withColumn("_m", mark).join(listing.select(F.col("path").alias("_m")).distinct(), "_m", "left_semi").select("path")
    return empty.union(gone).distinct()


def probe(paths: DataFrame, tools: str | None = None) -> DataFrame:
    """(path, json, error) by ffprobe, from the folder tools or the path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = shutil.which("ffprobe", path=tools)
        for b in batches:
            rows = []
            for path in b["path"]:
                if tool is None:
                    rows.append((path, None, "ffprobe is not installed"))
                    continue
                r = subprocess.run([tool, "-v", "error", "-show_streams", "-show_format", "-of", "json", path], capture_output=True, text=True)
                rows.append((path, r.stdout if r.returncode == 0 else None, None if r.returncode == 0 else r.stderr[:500]))
            yield pd.DataFrame(rows, columns=["path", "json", "error"])

    return paths.select("path").mapInPandas(run, "path string, json string, error string")


def probed(answers: DataFrame, p: Media = Media()) -> DataFrame:
    """answers(path, json) -> (path, duration, width, height, rate, picture_sec, timecode, timecode_rate). A quarter turn swaps the sides; a side-data rotation
    counts before the tag; rates fall back to p.fallback_rate; picture_sec is frames over average rate, else the stream's, else the container's duration."""
    j = F.from_json("json", PROBE)
    v = F.try_element_at(F.filter(j["streams"], lambda s: s["codec_type"] == "video"), F.lit(1))
    data = F.try_element_at(F.filter(j["streams"], lambda s: s["codec_tag_string"] == "tmcd"), F.lit(1))
    angle = F.coalesce(F.try_element_at(F.filter(F.transform(v["side_data_list"], lambda x: x["rotation"].try_cast("double")), lambda x: x.isNotNull()), F.lit(1)), v["tags"]["rotate"].try_cast("double"), F.lit(0.0))
    turned = F.abs(angle).cast("int") % 180 == 90
    w, h = F.coalesce(v["width"], F.lit(p.fallback_size[0])), F.coalesce(v["height"], F.lit(p.fallback_size[1]))
    rate = F.coalesce(N.ratio(v["r_frame_rate"]), F.lit(p.fallback_rate))
    stream, whole = v["duration"].try_cast("double"), j["format"]["duration"].try_cast("double")
    picture = F.coalesce(F.try_divide(v["nb_frames"].try_cast("double"), N.ratio(v["avg_frame_rate"])), stream, whole, F.lit(0.0))
    code = F.coalesce(data["tags"]["timecode"], v["tags"]["timecode"], j["format"]["tags"]["timecode"])
    code_rate = F.when(data["tags"]["timecode"].isNotNull(), F.coalesce(N.ratio(data["r_frame_rate"]), N.ratio(data["avg_frame_rate"]))).otherwise(rate)
    return answers.select("path", F.coalesce(whole, stream, F.lit(0.0)).alias("duration"), F.when(turned, h).otherwise(w).alias("width"), F.when(turned, w).otherwise(h).alias("height"), rate.alias("rate"), picture.alias("picture_sec"), code.alias("timecode"), F.coalesce(code_rate, rate).alias("timecode_rate"))


def quality(frames: DataFrame, clips: DataFrame, fps: float = 1.0) -> DataFrame:
    """(path, got, expected, short) after sampling: fewer than two thirds of the frames that a clip's duration promises."""
    got = frames.groupBy("path").agg(F.count("*").alias("got"))
    want = F.greatest(F.lit(1), F.floor(F.col("duration") * fps))
    return clips.join(got, "path", "left").select("path", F.coalesce("got", F.lit(0)).alias("got"), want.alias("expected"), (F.coalesce("got", F.lit(0)) < 0.66 * want).alias("short"))


def keywords_read(answers: DataFrame) -> DataFrame:
    """answers(path, json, error) of a metadata reader -> (path, keywords, status). A failed read has status 'error' and null keywords, which a merge must not
    take for none."""
    j = F.from_json("json", "array<struct<Subject:string,Keywords:string,subject_list:array<string>>>")[0]
    listed = F.coalesce(F.from_json(F.get_json_object("json", "$[0].Subject"), "array<string>"), F.when(j["Subject"].isNotNull(), F.array(j["Subject"])), F.array().cast("array<string>"))
    commas = F.coalesce(T.from_commas(j["Keywords"]), F.array().cast("array<string>"))
    ok = F.col("error").isNull() & F.col("json").isNotNull()
    return answers.select("path", F.when(ok, F.array_union(listed, commas)).alias("keywords"), F.when(ok, "ok").otherwise("error").alias("status"))


def marker_structs(raw: Column) -> Column:
    """'{Name=a,StartTime=1},...' as an array of maps, those with a Name."""
    each = F.transform(F.regexp_extract_all(raw, F.lit(r"\{([^}]*)\}"), F.lit(1)), lambda x: F.str_to_map(x, F.lit(","), F.lit("=")))
    return F.filter(each, lambda m: F.map_contains_key(m, "Name"))


def finder_tag(entry: Column) -> Column:
    """A stored tag without its color."""
    return F.split_part(entry, F.lit("\n"), F.lit(1))


EVENT = "__EVENT__ "
#: Seconds of sound in a row.
SECONDS = 60


def event_lines(lines: DataFrame, schema: str, prefix: str = EVENT) -> DataFrame:
    """Text lines(value) with the prefix as structs; a line that can't be read gives null."""
    return lines.where(F.col("value").startswith(prefix)).select(F.from_json(F.substr("value", F.lit(len(prefix) + 1)), schema).alias("event"))


class _Clip(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FrameReader(DataSourceReader):
    """Frames of clips by ffmpeg, one clip a partition. Options: paths (JSON list), fps, longest side, gray, tools (a folder on the workers that
    holds ffmpeg and ffprobe; else they are looked for on the path)."""

    def __init__(self, options):
        self.paths = json.loads(options.get("paths", "[]"))
        self.fps, self.side = float(options.get("fps", 1.0)), int(options.get("side", Media.longest_side))
        self.gray = options.get("gray", "false").lower() == "true"
        self.tools = options.get("tools") or None

    def partitions(self):
        return [_Clip(p) for p in self.paths] or [_Clip("")]

    def read(self, partition):
        if not partition.path:
            return
        tool, ask = shutil.which("ffmpeg", path=self.tools), shutil.which("ffprobe", path=self.tools)
        if tool is None or ask is None:
            raise RuntimeError("ffmpeg and ffprobe must be installed on the workers")
        shown = json.loads(subprocess.run([ask, "-v", "error", "-select_streams", "v:0", "-show_streams", "-show_format", "-of", "json", partition.path], capture_output=True, text=True, check=True).stdout)
        v = shown["streams"][0]
        turn = next((abs(int(float(x["rotation"]))) for x in v.get("side_data_list", []) if "rotation" in x), abs(int(float(v.get("tags", {}).get("rotate", 0)))))
        w, h = (v["height"], v["width"]) if turn % 180 == 90 and not self.gray else (v["width"], v["height"])
        k = min(1.0, self.side / max(w, h))
        w, h = (round(w * k) - round(w * k) % 2, round(h * k) - round(h * k) % 2)
        depth, duration = 1 if self.gray else 3, float(shown["format"].get("duration", 0))
        run = subprocess.Popen([tool, "-v", "error", "-i", partition.path, "-vf", f"fps={self.fps},scale={w}:{h}", "-f", "rawvideo", "-pix_fmt", "gray" if self.gray else "bgr24", "-"], stdout=subprocess.PIPE)
        try:
            i = 0
            while len(raw := run.stdout.read(w * h * depth)) == w * h * depth and i / self.fps <= duration + 1:
                yield partition.path, i, i / self.fps, h, w, raw
                i += 1
        finally:
            run.kill()
            run.wait()


class FrameSource(DataSource):
    @classmethod
    def name(cls):
        return "clipframes"

    def schema(self):
        return "path string, frame int, t double, h int, w int, pixels binary"

    def reader(self, schema):
        return FrameReader(self.options)


def sound_levels(pcm: DataFrame, rate: int = 16_000) -> DataFrame:
    """pcm(path, samples binary of little-endian int16, begin: the row's first second, 0 if there is no such column) -> (path, sec, db) of each full second."""
    begin = F.col("begin") if "begin" in pcm.columns else F.lit(0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, at, raw in zip(b["path"], b["begin"], b["samples"], strict=True):
                x = np.frombuffer(raw, "<i2").astype(np.float64) / 32768
                n = len(x) // rate
                ms = (x[: n * rate].reshape(n, rate) ** 2).mean(1) if n else np.zeros(0)
                yield pd.DataFrame({"path": path, "sec": at + np.arange(n, dtype=np.int32), "db": 20 * np.log10(np.sqrt(ms + 1e-12) + 1e-9)})

    return pcm.select("path", begin.alias("begin"), "samples").mapInPandas(run, "path string, sec int, db double")


def timeline_clips(meta: DataFrame, p: Timeline = Timeline()) -> DataFrame:
    """probed() rows as the timeline's clips(path, fps, duration) with their start."""
    return meta.select("path", F.col("rate").alias("fps"), F.col("picture_sec").alias("duration"), F.when(F.col("timecode").isNull(), F.lit(0.0)).otherwise(N.timecode_seconds(F.col("timecode"), F.col("timecode_rate"))).alias("start_sec"))


def detect(frames: DataFrame, model, schema: str = "path string, t double, x int, y int, w int, h int, score double, embedding array<float>", least: float = 0.5) -> DataFrame:
    """Faces of frames by a model that the caller supplies: model() is called once a worker and returns a function from a frame's array to
    rows (x, y, w, h, score, embedding). Weak ones go, boxes are one pixel at least, embeddings of unit length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = model()
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                for x, y, w, h, score, e in find(np.frombuffer(r.pixels, np.uint8).reshape(r.h, r.w, -1)):
                    e = np.asarray(e, np.float32)
                    n = float(np.linalg.norm(e))
                    if score >= least:
                        rows.append((r.path, r.t, int(x), int(y), max(1, int(w)), max(1, int(h)), float(score), (e / n if n > 0 else e).tolist()))
            yield pd.DataFrame(rows, columns=["path", "t", "x", "y", "w", "h", "score", "embedding"])

    return frames.mapInPandas(run, schema)


def next_frames(frames: DataFrame, size: bool = False) -> DataFrame:
    """Pairs of neighbouring frames of a clip: (path, t, before, pixels), with h and w if size is set."""
    w = Window.partitionBy("path").orderBy("t")
    return frames.withColumn("before", F.lag("pixels").over(w)).where("before is not null").select("path", "t", *(["h", "w"] if size else []), "before", "pixels")


def encode_frames(frames: DataFrame, model, key: str = "path") -> DataFrame:
    """(key, t, embedding) of frames(key, t, h, w, pixels) by an image encoder that the caller supplies: model() is called once a worker and returns a
    function from a list of arrays to rows of a matrix; vectors of unit length."""
    kind = dict(frames.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = model()
        for b in batches:
            x = np.asarray(encode([np.frombuffer(p, np.uint8).reshape(h, w, -1) for p, h, w in zip(b["pixels"], b["h"], b["w"], strict=True)]), np.float32)
            yield pd.DataFrame({key: b[key], "t": b["t"], "embedding": list(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8))})

    return frames.select(key, "t", "h", "w", "pixels").mapInPandas(run, f"{key} {kind}, t double, embedding array<float>")


def encode_texts(tags: DataFrame, model) -> DataFrame:
    """tags(tag) -> (tag, prompt): the mean unit vector of a tag's sentences, by a text encoder that the caller supplies, called as in encode_frames with
    a list of texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = model()
        for b in batches:
            x = np.asarray(encode(b["text"].tolist()), np.float64)
            yield pd.DataFrame({"tag": b["tag"], "embedding": list(x)})

    each = tags.select("tag", F.explode(T.prompts(F.col("tag"))).alias("text")).mapInPandas(run, "tag string, embedding array<double>")
    return ensemble(each, ["tag"], "embedding").withColumnRenamed("embedding", "prompt")


def backfill(videos: DataFrame, stored: DataFrame, frames_of, model) -> DataFrame:
    """stored(video_id, t, embedding) with the embeddings of clips that had none: frames_of(clips(id, path)) gives their frames(id, t, h, w, pixels)."""
    new = encode_frames(frames_of(need_embedding(videos, stored)), model, "id").withColumnRenamed("id", "video_id")
    return stored.unionByName(new)


def pictures(spark: SparkSession, paths: list[str], fps: float = 1.0, side: int = Media.longest_side, gray: bool = False, tools: str | None = None) -> DataFrame:
    """Frames of clips through the source clipframes: one clip a partition."""
    spark.dataSource.register(FrameSource)
    return spark.read.format("clipframes").option("paths", json.dumps(paths)).option("fps", fps).option("side", side).option("gray", str(gray).lower()).option("tools", tools or "").load()


def pcm(paths: DataFrame, rate: int = 16_000, tools: str | None = None) -> DataFrame:
    """(path, samples) of a clip's sound as mono little-endian int16 by ffmpeg, SECONDS at a time in whole seconds, so that sound_levels can take each row on its own;
    a clip without sound gives no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = shutil.which("ffmpeg", path=tools)
        if tool is None:
            raise RuntimeError("ffmpeg must be installed on the workers")
        for b in batches:
            for path in b["path"]:
                with subprocess.Popen([tool, "-v", "error", "-i", path, "-vn", "-ac", "1", "-ar", str(rate), "-f", "s16le", "-"], stdout=subprocess.PIPE) as p:
                    at = 0
                    while raw := p.stdout.read(2 * rate * SECONDS):
                        yield pd.DataFrame({"path": [path], "begin": [at], "samples": [raw]})
                        at += SECONDS

    return paths.select("path").mapInPandas(run, "path string, begin int, samples binary")
