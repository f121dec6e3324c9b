"""Timeline layout and marker exports. Positions are whole frames of one rate (num/den seconds a frame); seconds are derived.

A timeline is one ordered sequence; its running sum and its numbers come from ranges of the order that are summed on their own (in_order). An
export's text is one value: its lines are joined in parts, side by side, and one task joins the parts (one_text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import paths as P
from ..functions import text as T
from ..params import Energy, Timeline
from ..storage import in_order

#: Lines of an export that are joined at a time.
PART = 1 << 14


def timeline_rate(rates: DataFrame, p: Timeline = Timeline()) -> DataFrame:
    """rates(num, den, clips, first_path) -> one row (num, den): the fastest rate of the batch that all others divide, else the slowest standard
    rate that all divide, else the most frequent (of equals the first path's)."""
    known = rates.groupBy("num", "den").agg(F.sum("clips").alias("clips"), F.min("first_path").alias("first_path"))
    every = known.agg(F.collect_list(F.struct("num", "den")).alias("every")).where(F.size("every") > 0)  # one row, of the batch's different rates
    own = F.transform("every", lambda r: F.struct(r["num"].alias("num"), r["den"].alias("den"), F.lit(1).alias("tier"), (-r["den"] / r["num"]).alias("o")))
    std = F.array(*[F.struct(F.lit(n).alias("num"), F.lit(d).alias("den"), F.lit(2).alias("tier"), F.lit(d / n).alias("o")) for _, n, d in p.rates])
    all_fit = lambda c: F.forall("every", lambda r: N.divides(c["den"] / c["num"], r["den"] / r["num"]))
    fits = every.select(F.explode(F.filter(F.concat(own, std), all_fit)).alias("x")).select("x.*")
    usual = known.orderBy(F.desc("clips"), "first_path").limit(1).select("num", "den", F.lit(3).alias("tier"), F.lit(0.0).alias("o"))
    return fits.unionByName(usual).orderBy("tier", "o").limit(1).select("num", "den")


def clip_rates(clips: DataFrame, p: Timeline = Timeline()) -> DataFrame:
    """clips(path, fps) -> (num, den, clips, first_path)."""
    return clips.select("path", N.nearest_rate(F.col("fps"), p).alias("r")).groupBy("r.num", "r.den").agg(F.count("*").alias("clips"), F.min("path").alias("first_path"))


def layout(clips: DataFrame, markers: DataFrame, rate: DataFrame, p: Timeline = Timeline()) -> DataFrame:
    """clips(path, duration) -> (path, num, den, offset_frames, dur_frames): end to end by path. A clip of unknown length lasts a second past its
    last marker(path, t, label)."""
    last = markers.groupBy("path").agg(F.max("t").alias("last"))
    known = clips.join(last, "path", "left").withColumn("d", F.when(F.col("duration") > 0, F.col("duration")).otherwise(F.coalesce("last", F.lit(0.0)) + 1.0))
    sized = known.join(F.broadcast(rate)).withColumn("dur_frames", N.frames_needed(F.col("d"), F.col("num"), F.col("den"), p))
    return in_order(sized.select("path", "num", "den", "dur_frames"), ["path"], "dur_frames", "layout").select("path", "num", "den", F.col("_before").alias("offset_frames"), "dur_frames")


def clean_markers(markers: DataFrame, cap: int | None = None) -> DataFrame:
    """One marker of each (path, millisecond, label); with a cap, the first of each clip by time, and how many of the clip are left out."""
    one = markers.withColumn("ms", F.bround(F.col("t") * 1000).cast("bigint")).groupBy("path", "ms", "label").agg(F.min("t").alias("t"))
    if cap is None:
        return one.select("path", "t", "label")
    w = Window.partitionBy("path")
    return one.withColumn("_r", F.row_number().over(w.orderBy("t", "label"))).withColumn("dropped", F.greatest(F.lit(0), F.count(F.lit(1)).over(w) - cap)).where(F.col("_r") <= cap).select("path", "t", "label", "dropped")


def peak_markers(videos: DataFrame, p: Timeline = Timeline(), most: int = Energy.peak_max) -> DataFrame:
    """videos(path, energy_bucket, energy_peaks) -> (path, t, label): the first peaks of clips that have energy."""
    some = videos.where(F.col("energy_bucket").isNotNull())
    return some.select("path", F.explode(F.slice("energy_peaks", 1, most)).alias("t"), F.lit(p.peak_label).alias("label"))


def all_markers(named: DataFrame, peaks: DataFrame) -> DataFrame:
    """The markers(path, t, label) of both sources, each once; a clip of either source is on the timeline."""
    return named.select("path", "t", "label").unionByName(peaks.select("path", "t", "label")).distinct()


def foreign_markers(existing: DataFrame, own_names: DataFrame) -> DataFrame:
    """existing(path, t, label) that aren't ours; names are compared as they are written to disk."""
    ours = own_names.select(T.marker_name(F.col("name")).alias("_n")).distinct()
    return existing.join(ours, T.marker_name(F.col("label")) == F.col("_n"), "left_anti")


def color(label: Column, p: Timeline = Timeline()) -> Column:
    return F.when(label == p.peak_label, "Yellow").otherwise("Blue")


def placed(lay: DataFrame, markers: DataFrame) -> DataFrame:
    """Markers in timeline frames, kept inside their clip."""
    spf = F.col("num") / F.col("den")
    inside = F.least(F.col("t"), F.greatest(F.col("dur_frames") * spf - spf, F.lit(0.0)))
    return lay.join(markers, "path").withColumn("at", inside)


def edl_rows(lay: DataFrame, markers: DataFrame, p: Timeline = Timeline()) -> DataFrame:
    """(n, path, label, tc_in, tc_out, color)."""
    spf, num, den = F.col("num") / F.col("den"), F.col("num"), F.col("den")
    at = F.col("offset_frames") * spf + F.col("at")
    # a clip's events are numbered in the clip, after the events of the clips before it
    rows = placed(lay, markers).withColumn("_i", F.row_number().over(Window.partitionBy("path").orderBy("t", "label")))
    before = in_order(lay.select("path").join(markers.groupBy("path").agg(F.count("*").alias("c")), "path"), ["path"], "c", "events").select("path", "_before")
    rows = rows.join(before, "path").withColumn("n", F.col("_before") + F.col("_i"))
    return rows.select("n", "path", "label", N.timecode(N.frame(at, num, den), num, den).alias("tc_in"), N.timecode(N.frame(at + spf, num, den), num, den).alias("tc_out"), color(F.col("label"), p).alias("color"))


def text_parts(lines: DataFrame, part: int = PART) -> DataFrame:
    """lines(n, line), numbered from 1 without repeats -> (part, text): so many lines each, in order, with a line break between two."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy(F.floor((F.col("n") - 1) / part).alias("part")).agg(text.alias("text"))


def one_text(parts: DataFrame) -> DataFrame:
    """parts(part, text) -> (text): one row, the parts in order with a line break between two; no row without parts. The row is as long as its text, and no
    step after this one should copy it: a string of Spark holds 2 GB at most."""
    # concat_ws measures before it copies, array_join's buffer grows by doubling
    text = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]))
    return parts.groupBy(F.lit(0).alias("_all")).agg(text.alias("text")).select("text")


def edl(lay: DataFrame, markers: DataFrame, title: str = "Markers") -> DataFrame:
    """(text): the edit decision list; no row if there is no marker."""
    line = F.format_string("%03d  001      V     C        %s %s %s %s\n |C:ResolveColor%s |M:%s |D:1\n", "n", "tc_in", "tc_out", "tc_in", "tc_out", "color", T.edl_name(F.col("label")))
    head = F.lit(f"TITLE: {title}\nFCM: NON-DROP FRAME\n\n")
    return one_text(text_parts(edl_rows(lay, markers).select("n", F.when(F.col("n") == 1, F.concat(head, line)).otherwise(line).alias("line"))))


def fcpxml_times(lay: DataFrame, starts: DataFrame) -> DataFrame:
    """starts(path, start_sec: the start timecode) -> (path, offset, start, duration) as rational times."""
    num, den = F.col("num"), F.col("den")
    s = N.frame(F.coalesce("start_sec", F.lit(0.0)), num, den)
    return lay.join(starts, "path", "left").select("path", N.rational(F.col("offset_frames"), num, den).alias("offset"), N.rational(s, num, den).alias("start"), N.rational(F.col("dur_frames"), num, den).alias("duration"))


def fcpxml(lay: DataFrame, markers: DataFrame, starts: DataFrame, size: tuple[int, int] = (1920, 1080), title: str = "Markers") -> DataFrame:
    """(text): the timeline with its clips and markers; no row without clips."""
    num, den = F.col("num"), F.col("den")
    spf = num / den
    named = lay.join(starts, "path", "left").withColumn("start_sec", F.coalesce("start_sec", F.lit(0.0))).withColumn("name", T.xml(P.display_name(F.col("path"))))
    marks = placed(lay, markers).select("path", "t", "label", "at").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("t", "label", "at"))).alias("ms"))
    rows = in_order(named.join(marks, "path", "left"), ["path"], name="clips").withColumnRenamed("_n", "i")
    frame_at = lambda sec: N.rational(N.frame(sec, num, den), num, den)
    tick = N.rational(F.lit(1), num, den)
    inner = F.array_join(F.transform(F.coalesce("ms", F.array().cast("array<struct<t:double,label:string,at:double>>")), lambda m: F.concat(F.lit('\n        <marker start="'), frame_at(F.col("start_sec") + m["at"]), F.lit('" duration="'), tick, F.lit('" value="'), T.xml(m["label"]), F.lit('"/>'))), "")
    dur, off, start = N.rational(F.col("dur_frames"), num, den), N.rational(F.col("offset_frames"), num, den), frame_at(F.col("start_sec"))
    asset = F.concat(F.lit('    <asset id="a'), F.col("i").cast("string"), F.lit('" name="'), F.col("name"), F.lit('" start="'), start, F.lit('" duration="'), dur, F.lit('" hasVideo="1" hasAudio="1" format="r0"><media-rep kind="original-media" src="'), P.file_url(F.col("path")), F.lit('"/></asset>'))
    clip = F.concat(F.lit('      <asset-clip ref="a'), F.col("i").cast("string"), F.lit('" name="'), F.col("name"), F.lit('" offset="'), off, F.lit('" start="'), start, F.lit('" duration="'), dur, F.lit('" format="r0">'), inner, F.lit("\n      </asset-clip>"))
    whole = rows.agg(F.first("num").alias("num"), F.first("den").alias("den"), F.sum("dur_frames").alias("total"), F.count("*").alias("c")).where("c > 0")
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE fcpxml>\n<fcpxml version="1.8">\n  <resources>\n    <format id="r0" name="FFVideoFormat" frameDuration="'), tick, F.lit(f'" width="{size[0]}" height="{size[1]}" colorSpace="1-1-1 (Rec. 709)"/>'))
    middle = F.concat(F.lit(f'  </resources>\n  <library>\n    <event name="{title}">\n      <project name="{title}">\n        <sequence format="r0" duration="'), N.rational(F.col("total"), num, den), F.lit('" tcStart="0s" tcFormat="NDF">\n    <spine>'))
    tail = F.lit("    </spine>\n        </sequence>\n      </project>\n    </event>\n  </library>\n</fcpxml>\n")
    at = lambda i, part, text: F.struct(F.struct(F.lit(i).alias("section"), part.alias("part")).alias("part"), text.alias("text"))
    frame = whole.select(F.explode(F.array(*[at(i, F.lit(0).cast("bigint"), text) for i, text in ((0, head), (2, middle), (4, tail))])).alias("x"))
    for i, line in ((1, asset), (3, clip)):
        frame = frame.unionByName(text_parts(rows.select(F.col("i").alias("n"), line.alias("line"))).select(at(i, F.col("part"), F.col("text")).alias("x")))
    return one_text(frame.select("x.*"))


def marker_table(markers: DataFrame) -> DataFrame:
    """(text): a Lua table of markers by file name, for an editor's script. Of paths with one file name the later in order counts."""
    last = markers.groupBy(P.basename(F.col("path")).alias("file")).agg(F.max("path").alias("path"))
    one = clean_markers(markers).join(last, "path")
    item = F.concat(F.lit("{t="), F.format_string("%.3f", "t"), F.lit(", name="), T.lua(F.col("label")), F.lit(', color="'), color(F.col("label")), F.lit('"}'))
    per = one.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "label", item.alias("s")))), lambda x: x["s"]), ", ").alias("s"))
    rows = in_order(per, ["file"], name="table")
    line = F.concat(F.lit("  ["), T.lua(F.col("file")), F.lit("] = {"), F.col("s"), F.lit("},"))
    last_line = F.lit(1 << 62).alias("part"), F.lit("}\n").alias("text")
    lines = rows.select(F.col("_n").alias("n"), F.when(F.col("_n") == 1, F.concat(F.lit("local markers = {\n"), line)).otherwise(line).alias("line"))
    return one_text(text_parts(lines).union(rows.where("_n = 1").select(*last_line)))


def same_files(clips: DataFrame) -> DataFrame:
    """clips(path, dev, ino) -> (path, survivor): paths of one file, the first in order survives; inode 0 tells nothing."""
    key = F.when(F.col("ino") != 0, F.concat_ws(":", "dev", "ino")).otherwise(F.concat(F.lit("path:"), "path"))
    keyed = clips.withColumn("k", key)
    return keyed.join(keyed.groupBy("k").agg(F.min("path").alias("survivor")), "k").select("path", "survivor")


def moved_markers(markers: DataFrame, same: DataFrame) -> DataFrame:
    """Markers on the surviving path, each once."""
    return markers.join(same, "path").select(F.col("survivor").alias("path"), "t", "label").distinct()


def marker_summary(clips: DataFrame, markers: DataFrame, same: DataFrame) -> DataFrame:
    """One row: scanned, deduped, missing, timeline, marked, unmarked; clips(path, on_disk)."""
    here = clips.join(same, "path", "left").withColumn("again", F.coalesce(F.col("survivor") != F.col("path"), F.lit(False)))
    has = moved_markers(markers, same).select("path").distinct().withColumn("has", F.lit(True))
    rows = here.join(has, "path", "left")
    up = F.col("on_disk") & ~F.col("again")
    return rows.agg(F.count("*").alias("scanned"), F.count_if(F.col("on_disk") & F.col("again")).alias("deduped"), F.count_if(~F.col("on_disk")).alias("missing"), F.count_if(up).alias("timeline"), F.count_if(up & F.coalesce("has", F.lit(False))).alias("marked")).withColumn("unmarked", F.col("timeline") - F.col("marked"))
