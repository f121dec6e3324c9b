"""Number columns: levels, buckets, frame grids, timecode, boxes. Rounding is half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import Energy, Media, Timeline


def unit(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def audio_level(db: Column, p: Energy = Energy()) -> Column:
    return unit((db - p.audio_floor) / (p.audio_ceil - p.audio_floor))


def motion_level(px: Column, p: Energy = Energy()) -> Column:
    lo, hi = p.motion_floor**0.5, p.motion_ceil**0.5
    return unit((F.sqrt(F.greatest(px, F.lit(0.0))) - lo) / (hi - lo))


def either(a: Column, b: Column) -> Column:
    """Soft OR of two levels."""
    return 1.0 - (1.0 - a) * (1.0 - b)


def bucket(score: Column, p: Energy = Energy()) -> Column:
    return F.when(score >= p.high, "high").when(score <= p.low, "low").otherwise("medium")


def decibels(mean_square: Column) -> Column:
    return 20.0 * F.log10(F.sqrt(mean_square + 1e-12) + 1e-9)


def nearest_rate(fps: Column, p: Timeline = Timeline()) -> Column:
    """struct<num, den> of the standard frame duration whose nominal rate is nearest; of equals the slower."""
    best = F.array_min(F.array(*[F.struct(F.abs(fps - r).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("num"), F.lit(d).alias("den")) for i, (r, n, d) in enumerate(p.rates)]))
    return F.struct(best["num"].alias("num"), best["den"].alias("den"))


def divides(target: Column, rate: Column) -> Column:
    """rate fits a whole number of times, one at least, in target."""
    q = target / rate
    return (F.abs(q - F.rint(q)) < 1e-6) & (F.rint(q) >= 1)


def frame(seconds: Column, num: Column, den: Column) -> Column:
    return F.rint(seconds * den / num).cast("bigint")


def rational(frames: Column, num: Column, den: Column) -> Column:
    return F.concat((frames * num).cast("string"), F.lit("/"), den.cast("string"), F.lit("s"))


def frames_needed(seconds: Column, num: Column, den: Column, p: Timeline = Timeline()) -> Column:
    """Whole frames that cover a duration."""
    return F.greatest(F.lit(1), F.ceil(seconds / (num / den) - p.frame_epsilon)).cast("bigint")


def timecode(frames: Column, num: Column, den: Column) -> Column:
    """HH:MM:SS:FF, non-drop."""
    rate = F.rint(den / num).cast("bigint")
    s = F.floor(frames / rate).cast("bigint")
    return F.format_string("%02d:%02d:%02d:%02d", F.floor(s / 3600).cast("bigint"), F.floor(s / 60).cast("bigint") % 60, s % 60, frames % rate)


def timecode_seconds(code: Column, rate: Column) -> Column:
    """Seconds that a start timecode stands for; 0 if it can't be read. A ';' marks drop-frame labels, which skip numbers in every
    minute that isn't a tenth one."""
    part = F.split(F.replace(code, F.lit(";"), F.lit(":")), ":")
    n = [F.try_element_at(part, F.lit(i)).try_cast("bigint") for i in (1, 2, 3, 4)]
    nominal = F.greatest(F.lit(1), F.rint(rate)).cast("bigint")
    frames = ((n[0] * 60 + n[1]) * 60 + n[2]) * nominal + n[3]
    minutes = n[0] * 60 + n[1]
    skipped = F.rint(nominal * 0.066666).cast("bigint") * (minutes - F.floor(minutes / 10).cast("bigint"))
    whole = F.size(part) == 4
    return F.coalesce(F.when(whole, (frames - F.when(code.contains(";"), skipped).otherwise(0)) / rate), F.lit(0.0))


def ratio(text: Column) -> Column:
    """The first positive n/d, or plain number, among the lines of a probe's answer; null if there is none."""
    def one(line: Column) -> Column:
        p = F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), "/")
        return F.try_divide(p[0].try_cast("double"), F.coalesce(F.try_element_at(p, F.lit(2)).try_cast("double"), F.lit(1.0)))

    good = F.filter(F.transform(F.split(text, "\n"), one), lambda x: x.isNotNull() & (x > 0))
    return F.try_element_at(good, F.lit(1))


def scaled(w: Column, h: Column, p: Media = Media()) -> tuple[Column, Column]:
    """Even sizes with the longest side at most p.longest_side."""
    k = F.least(F.lit(1.0), p.longest_side / F.greatest(w, h))
    even = lambda x: (F.rint(x * k) - F.rint(x * k) % 2).cast("int")
    return even(w), even(h)


def crop(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, pad: float = 0.3, p: Media = Media()) -> tuple[Column, Column, Column, Column]:
    """(x0, y0, x1, y1) in the full picture of a box found in the scaled one, padded and clamped."""
    up = F.greatest(F.lit(1.0), F.greatest(width, height) / float(p.longest_side))
    px, py = w * up * pad, h * up * pad
    low = lambda v: F.greatest(F.lit(0), F.floor(v)).cast("int")
    return low(x * up - px), low(y * up - py), F.least(width, F.floor((x + w) * up + px)).cast("int"), F.least(height, F.floor((y + h) * up + py)).cast("int")


def remaining(done: Column, total: Column, elapsed: Column) -> Column:
    """Seconds left at the pace so far; null until two are done."""
    return F.when(done >= 2, elapsed / done * (total - done))
