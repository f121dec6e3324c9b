"""Text columns: normal forms, escapes, list codecs and prompt enrichment. Space means every white space, not blanks only."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def tag(c: Column) -> Column:
    """A tag's normal form."""
    return F.lower(strip(c))


def _filled(a: Column) -> Column:
    return F.filter(a, lambda x: x != "")


def from_commas(c: Column) -> Column:
    return _filled(F.transform(F.split(c, ","), strip))


def from_lines(c: Column) -> Column:
    return _filled(F.split(c, "\n"))


def batch_tags(tags: Column) -> Column:
    """Normal forms, once each, sorted; null if none is left."""
    clean = F.array_sort(F.array_distinct(_filled(F.transform(tags, tag))))
    return F.when(F.size(clean) > 0, clean)


def marker_name(c: Column) -> Column:
    """A name that can't break a marker structure: , and = become spaces, braces and brackets parentheses."""
    return strip(F.translate(c, ",={[}]", "  (())"))


def edl_name(c: Column) -> Column:
    return strip(F.translate(c, "|\n", "- "))


def _replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def xml(c: Column) -> Column:
    return _replaced(c, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")])


def html(c: Column) -> Column:
    return _replaced(c, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")])


def lua(c: Column) -> Column:
    return F.concat(F.lit('"'), _replaced(c, [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")]), F.lit('"'))


def seen_in(paths: Column, shown: int = 3) -> Column:
    """The first names and how many more there are."""
    names = F.transform(paths, lambda p: F.regexp_extract(p, "[^/]+$", 0))
    more = F.size(names) - shown
    return F.concat(F.array_join(F.slice(names, 1, shown), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(""))


#: Tag and the phrase that an image-text model knows it by: fixed values.
PHRASES = {
    "kids": "kids playing", "baby": "a baby", "adults": "a group of adults", "couple": "a couple together", "group": "a large gathering of people",
    "indoors": "an indoor scene at home", "outdoors": "an outdoor scene", "night": "a nighttime scene", "sunset": "a sunset",
    "beach": "a beach", "pool": "a swimming pool", "mountains": "mountains", "city": "a city downtown", "backyard": "a backyard", "restaurant": "a restaurant interior",
    "eating": "people eating a meal", "dancing": "people dancing", "music": "people playing music", "sports": "someone playing a sport", "swimming": "someone swimming",
    "hiking": "someone hiking", "cooking": "someone cooking food", "driving": "someone driving a car",
    "wedding": "a wedding ceremony", "birthday": "a birthday party with cake", "celebration": "a holiday celebration", "christmas": "christmas decorations", "graduation": "a graduation ceremony",
    "worship": "a church worship service", "baptism": "a baptism", "preaching": "a pastor preaching at a pulpit", "choir": "a choir singing", "congregation": "a large church congregation",
    "prayer": "people praying with bowed heads", "conference": "a speaker presenting on a stage at a conference", "speaker": "a person speaking into a microphone to an audience",
    "dog": "a pet dog", "cat": "a pet cat", "food": "food on a plate", "cake": "a birthday cake with candles", "drone": "aerial drone footage from above",
    "portrait": "a close-up portrait of a person's face", "landscape": "a scenic landscape", "car": "a car or vehicle",
}
#: Sentences around a phrase: fixed values.
TEMPLATES = ("a photo of {}", "a video of {}", "a frame from a video showing {}", "footage of {}", "a home video of {}")


def enrich(c: Column) -> Column:
    """The phrase of a known tag, any other tag as it was typed."""
    known = F.create_map(*[F.lit(x) for kv in PHRASES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, tag(c)), c)


def prompts(c: Column) -> Column:
    """The phrase in every template, as an array."""
    return F.array(*[F.replace(F.lit(t), F.lit("{}"), enrich(c)) for t in TEMPLATES])


def clean_prompt(c: Column) -> Column:
    """What a text tokeniser is given: one line, single spaces, lower case."""
    return F.lower(strip(F.regexp_replace(c, r"\s+", " ")))


def hashed_id(identity: Column, salt: str) -> Column:
    return F.sha2(F.concat(identity, F.lit(salt)), 256)


def age(minutes: Column) -> Column:
    """How long ago: minutes, hours or days, rounded half up."""
    unit = lambda n, word: F.concat(n.cast("bigint").cast("string"), F.lit(" " + word), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    hours, days = F.round(minutes / 60), F.round(minutes / 1440)
    return F.when(minutes < 1, "just now").when(minutes < 60, unit(F.round(minutes), "minute")).when(hours < 24, unit(hours, "hour")).otherwise(unit(days, "day"))


def json_roots(c: Column) -> Column:
    return F.from_json(c, "array<string>")


def json_peaks(c: Column) -> Column:
    """A peaks list; what can't be read is an empty one."""
    return F.coalesce(F.from_json(c, "array<double>"), F.array().cast("array<double>"))


def rejections(c: Column) -> Column:
    """[[path, tag], ...] as an array of pairs; null where it can't be read."""
    return F.from_json(c, "array<array<string>>")


def explained(message: Column, explanations: Sequence[tuple[Sequence[str], str]]) -> Column:
    """The explanation of the first entry of which any part occurs in the message, any case; the message itself if none does. Entries are the
    caller's: (parts, explanation)."""
    low = F.lower(message)
    out = F.when(F.lit(False), message)
    for parts, said in explanations:
        out = out.when(reduce(lambda a, b: a | b, [low.contains(p.lower()) for p in parts]), F.lit(said))
    return out.otherwise(message)


def token_ids(c: Column, encode: Callable[[], Callable[[str], list[int]]], start: int, end: int, length: int = 77) -> Column:
    """Texts as a fixed number of ids for a text encoder: start, the cleaned text's ids, end, then zeros; long ones are cut so that the end
    stays. encode() is called once a worker and returns the tokenizer; a null text is an empty one."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids = encode()
        for b in batches:
            rows = [[start, *ids(t or "")[: length - 2], end] for t in b]
            yield pd.Series([r + [0] * (length - len(r)) for r in rows])

    return run(clean_prompt(F.coalesce(c, F.lit(""))))
