"""Path columns: names, scopes and labels. Paths use '/' and compare exactly, case included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

SPACE = r"^\s+|\s+$"


def basename(p: Column) -> Column:
    return F.regexp_extract(p, r"([^/]*)/*$", 1)


def parent(p: Column) -> Column:
    return F.regexp_replace(p, "/[^/]*$", "")


def suffix(p: Column) -> Column:
    """Lower-cased ending with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(p, r"[^/](\.[^./]+)$", 1))


def stem(p: Column) -> Column:
    return F.regexp_replace(basename(p), r"(?<=.)\.[^.]+$", "")


def is_kind(p: Column, endings: Sequence[str]) -> Column:
    return suffix(p).isin(*endings)


def under(p: Column, roots: Sequence[str] | None) -> Column:
    """In scope: equal to a root or below it. No roots at all (None) means everything is; an empty list, nothing. With literal
    roots the equality and prefix tests reach the scan."""
    if roots is None:
        return F.lit(True)
    test = F.lit(False)
    for r in roots:
        test = test | (p == r) | p.startswith(r.rstrip("/") + "/")
    return test


def ancestors(p: Column) -> Column:
    """The path itself and every folder above it, as an array."""
    parts = F.split(p, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def in_scope(df: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """Rows of df whose path is in a table of roots. Each distinct path meets its few ancestors in a hash semi-join, so neither a
    nested loop nor a fan-out by the number of roots arises."""
    keys = roots.select(F.regexp_replace(root, "/+$", "").alias("_root")).distinct()
    hits = df.select(path).distinct().select(path, F.explode(ancestors(F.col(path))).alias("_root")).join(keys, "_root", "left_semi").select(path).distinct()
    return df.join(hits, path, "left_semi")


def display_name(p: Column) -> Column:
    """The stem, with its folder's name before it where several clips share the stem."""
    folder = basename(parent(p))
    alone = F.count(F.lit(1)).over(Window.partitionBy(stem(p))) == 1
    return F.when(alone | (folder == ""), stem(p)).otherwise(F.concat_ws("/", folder, stem(p)))


def file_url(p: Column) -> Column:
    """file:// with everything but letters, digits, _.-~ and / percent-encoded."""
    q = F.replace(F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    return F.concat(F.lit("file://"), F.replace(F.replace(q, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A")))


#: Words that never make a tag suggestion: fixed values.
STOP_WORDS = ("the", "and", "a", "an", "of", "in", "on", "at", "for", "to", "test", "tests", "video", "videos", "footage", "clip", "clips", "mov", "mp4", "avi", "m4v", "raw", "edit", "final", "draft", "v1", "v2", "v3")


def suggest_tags(p: Column, stop: Sequence[str] = STOP_WORDS, most: int = 5) -> Column:
    """Tags suggested by a path's last part: words of two letters at least that are no stop words or numbers, in order, once each."""
    words = F.split(F.lower(basename(p)), r"[-_.\s]+")
    good = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*stop) & ~w.rlike("^[0-9]+$"))
    return F.array_join(F.slice(F.array_distinct(good), 1, most), ", ")


def resolve_scope(explicit: list[str] | None, everything: bool, recorded: list[str] | None, legacy: str | None) -> list[str] | None:
    """Explicit roots, else everything if asked for, else the recorded roots, else the one recorded before those, else everything."""
    if explicit:
        return list(explicit)
    if everything:
        return None
    return list(recorded) if recorded else [legacy] if legacy else None


def scope_label(roots: list[str] | None) -> str:
    """One line that names a batch: everything, one root's name, or how many clips it is and where."""
    if not roots:
        return "everything"
    folders = {r.rstrip("/").rpartition("/")[0] for r in roots}
    if len(roots) == 1:
        return roots[0].rstrip("/").rpartition("/")[2] or roots[0]
    return f"{len(roots)} clip(s) in {folders.pop().rpartition('/')[2]}" if len(folders) == 1 else f"{len(roots)} item(s)"


def export_folder(roots: list[tuple[str, bool]]) -> str | None:
    """Where exports go, from (root, is a folder): a single folder itself; else the deepest folder that holds all roots; if that is '/',
    the first folder."""
    if len(roots) == 1 and roots[0][1]:
        return roots[0][0]
    folders = [(r if is_dir else r.rpartition("/")[0]).split("/") for r, is_dir in roots]
    if not folders:
        return None
    common = []
    for parts in zip(*folders, strict=False):
        if len(set(parts)) > 1:
            break
        common.append(parts[0])
    return "/".join(common) if len(common) > 1 else "/".join(folders[0])
