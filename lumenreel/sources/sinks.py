"""Files that editors and people read: one text per export, CSV reports, keyword plans, event lines.

A sink gets a DataFrame of desired state; tools that change media files are called per row by a function the caller supplies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..params import Media

REPORT = ("file", "folder", "people", "tags", "energy", "peaks", "keywords", "path")


def _hadoop(df: DataFrame, path: str):
    jvm = df.sparkSession.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())


def write_text(df: DataFrame, path: str, column: str = "text") -> bool:
    """Writes the one text of df as a fresh file: a new one is completed beside it, the old one removed, the new one renamed. False, and nothing written, if
    df has no row."""
    row = df.select(column).first()
    if row is None:
        return False
    jvm, p, fs = _hadoop(df, path)
    part = jvm.org.apache.hadoop.fs.Path(path + ".part")
    out = fs.create(part, True)
    out.write(bytearray(row[0].encode("utf-8")))
    out.close()
    fs.delete(p, False)
    fs.rename(part, p)
    return True


def write_report(rows: DataFrame, path: str) -> None:
    """A CSV with a header, by path, also when there are no rows. The rows of a report are a library's clips; they pass through one task."""
    head = ",".join(REPORT)
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    lines = rows.select("path", F.concat_ws(",", *[cell(c) for c in REPORT]).alias("line")).agg(F.array_sort(F.collect_list(F.struct("path", "line"))).alias("x"))
    write_text(lines.select(F.concat(F.lit(head + "\n"), F.array_join(F.transform("x", lambda x: x["line"]), "\n"), F.when(F.size("x") > 0, "\n").otherwise("")).alias("text")), path)


def keyword_plan(desired: DataFrame, read: DataFrame, ours: DataFrame, p: Media = Media()) -> DataFrame:
    """desired(path, keywords), read(path, keywords, status), ours(path, keywords: what we wrote before) -> (path, keywords, action): write, same, unwritable
    (the container can't hold them) or failed (the read failed, so nothing may be written)."""
    j = desired.join(read.select("path", F.col("keywords").alias("_in"), "status"), "path", "left").join(ours.select("path", F.col("keywords").alias("_ours")), "path", "left")
    none = F.array().cast("array<string>")
    merged = F.array_sort(F.array_union(F.array_except(F.coalesce("_in", none), F.coalesce("_ours", none)), F.col("keywords")))
    action = F.when(~P.is_kind(F.col("path"), p.writable), "unwritable").when(F.coalesce("status", F.lit("error")) != "ok", "failed").when(F.array_sort("_in") == merged, "same").otherwise("write")
    return j.select("path", merged.alias("keywords"), action.alias("action"))


def keyword_arguments(keywords: Column) -> Column:
    """Arguments for a metadata writer: the list, and one comma-joined string."""
    return F.array(F.concat(F.lit("-XMP-dc:Subject="), F.array_join(keywords, ", ")), F.concat(F.lit("-Keys:Keywords="), F.array_join(keywords, ",")))


def run_tool(plan: DataFrame, call: Callable[[dict], str | None]) -> DataFrame:
    """(path, failed, error): call(row) runs once a row on the workers and returns an error or None."""
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = [(r["path"], call(r)) for r in b.to_dict("records")]
            yield pd.DataFrame([(p, e is not None, e) for p, e in rows], columns=["path", "failed", "error"])

    return plan.mapInPandas(run, "path string, failed boolean, error string")


def merged_comment(old: Column, own: Column, mark: str = "Keywords: ") -> Column:
    """A file comment with the person's lines kept and our one line renewed."""
    theirs = F.filter(F.split(F.coalesce(old, F.lit("")), "\n"), lambda x: ~x.startswith(mark) & (T.strip(x) != ""))
    return F.array_join(F.concat(theirs, F.when(F.size(own) > 0, F.array(F.concat(F.lit(mark), F.array_join(own, ", ")))).otherwise(F.array().cast("array<string>"))), "\n")


def merged_tags(old: Column, ours_before: Column, ours_now: Column) -> Column:
    """File tags 'name\\ncolor': the person's stay with their colors, ours are as they are now."""
    names = F.transform(old, lambda x: F.split_part(x, F.lit("\n"), F.lit(1)))
    kept = F.filter(old, lambda x: ~F.array_contains(ours_before, F.split_part(x, F.lit("\n"), F.lit(1))))
    kept_names = F.array_except(names, ours_before)
    return F.concat(kept, F.array_except(ours_now, kept_names))


def event_lines(events: DataFrame, prefix: str = "__EVENT__ ") -> DataFrame:
    """(value): a line of JSON a row."""
    return events.select(F.concat(F.lit(prefix), F.to_json(F.struct("*"))).alias("value"))


def stale_exports(recorded: DataFrame, keep: list[str], names: list[str]) -> DataFrame:
    """recorded(path) exports that may be removed: files with an export's name outside the folders kept. Nothing else is ever removed."""
    p = F.col("path")
    return recorded.where(P.basename(p).isin(*names) & ~P.parent(p).isin(*keep)).select("path")


def sidecar(markers: DataFrame, owner: str = "lumenreel") -> DataFrame:
    """(path, text): an XMP file beside each clip with its markers and its owner's name."""
    item = F.concat(F.lit('      <rdf:li rdf:parseType="Resource"><xmpDM:name>'), T.xml(F.col("label")), F.lit("</xmpDM:name><xmpDM:startTime>"), F.bround(F.col("t") * 1000).cast("bigint").cast("string"), F.lit("</xmpDM:startTime></rdf:li>"))
    per = markers.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "label", item.alias("s")))), lambda x: x["s"]), "\n").alias("s"))
    head = f'<x:xmpmeta xmlns:x="adobe:ns:meta/">\n  <rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:xmpDM="http://ns.adobe.com/xmp/1.0/DynamicMedia/" owner="{owner}">\n    <xmpDM:markers><rdf:Seq>\n'
    return per.select(F.concat(F.regexp_replace("path", r"\.[^./]+$", ""), F.lit(".xmp")).alias("path"), F.concat(F.lit(head), F.col("s"), F.lit("\n    </rdf:Seq></xmpDM:markers></rdf:Description></rdf:RDF>\n</x:xmpmeta>\n")).alias("text"))


def own_sidecar(text: Column, owner: str = "lumenreel") -> Column:
    return text.contains(f'owner="{owner}"')
