"""Changes of stored relations as pure functions old rows -> new rows, and a snapshot store that commits them.

A version is a file in the folder CURRENT that names the folders v=<n> it consists of, with the range of their keys where it is known; the largest number
counts. So an append writes what is new only, and changes to stored rows are a folder of the changed rows and of tombstones, merged when the table is read
and put together with it once in a while. One writer at a time; a version's folders stay while it is one of the newest or someone holds a lease on it. Updates are
anti-joins and unions; foreign keys cascade by hand.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..storage import ONE_TASK, stored


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str] = ()) -> DataFrame:
    """new's rows in place of old's with the same key; columns in keep stay as old had them."""
    if keep:
        was = old.select(key, *[F.col(c).alias(f"_{c}") for c in keep])
        new = new.join(was, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in keep else F.col(c) for c in new.columns])
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def add_videos(videos: DataFrame, scanned: DataFrame) -> DataFrame:
    """scanned(path, duration_sec, scanned_at): known paths keep id and all else; new ones get an id from their path."""
    fresh = scanned.join(videos.select("path"), "path", "left_anti").select(F.xxhash64("path").alias("id"), "path", "duration_sec", "scanned_at")
    seen = scanned.select("path", F.col("duration_sec").alias("_d"), F.col("scanned_at").alias("_s"))
    kept = videos.join(seen, "path", "left").withColumn("duration_sec", F.coalesce("_d", "duration_sec")).withColumn("scanned_at", F.coalesce("_s", "scanned_at")).drop("_d", "_s")
    return kept.unionByName(fresh, allowMissingColumns=True)


def replace_by(old: DataFrame, new: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """All rows of the given keys go, new's come."""
    return old.join(keys.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_tags(auto_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """Without the tags(tag) in any case; blank ones count for nothing."""
    gone = tags.select(T.tag(F.col("tag")).alias("_t")).where("_t != ''").distinct()
    return auto_tags.join(gone, F.lower("tag") == F.col("_t"), "left_anti")


def delete_pairs(auto_tags: DataFrame, videos: DataFrame, pairs: DataFrame) -> DataFrame:
    """Without pairs(path, tag): the path exactly, the tag in any case."""
    gone = pairs.join(videos.select(F.col("id").alias("_v"), "path"), "path").select("_v", T.tag(F.col("tag")).alias("_t")).where("_t != ''").distinct()
    return auto_tags.join(gone, (F.col("video_id") == F.col("_v")) & (F.lower("tag") == F.col("_t")), "left_anti")


def forget_missing(videos: DataFrame, listing: DataFrame, root: str) -> DataFrame:
    """(id, path) of videos under the walked root whose file is gone."""
    return videos.where(P.under(F.col("path"), [root])).join(listing.select("path"), "path", "left_anti").select("id", "path")


def cascade(relations: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Relations without the rows of gone(id); videos by id, the others by video_id."""
    return {k: df.join(gone.select("id"), "id", "left_anti") if k == "videos" else df.join(gone.select(F.col("id").alias("video_id")), "video_id", "left_anti") for k, df in relations.items()}


def assign_clusters(faces: DataFrame, labels: DataFrame) -> DataFrame:
    """labels(id, cluster_id) over what faces had."""
    new = labels.select("id", F.col("cluster_id").alias("_c"))
    return faces.join(new, "id", "left").withColumn("cluster_id", F.coalesce("_c", "cluster_id")).select(faces.columns)


def apply_edits(people: DataFrame, hidden: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edits(seq, cluster_id, action, name) -> people and hidden. Of a cluster's edits of one kind the last counts: name sets the name (an empty one
    deletes it), hide hides and deletes the name, unhide shows it again."""
    w = Window.partitionBy("cluster_id").orderBy(F.desc("seq"))
    last = lambda kinds: edits.where(F.col("action").isin(kinds)).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    names = last(["name", "hide"]).select("cluster_id", F.when(F.col("action") == "name", T.strip(F.coalesce("name", F.lit("")))).otherwise("").alias("name"))
    people = people.join(names, "cluster_id", "left_anti").unionByName(names.where("name != ''"))
    shown = last(["hide", "unhide"])
    hidden = hidden.join(shown, "cluster_id", "left_anti").unionByName(shown.where("action = 'hide'").select("cluster_id"))
    return people, hidden


def rename_person(people: DataFrame, old: str, new: str) -> DataFrame:
    return people.withColumn("name", F.when(T.strip(F.col("name")) == old.strip(), F.lit(new.strip())).otherwise(F.col("name")))


def delete_person(people: DataFrame, name: str) -> DataFrame:
    return people.where(T.strip(F.col("name")) != name.strip())


def set_energy(videos: DataFrame, scored: DataFrame, version: int) -> DataFrame:
    """scored(id, score, bucket, peaks): peaks at 3 places."""
    s = scored.select("id", F.col("score").alias("_s"), F.col("bucket").alias("_b"), F.transform("peaks", lambda p: F.bround(p, 3)).alias("_p"))
    j = videos.join(s, "id", "left")
    pick = lambda new, old: F.when(F.col("_b").isNotNull(), new).otherwise(F.col(old)).alias(old)
    new = {"energy_score": F.col("_s"), "energy_bucket": F.col("_b"), "energy_peaks": F.col("_p"), "energy_version": F.lit(version)}
    return j.select(*[pick(new[c], c) if c in new else F.col(c) for c in videos.columns])


def set_keywords(videos: DataFrame, written: DataFrame) -> DataFrame:
    """written(id, keywords): blank ones dropped."""
    w = written.select("id", F.filter("keywords", lambda k: T.strip(k) != "").alias("_k"))
    return videos.join(w, "id", "left").withColumn("written_keywords", F.coalesce("_k", "written_keywords")).select(videos.columns)


def set_batch_tags(videos: DataFrame, tags: DataFrame) -> DataFrame:
    """tags(id, tags) as typed."""
    t = tags.select("id", F.struct(T.batch_tags(F.col("tags")).alias("t")).alias("_t"))
    return videos.join(t, "id", "left").withColumn("batch_tags", F.when(F.col("_t").isNotNull(), F.col("_t.t")).otherwise(F.col("batch_tags"))).select(videos.columns)


def mark_complete(videos: DataFrame, done: DataFrame, value: bool = True) -> DataFrame:
    d = done.select("id", F.lit(value).alias("_v")).distinct()
    return videos.join(d, "id", "left").withColumn("scan_complete", F.coalesce("_v", "scan_complete")).select(videos.columns)


def expired(names: DataFrame, keep: int = 3) -> DataFrame:
    """names(name) like prefix-stamp -> those past the newest `keep` of each prefix; a stamp that is no number is oldest."""
    stamp = F.coalesce(F.element_at(F.split("name", "-"), -1).try_cast("bigint"), F.lit(0))
    rows = names.select("name", F.regexp_replace("name", "-[^-]*$", "").alias("prefix"), stamp.alias("stamp"))
    if keep < 1:
        return rows
    # only the newest of each task are shuffled; the last name kept tells for any other, on its own, whether it is past it
    r = F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("stamp"), F.desc("name")))
    newest = rows.withColumn("_r", r).where(F.col("_r") <= keep).groupBy("prefix", "stamp", "name").agg(F.count("*").alias("_c"))
    last = newest.groupBy("prefix").agg(F.sum("_c").alias("_n"), F.min(F.struct("stamp", "name", "_c")).alias("_l")).where(F.col("_n") == keep)
    last = stored(last.select(F.col("prefix").alias("_p"), "_l.*").toDF("_p", "_s", "_m", "_c"), "expired")
    told = rows.join(F.broadcast(last) if last.count() <= ONE_TASK else last, F.col("prefix").eqNullSafe(F.col("_p")))
    older = told.where((F.col("stamp") < F.col("_s")) | ((F.col("stamp") == F.col("_s")) & (F.col("name") < F.col("_m"))))
    # a name that is there more often than is kept of it
    again = told.where(F.col("name").eqNullSafe(F.col("_m"))).groupBy("name", "prefix", "stamp", "_c").agg(F.count("*").alias("_n")).where("_n > _c")
    again = again.select("name", "prefix", "stamp", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n") - F.col("_c"))).alias("_i"))
    return older.select("name", "prefix", "stamp").unionByName(again.drop("_i"))


class SnapshotStore:
    """Versions of named tables under a folder of any Hadoop filesystem."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 3):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self, table: str) -> list[int]:
        p = self._path(f"{self.root}/{table}")
        if not self._fs.exists(p):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(p)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit() and self._fs.exists(self._path(f"{self.root}/{table}/{n}/_SUCCESS")))

    def current(self, table: str) -> int | None:
        p = self._path(f"{self.root}/{table}/CURRENT")
        if not self._fs.exists(p):
            return None
        names = [s.getPath().getName() for s in self._fs.listStatus(p)]
        return max((int(n) for n in names if n.isdigit()), default=None)

    def _text(self, path: str) -> str:
        p = self._path(path)
        stream = self._fs.open(p)
        try:
            return bytes(stream.readNBytes(int(self._fs.getFileStatus(p).getLen()))).decode()
        finally:
            stream.close()

    def _put(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path), True)
        out.write(bytearray(text.encode()))
        out.close()

    def folders(self, table: str, version: int) -> list[dict]:
        """The folders that a version consists of: n, and key, lo, hi where known; changes is set for one of changed rows."""
        text = self._text(f"{self.root}/{table}/CURRENT/{version}")
        return json.loads(text) if text.startswith("[") else [{"n": int(x)} for x in text.split(",") if x] or [{"n": version}]

    def parts(self, table: str, version: int) -> list[int]:
        return [x["n"] for x in self.folders(table, version)]

    def read(self, table: str, version: int | None = None, key: str | None = None, between: tuple | None = None) -> DataFrame | None:
        """The table. With key and between = (least, largest), only rows with keys in that range: folders of other ranges aren't opened, and the
        range is pushed into the scan of the others."""
        v = self.current(table) if version is None else version
        if v is None:
            return None
        own = list(enumerate(self.folders(table, v)))
        apart = lambda x, lo, hi: x.get("lo") is not None and (x["lo"] > hi or x["hi"] < lo)

        def load(entries: list[dict]) -> DataFrame:
            df = self.spark.read.parquet(*[f"{self.root}/{table}/v={x['n']}" for x in entries])
            return df if between is None else df.where(F.col(key).between(*between))

        first = own[0][1]
        if between is not None:
            own = [(i, x) for i, x in own if x.get("key") != key or not apart(x, *between)]
        changes = [(i, x) for i, x in own if x.get("changes")]
        plain = [(i, x) for i, x in own if not x.get("changes")]
        if not plain:
            return load([first]).limit(0) if not changes else self._merged(load, load([first]).where(F.lit(False)), [], changes, apart)
        return load([x for _, x in plain]) if not changes else self._merged(load, load([first]), plain, changes, apart)

    def _merged(self, load, like: DataFrame, plain: list, changes: list, apart) -> DataFrame:
        """Rows that no later change names, and each changed key's last state."""
        by, out, groups = changes[0][1]["key"], [], {}
        for i, x in plain:
            later = tuple(j for j, y in changes if j > i and (y.get("lo") is None or not apart(x, y["lo"], y["hi"])))
            groups.setdefault(later, []).append(x)
        changed = [load([y]).withColumn("_at", F.lit(j)) for j, y in changes]
        for later, entries in groups.items():
            rows = load(entries)
            for (j, _), c in zip(changes, changed, strict=True):
                if j in later:
                    rows = rows.join(c.select(by), by, "left_anti")
            out.append(rows.select(like.columns))
        every = changed[0]
        for c in changed[1:]:
            every = every.unionByName(c)
        last = every.groupBy(by).agg(F.max_by(F.struct(*[c for c in like.columns if c != by], "_gone"), "_at").alias("_x")).where("not _x._gone")
        out.append(last.select(by, "_x.*").select(like.columns))
        df = out[0]
        for x in out[1:]:
            df = df.unionByName(x)
        return df

    def commit(self, table: str, df: DataFrame, key: str | None = None) -> int:
        """Writes df as the next version, then lets it count; old versions past `keep` go."""
        v = self._write(table, df)
        return self._publish(table, v, [self._entry(table, v, key)])

    def append(self, table: str, df: DataFrame, most: int = 64, key: str | None = None) -> int:
        """The next version is the current one and df, whose keys are new; nothing that is stored is written again, but once in `most` appends all is put into one folder."""
        now = self.current(table)
        if now is None:
            return self.commit(table, df, key)
        parts = self.folders(table, now)
        if len(parts) >= most:
            return self.commit(table, self.read(table, now).unionByName(df, allowMissingColumns=True), key)
        v = self._write(table, df)
        return self._publish(table, v, [*parts, self._entry(table, v, key)])

    def apply(self, table: str, df: DataFrame, key: str, most: int = 16) -> int:
        """The next version has df's rows, one a key, in place of stored ones with the same key; those whose column _gone is true (if there is one) take theirs away.
        Writes df only; once in `most` such changes all is put into one folder. One table has one key."""
        df = df if "_gone" in df.columns else df.withColumn("_gone", F.lit(False))
        now = self.current(table)
        if now is None:
            return self.commit(table, df.where("not _gone").drop("_gone"), key)
        v = self._write(table, df)
        v = self._publish(table, v, [*self.folders(table, now), self._entry(table, v, key) | {"key": key, "changes": True}])
        return self.compact(table, key) if sum(x.get("changes", False) for x in self.folders(table, v)) >= most else v

    def compact(self, table: str, key: str | None = None) -> int:
        return self.commit(table, self.read(table), key)

    def _entry(self, table: str, v: int, key: str | None) -> dict:
        """A folder of the manifest, with the range of a key that is a number or a text."""
        if key is None:
            return {"n": v}
        lo, hi = self.spark.read.parquet(f"{self.root}/{table}/v={v}").agg(F.min(key), F.max(key)).first()
        return {"n": v, "key": key} | ({"lo": lo, "hi": hi} if isinstance(lo, (int, str)) else {})

    @contextlib.contextmanager
    def lease(self, table: str, hours: float = 24) -> Iterator[DataFrame | None]:
        """The current table, whose folders stay until the block ends, or for so many hours if its process is lost."""
        v, path = self.current(table), f"{self.root}/{table}/LEASES/{uuid.uuid4().hex}"
        if v is None:
            yield None
            return
        self._fs.mkdirs(self._path(f"{self.root}/{table}/LEASES"))
        self._put(path, json.dumps({"version": v, "until": time.time() + 3600 * hours, "parts": self.parts(table, v)}))
        try:
            yield self.read(table, v)
        finally:
            self._fs.delete(self._path(path), False)

    def _leased(self, table: str) -> tuple[set[int], set[int]]:
        p = self._path(f"{self.root}/{table}/LEASES")
        if not self._fs.exists(p):
            return set(), set()
        held = [json.loads(self._text(str(x.getPath()))) for x in self._fs.listStatus(p)]
        held = [x for x in held if x["until"] > time.time()]
        return {x["version"] for x in held}, {n for x in held for n in x["parts"]}

    def restore(self, table: str, version: int) -> int:
        """An older version becomes the next one again; its folders are named, not copied."""
        v = max(self.versions(table)[-1], self.current(table)) + 1
        return self._publish(table, v, self.folders(table, version))

    def _write(self, table: str, df: DataFrame) -> int:
        v = max([-1, *self.versions(table), *[x for x in [self.current(table)] if x is not None]]) + 1
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/v={v}")
        return v

    def _publish(self, table: str, v: int, parts: list[dict]) -> int:
        folder = f"{self.root}/{table}/CURRENT"
        self._fs.mkdirs(self._path(folder))
        self._put(f"{folder}/_{v}", json.dumps(parts))
        self._fs.rename(self._path(f"{folder}/_{v}"), self._path(f"{folder}/{v}"))  # the largest number counts
        numbers = sorted(int(n) for n in (s.getPath().getName() for s in self._fs.listStatus(self._path(folder))) if n.isdigit())
        held, used = self._leased(table)
        for old in numbers[: -self.keep]:
            if old not in held:
                self._fs.delete(self._path(f"{folder}/{old}"), False)
        used |= {p for n in numbers[-self.keep :] for p in self.parts(table, n)}
        for old in self.versions(table):
            if old not in used:
                self._fs.delete(self._path(f"{self.root}/{table}/v={old}"), True)
        return v
