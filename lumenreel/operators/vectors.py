"""Vector operators on array columns: norms, products, centroids, nearest centroid, frame-by-prompt scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

#: Largest side, in vector components, that is sent to every worker; a larger one goes through a shuffle.
BROADCAST_COMPONENTS = 1 << 22


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """L2-normalised; the norm counts as 1e-8 at least."""
    n = F.greatest(norm(v), F.lit(1e-8))  # bound by a lambda of its own, else every component would compute it again
    return F.transform(F.array(n), lambda m: F.transform(v, lambda x: x / m))[0]


def mean_vectors(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    """(keys, v): component-wise means. Rows are exploded to (keys, place), so sums are pre-aggregated and no task holds a group's vectors."""
    parts = df.select(*keys, F.posexplode(doubles(F.col(v))).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg("_x").alias("_x"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias(v))


def ensemble(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    """Mean of unit vectors, normalised again."""
    unit_rows = df.select(*keys, unit(doubles(F.col(v))).alias(v))
    return mean_vectors(unit_rows, keys, v).select(*keys, unit(F.col(v)).alias(v))


def _components(df: DataFrame, v: str) -> int:
    return df.agg(F.coalesce(F.sum(F.size(v)), F.lit(0))).first()[0]


def _matrices(ids: list, vectors: list) -> dict[int, tuple[list, np.ndarray]]:
    """Vectors by their dimension: (ids, matrix)."""
    by: dict[int, tuple[list, list]] = {}
    for i, x in zip(ids, vectors, strict=True):
        if x is not None and len(x) and all(c is not None for c in x):
            by.setdefault(len(x), ([], []))[0].append(i)
            by[len(x)][1].append(x)
    return {d: (i, np.array(x, float)) for d, (i, x) in by.items()}


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, offsets, lengths) of a list column of doubles; a null or a vector with nulls has length 0."""
    offsets, size = column.offsets.to_numpy(), np.diff(column.offsets.to_numpy())
    flat = column.values.cast(pa.float64())
    values = np.nan_to_num(flat.to_numpy(zero_copy_only=False), copy=False) if flat.null_count else flat.to_numpy(zero_copy_only=False)
    if flat.null_count:
        bad = np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False))
        size[np.searchsorted(offsets, bad, "right") - 1] = 0
    if column.null_count:
        size = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, size)
    return values, offsets, size


def _unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-8)


def frame_scores(frames: DataFrame, prompts: DataFrame, most: int = BROADCAST_COMPONENTS) -> DataFrame:
    """(video_id, tag, score): best cosine of a clip's frames with each prompt(tag, prompt).

    Prompts of up to `most` components in all are sent to the workers: a batch of frames is one matrix product, whose best row of each clip
    goes on. More of them are dealt to slots in a join."""
    few = prompts.select("tag", doubles(F.col("prompt")).alias("_p"))
    if _components(few, "_p") > most:
        return _frame_scores_by_slots(frames, few, most)
    rows = few.collect()  # within the bound just measured
    tables = {d: (i, _unit_rows(m)) for d, (i, m) in _matrices([r["tag"] for r in rows], [r["_p"] for r in rows]).items()}
    shared = frames.sparkSession.sparkContext.broadcast(tables)
    kind = dict(frames.dtypes)["video_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, offsets, size = _rows(b.column(1))
            for d, (tags, m) in shared.value.items():
                at = np.flatnonzero(size == d)
                if not len(at):
                    continue
                clips = b.column(0).take(pa.array(at)).dictionary_encode()
                code = clips.indices.to_numpy(zero_copy_only=False) if not clips.indices.null_count else clips.indices.fill_null(len(clips.dictionary)).to_numpy()
                order = np.argsort(code, kind="stable")
                scores = _unit_rows(values[offsets[at][:, None] + np.arange(d)]) @ m.T
                first = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) != 0]))
                best = np.maximum.reduceat(scores[order], first, axis=0)
                ids = b.column(0).take(pa.array(at[order[first]]))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(ids)), len(tags)))), pa.array(tags * len(ids)), pa.array(best.ravel())], names=["video_id", "tag", "score"])

    tag = dict(prompts.dtypes)["tag"]
    part = frames.select("video_id", doubles(F.col("embedding")).alias("_f")).mapInArrow(run, f"video_id {kind}, tag {tag}, score double")
    return part.groupBy("video_id", "tag").agg(F.max("score").alias("score"))


def _frame_scores_by_slots(frames: DataFrame, prompts: DataFrame, most: int) -> DataFrame:
    slots = _slots(prompts, "_p", most)
    p = prompts.select(_slot(slots, "tag").alias("_s"), "tag", unit(F.col("_p")).alias("_p"))
    f = frames.select("video_id", unit(doubles(F.col("embedding"))).alias("_f")).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    return f.join(p, "_s").where(F.size("_f") == F.size("_p")).groupBy("video_id", "tag").agg(F.max(dot(F.col("_f"), F.col("_p"))).alias("score"))


def _slots(df: DataFrame, v: str, most: int) -> int:
    """Slots of a side that is dealt out: enough that each holds `most` components, and as many as there are shuffle partitions."""
    return max(-(-_components(df, v) // most), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _slot(slots: int, key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def nearest(points: DataFrame, centroids: DataFrame, key: str = "id", v: str = "embedding", most: int = BROADCAST_COMPONENTS) -> DataFrame:
    """(key, cluster_id, distance) of the nearest centroid(cluster_id, centroid); of equals the smaller id. Centroids of up to `most` components
    in all are sent to the workers, which answer a batch of points by one matrix product; more of them go through nearest_blocks."""
    few = centroids.select("cluster_id", doubles(F.col("centroid")).alias("_c"))
    if _components(few, "_c") > most:
        return nearest_blocks(points, centroids, key, v)
    rows = few.orderBy("cluster_id").collect()  # within the bound just measured
    shared = points.sparkSession.sparkContext.broadcast(_matrices([r["cluster_id"] for r in rows], [r["_c"] for r in rows]))
    kinds = dict(points.dtypes)[key], dict(centroids.dtypes)["cluster_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, offsets, size = _rows(b.column(1))
            for d, (ids, m) in shared.value.items():
                at = np.flatnonzero(size == d)
                if not len(at):
                    continue
                x = values[offsets[at][:, None] + np.arange(d)]
                square = (x * x).sum(1)[:, None] + (m * m).sum(1) - 2 * x @ m.T
                # the product rounds: the candidates within its error are measured again, component by component
                close = square <= square.min(1, keepdims=True) + 1e-9 * np.maximum(1.0, np.abs(square).max(1, keepdims=True))
                i, j = np.nonzero(close)
                exact = np.sqrt(((x[i] - m[j]) ** 2).sum(1))
                order = np.lexsort((j, exact, i))
                pick = order[np.flatnonzero(np.concatenate([[True], np.diff(i[order]) != 0]))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at[i[pick]])), pa.array([ids[k] for k in j[pick]]), pa.array(exact[pick])], names=[key, "cluster_id", "distance"])

    found = points.select(key, doubles(F.col(v)).alias("_v")).mapInArrow(_typed(run, kinds), f"{key} {kinds[0]}, cluster_id {kinds[1]}, distance double")
    best = found.groupBy(key).agg(F.min(F.struct(F.col("distance").alias("d"), "cluster_id")).alias("_b"))
    return best.select(key, F.col("_b.cluster_id").alias("cluster_id"), F.col("_b.d").alias("distance"))


def _typed(run, kinds):
    """run's cluster ids in the column's own type."""
    kind = {"int": pa.int32(), "bigint": pa.int64(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}[kinds[1]]

    def typed(batches):
        for b in run(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(kind), b.column(2)], names=b.schema.names)

    return typed


def nearest_blocks(points: DataFrame, centroids: DataFrame, key: str = "id", v: str = "embedding", block: int = 4096) -> DataFrame:
    """The same for any number of centroids: they are dealt to slots, each point visits every slot in an equi-join, and only its best of a
    task's rows is shuffled. Points are dealt to as many shares as there are shuffle partitions, so a slot isn't one task."""
    slots = max(1, -(-centroids.count() // block))
    shares = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = centroids.select(_slot(slots, "cluster_id").alias("_s"), "cluster_id", doubles(F.col("centroid")).alias("_c")).withColumn("_h", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    p = points.select(key, doubles(F.col(v)).alias("_v"), _slot(shares, key).alias("_h"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("_s"))
    gap = F.sqrt(F.aggregate(F.zip_with("_v", "_c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    best = p.join(c, ["_s", "_h"]).where(F.size("_v") == F.size("_c")).groupBy(key).agg(F.min(F.struct(gap.alias("d"), F.col("cluster_id"))).alias("_b"))
    return best.select(key, F.col("_b.cluster_id").alias("cluster_id"), F.col("_b.d").alias("distance"))


@F.pandas_udf(ArrayType(FloatType()))
def from_f32(blob: pd.Series) -> pd.Series:
    """Little-endian float32 bytes as an array."""
    return blob.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


@F.pandas_udf(ArrayType(FloatType()))
def from_f16(blob: pd.Series) -> pd.Series:
    """Little-endian float16 bytes as an array."""
    return blob.map(lambda b: None if b is None else np.frombuffer(b, "<f2").astype(np.float32))


@F.pandas_udf(BinaryType())
def to_f16(v: pd.Series) -> pd.Series:
    return v.map(lambda a: None if a is None else np.asarray(a, "<f2").tobytes())


@F.pandas_udf(BinaryType())
def to_f32(v: pd.Series) -> pd.Series:
    return v.map(lambda a: None if a is None else np.asarray(a, "<f4").tobytes())
