"""Density clustering (HDBSCAN with leaf selection and a merge distance) and incremental assignment.

Up to LIMIT points are one bounded group and are clustered in one task by labels_of(); more go through density.fit(), which holds no more than a pair of
groups anywhere. Both give the same labels. After Campello, Moulavi and Sander (2013) and Malzer and Baum (2020).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import Clustering
from . import density
from .vectors import doubles, mean_vectors, nearest

#: Points that one task clusters; more are clustered by cells.
LIMIT = 8_192


def _spanning_tree(x: np.ndarray, min_samples: int) -> np.ndarray:
    """Edges (a, b, weight) of the minimum spanning tree under mutual reachability, in the order (weight, a, b); the point itself counts among its neighbours."""
    n = len(x)
    k = min(min_samples, n) - 1
    core = np.concatenate([np.partition(density.distances(x[i : i + 512], x), k, axis=1)[:, k] for i in range(0, n, 512)])
    a, b, w = density.tree(n, lambda i: np.maximum(np.maximum(density.distances(x[i : i + 1], x)[0], core[i]), core), np.arange(n))
    a, b = np.minimum(a, b), np.maximum(a, b)
    return np.stack([a, b, w], 1)[np.lexsort((b, a, w))]


def labels_of(x: np.ndarray, p: Clustering = Clustering()) -> np.ndarray:
    """A label for each point, -1 is noise; fewer points than a cluster needs are one cluster."""
    n = len(x)
    if n < p.min_cluster_size:
        return np.zeros(n, np.int64)
    edges = _spanning_tree(np.asarray(x, float), p.min_samples)
    left, right, height, size = {}, {}, {}, {i: 1 for i in range(n)}
    top = list(range(n))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    for a, b, w in edges:  # single linkage: inner nodes n, n + 1, ...
        i, j, k = find(int(a)), find(int(b)), len(top)
        top.append(k)
        top[i] = top[j] = k
        left[k], right[k], height[k], size[k] = i, j, w, size[i] + size[j]

    def points(k: int) -> list[int]:
        out, todo = [], [k]
        while todo:
            c = todo.pop()
            out.append(c) if c < n else todo.extend((left[c], right[c]))
        return out

    # condensed tree: a cluster ends where both sides of a split are large enough
    root = len(top) - 1
    parent, birth, members, children = {root: None}, {root: np.inf}, {}, {}
    todo = [root]
    while todo:
        c = k = todo.pop()
        while k >= n:
            i, j = left[k], right[k]
            big = [s for s in (i, j) if size[s] >= p.min_cluster_size]
            if len(big) == 2:
                children[c] = big
                for s in big:
                    parent[s], birth[s] = c, height[k]
                    todo.append(s)
                break
            if not big:
                break
            k = big[0]
        members[c] = c
    leaves = [c for c in members if c not in children]
    if leaves == [root]:
        return np.full(n, -1, np.int64)  # one cluster alone is not told from the whole
    chosen: list[int] = []
    for c in leaves:  # climb while the cluster was born below the merge distance
        while parent[c] is not None and parent[c] != root and birth[c] < p.epsilon:
            c = parent[c]
        chosen.append(c)
    chosen = [c for c in dict.fromkeys(chosen)]
    inside = {d for c in chosen for d in _below(c, children)}
    labels = np.full(n, -1, np.int64)
    kept = sorted((c for c in chosen if c not in inside), key=lambda c: min(points(c)))
    for label, c in enumerate(kept):
        labels[points(c)] = label
    return labels


def _below(c: int, children: dict[int, list[int]]) -> list[int]:
    out, todo = [], list(children.get(c, ()))
    while todo:
        d = todo.pop()
        out.append(d)
        todo.extend(children.get(d, ()))
    return out


def fit(points: DataFrame, p: Clustering = Clustering(), first_label: int = 0, limit: int = LIMIT) -> DataFrame:
    """points(id, embedding) -> (id, cluster_id): labels from first_label on, in the order of a cluster's least id; -1 is noise. Ids are distinct and vectors of
    one dimension; a null vector, or one with nulls, is noise."""
    v = F.col("embedding") if dict(points.dtypes)["embedding"] == "array<float>" else doubles(F.col("embedding"))
    points = points.select(F.col("id").cast("long").alias("id"), v.alias("v"))
    there = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())
    usable = points.where(there)
    n = usable.count()
    label = lambda c: F.coalesce(F.col(c) + first_label, F.lit(-1)).cast("int").alias("cluster_id")
    if n > limit:
        return points.select("id").join(density.fit(usable, p), "id", "left").select("id", label("cluster_id"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        labels = labels_of(np.array(pdf["v"].tolist()), p)
        return pd.DataFrame({"id": pdf["id"].to_numpy(), "cluster_id": np.where(labels < 0, -1, labels + first_label).astype(np.int32)})

    found = usable.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda pdf: run(pdf), "id long, cluster_id int")
    return found.unionByName(points.where(~there).select("id", F.lit(-1).alias("cluster_id")))


def centroids(faces: DataFrame) -> DataFrame:
    """(cluster_id, centroid): plain means, not normalised again."""
    return mean_vectors(faces.where("cluster_id >= 0"), ["cluster_id"], "embedding").withColumnRenamed("embedding", "centroid")


def assign(faces: DataFrame, p: Clustering = Clustering()) -> DataFrame:
    """(id, cluster_id, distance) of faces that have no cluster yet; cluster_id null where the nearest centroid isn't nearer than p.match_threshold.
    Noise stays noise."""
    near = nearest(faces.where("cluster_id is null"), centroids(faces))
    return near.withColumn("cluster_id", F.when(F.col("distance") < p.match_threshold, F.col("cluster_id")))


def sums(faces: DataFrame) -> DataFrame:
    """(cluster_id, n, total): what centroids are made of, so that batches add up without reading faces again."""
    parts = faces.where("cluster_id >= 0").select("cluster_id", F.posexplode(doubles(F.col("embedding"))).alias("_i", "_x")).groupBy("cluster_id", "_i").agg(F.sum("_x").alias("_x"), F.count("*").alias("n"))
    return parts.groupBy("cluster_id").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda x: x["_x"]).alias("total"))


def summed_centroids(total: DataFrame) -> DataFrame:
    """(cluster_id, centroid) of any number of sums() of a cluster."""
    parts = total.select("cluster_id", "n", F.posexplode("total").alias("_i", "_x")).groupBy("cluster_id", "_i").agg((F.sum("_x") / F.sum("n")).alias("_x"))
    return parts.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda x: x["_x"]).alias("centroid"))


def join_clusters(new: DataFrame, known: DataFrame, p: Clustering = Clustering()) -> DataFrame:
    """(id, cluster_id) of new(id, embedding): those near a centroid of known(cluster_id, centroid) join its cluster, the rest form clusters with ids after the largest."""
    near = nearest(new, known)
    near = near.where(F.col("distance") < p.match_threshold).select("id", "cluster_id")
    top = known.agg(F.coalesce(F.max("cluster_id"), F.lit(-1))).first()[0]
    return near.unionByName(fit(new.join(near, "id", "left_anti").select("id", "embedding"), p, top + 1))


def incremental(faces: DataFrame, p: Clustering = Clustering()) -> DataFrame:
    """(id, cluster_id) of faces that have none: those near a cluster join it, the rest form new ones with ids after the largest. Without
    any cluster so far all faces, noise too, are clustered anew."""
    if faces.where("cluster_id >= 0").isEmpty():
        return fit(faces.select("id", "embedding"), p)
    return join_clusters(faces.where("cluster_id is null").select("id", "embedding"), centroids(faces), p)


def run_stats(assigned: DataFrame, known: int) -> DataFrame:
    """assigned(id, cluster_id) -> one row: matched to clusters up to `known`, clusters formed, noise."""
    c = F.col("cluster_id")
    return assigned.agg(F.count_if((c >= 0) & (c <= known)).alias("matched"), F.count_distinct(F.when(c > known, c)).alias("formed"), F.count_if(c == -1).alias("noise"))
