"""Density clustering of any number of points: HDBSCAN with leaf selection and a merge distance, without a task that holds them all.

1. Points are dealt to groups of at most about GROUP; each pair of groups is a cell. A cell gives every point its nearest points in the other group, whose merge is its
   nearest points of all, NEAR of them at least, and its core distance. Products are taken in 32 bits, less their greatest error; what may be near enough by them is measured
   in 64 bits. Cells are dealt to tasks by number, not put together by their bytes: their work is the square of them.
2. Boruvka rounds over stored tables join components by edges to near points. What a component's points have not met is no nearer than the last of their near points, so an
   edge before that bound is the lightest out of the component, and an edge of the spanning tree. Edges are ordered by (weight, ids), so the tree is unique.
3. Where several components are left, near points that join them bound the edges still missing, and with them the points that can have such: for these, cells return a
   spanning tree of the edges between their groups. An edge of the spanning tree of all points is in the tree of any set of edges that it belongs to (Jin et al. 2015).
4. Tree edges are numbered in that order and merged in batches of BATCH: within a batch, connected parts are merged side by side, and a part's components keep a
   size, a cluster, and the members while they are fewer than a cluster needs. Two clusters that meet are children of a new one; points that meet a
   cluster belong to it.
5. Clusters climb, by pointer doubling, to the first ancestor that was born at the merge distance or beyond.

After Campello, Moulavi and Sander (2013), Malzer and Baum (2020).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import Clustering
from ..storage import in_order, stored

#: Points of a group, of a side of a distance product, and tree edges merged at a time.
GROUP, SIDE, BATCH = 32_768, 2_048, 1 << 18
#: Components of the vectors of a group: longer ones make smaller groups.
COMPONENTS = 1 << 21
#: Nearest points that a point keeps at least.
NEAR = 8
#: Share of a product's pairs above which all of them are measured in 64 bits.
MANY = 1 / 32
#: Pairs of components a point of a product up to which their lightest edges are taken one by one.
PARTS = 16
#: Points whose squared distance is this share of their squared lengths are the same: less is rounding.
SAME = 1e-12


def _rounded(square: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Squared distances in place. Products round differently in blocks of other shapes, so squares are rounded to 32 bits: what is equal stays equal everywhere."""
    lengths *= SAME
    square[square <= lengths] = 0
    bits = square.view(np.int64)
    bits += 1 << 20
    bits &= -1 << 21
    return square


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs. Holds two matrices of the result's size."""
    lengths = (a * a).sum(1)[:, None] + (b * b).sum(1)
    square = 2 * a @ b.T
    np.subtract(lengths, square, out=square)
    return _rounded(square, lengths)


def squares_of(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The same of the pairs (x[i], x[j]), some at a time."""
    out, step = np.empty(len(i)), max(1, (1 << 20) // x.shape[1])
    for at in range(0, len(i), step):
        a, b = x[i[at : at + step]], x[j[at : at + step]]
        lengths = np.einsum("ij,ij->i", a, a) + np.einsum("ij,ij->i", b, b)
        out[at : at + step] = _rounded(lengths - 2 * np.einsum("ij,ij->i", a, b), lengths)
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = squares(a, b)
    return np.sqrt(square, out=square)


def least(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of the k least of each row, or all of a shorter one, in order; of equals the first. Overwrites d."""
    k = min(k, d.shape[1])
    if k > 16:
        j = np.argsort(d, axis=1, kind="stable")[:, :k]
        return j, np.take_along_axis(d, j, 1)
    rows, places, values = np.arange(len(d)), [], []
    for _ in range(k):
        j = d.argmin(1)
        places.append(j)
        values.append(d[rows, j])
        d[rows, j] = np.inf
    return np.stack(places, 1), np.stack(values, 1)


def _places(few: np.ndarray) -> np.ndarray:
    """Flat places of what is true, looked for by eights."""
    flat = few.ravel()
    if flat.size % 8:
        return np.flatnonzero(flat)
    eights = np.flatnonzero(flat.view(np.uint64))
    i, j = np.nonzero(flat.reshape(-1, 8)[eights])
    return eights[i] * 8 + j


class Floors:
    """Lower bounds of squared distances from products in 32 bits, scaled so that the greatest length is about 1: lengths are taken less the product's greatest error."""

    def __init__(self, x: np.ndarray):
        lengths = np.einsum("ij,ij->i", x, x)
        most = lengths.max(initial=0.0)
        self.known = bool(np.isfinite(most))
        scale = 2.0 ** -np.ceil(np.log2(most) / 2) if self.known and most > 0 else 1.0
        self.square = scale * scale
        error = 1.01 * (x.shape[1] + 4) * 2.0**-23
        lengths *= self.square
        self.error = error * lengths + 1e-30
        less = (lengths - self.error).astype(np.float32)[:, None]
        v, one = (x * scale).astype(np.float32), np.ones_like(less)
        self.left, self.right = np.concatenate([-2 * v, less, one], 1), np.concatenate([v, one, less], 1)

    def between(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return self.left[p] @ self.right[q].T

    def limits(self, square: np.ndarray) -> np.ndarray:
        """What the lower bound of a square of at most so much isn't above."""
        return np.nextafter((square * self.square * (1 + 1e-6)).astype(np.float32), np.float32(np.inf))

    def first_limits(self, low: np.ndarray, rows: np.ndarray, columns: np.ndarray, k: int, axis: int) -> np.ndarray:
        """The same for the k-th least square of each row (axis 1) or column (0) of low, if nothing is known of it: k minima of parts aren't less."""
        n = low.shape[axis]
        if n < k:
            return np.full(low.shape[1 - axis], np.inf, np.float32)
        step = max(1, n // (4 * k))
        parts = n // step
        cut = low[:, : parts * step].reshape(len(low), step, parts).min(1) if axis else low[: parts * step].reshape(step, parts, -1).min(0)
        own, other = (rows, columns) if axis else (columns, rows)
        most = np.partition(cut, k - 1, axis=axis).take(k - 1, axis=axis) + 2 * (self.error[own] + self.error[other].max())
        return np.nextafter((most + 1e-6 * np.abs(most)).astype(np.float32), np.float32(np.inf))


def tree(n: int, row, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, weight) of the minimum spanning tree (Prim) of n points; row(i) gives the weights from point i. Of equal weights the edge with the
    lesser (smaller id, larger id) counts as lighter."""
    best, source, open_ = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
    i, j, w, at = np.zeros(n - 1, np.int64), np.zeros(n - 1, np.int64), np.zeros(n - 1), 0
    for k in range(n - 1):
        open_[at], best[at] = False, np.inf
        d = row(at)
        c = np.flatnonzero(open_ & (d <= best))
        a, b = np.minimum(ids[at], ids[c]), np.maximum(ids[at], ids[c])
        wins = (d[c] < best[c]) | (a < low[c]) | ((a == low[c]) & (b < high[c]))
        c, a, b = c[wins], a[wins], b[wins]
        best[c], source[c], low[c], high[c] = d[c], at, a, b
        ties = np.flatnonzero(best == best.min())
        at = int(ties[0] if len(ties) == 1 else ties[np.lexsort((high[ties], low[ties]))[0]])
        i[k], j[k], w[k] = source[at], at, best[at]
    return i, j, w


def tree_between(d: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, weight), i a row and j a column of d: the minimum spanning tree of the edges between two sides with those ids, in the same order of edges."""
    m, n = d.shape
    ids, sides = np.concatenate([left, right]), (slice(0, m), slice(m, m + n))
    rows = d, np.ascontiguousarray(d.T)
    best, source = np.full(m + n, np.inf), np.zeros(m + n, np.int64)
    bound = best.copy()  # as best, but no weight is within that of a node taken
    low, high = np.zeros(m + n, np.int64), np.zeros(m + n, np.int64)
    i, j, w, at = np.zeros(m + n - 1, np.int64), np.zeros(m + n - 1, np.int64), np.zeros(m + n - 1), 0
    for k in range(m + n - 1):
        bound[at], best[at] = -np.inf, np.inf
        own = at >= m
        to, row = sides[not own], rows[own][at - m if own else at]
        c = np.flatnonzero(row <= bound[to])
        if len(c):
            v, c = row[c], c + to.start
            a, b = np.minimum(ids[at], ids[c]), np.maximum(ids[at], ids[c])
            wins = (v < best[c]) | (a < low[c]) | ((a == low[c]) & (b < high[c]))
            c = c[wins]
            best[c] = bound[c] = v[wins]
            source[c], low[c], high[c] = at, a[wins], b[wins]
        ties = np.flatnonzero(best == best.min())
        at = int(ties[0] if len(ties) == 1 else ties[np.lexsort((high[ties], low[ties]))[0]])
        i[k], j[k], w[k] = source[at], at, best[at]
    return np.minimum(i, j), np.maximum(i, j) - m, w


def lightest(d: np.ndarray, left: np.ndarray, right: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, weight), i a row and j a column of d: the lightest edge of each two components, in the same order of edges. The sides have those ids and
    components; a component's points stand together, by id."""
    m, n = d.shape
    first, of = [], []
    for c in (rows, columns):
        new = np.concatenate([[True], c[1:] != c[:-1]])
        first.append(np.flatnonzero(new))
        of.append(new.cumsum() - 1)
    parts = len(first[1])
    best = np.minimum.reduceat(d, first[1], axis=1)  # of a row to a component, where the first is the one with the least id
    equal = d == np.repeat(best, np.diff(first[1], append=n), axis=1)
    if np.count_nonzero(equal) > equal.size // 8:
        j = np.minimum.reduceat(np.where(equal, np.arange(n, dtype=np.int32), np.int32(n)), first[1], axis=1)
    else:
        at = _places(equal)
        to = at // n * parts + of[1][at % n]
        j = at[np.concatenate([[True], to[1:] != to[:-1]])].reshape(m, parts) % n
    kept = best == np.minimum.reduceat(best, first[0], axis=0)[of[0]]
    for end in (np.minimum(left[:, None], right[j]), np.maximum(left[:, None], right[j])):
        end = np.where(kept, end, np.iinfo(np.int64).max)
        kept &= end == np.minimum.reduceat(end, first[0], axis=0)[of[0]]
    i, to = np.nonzero(kept & (rows[:, None] != columns[first[1]]))
    return i, j[i, to], best[i, to]


def kruskal(lo: np.ndarray, hi: np.ndarray, w: np.ndarray, a: np.ndarray | None = None, b: np.ndarray | None = None) -> np.ndarray:
    """Places of the edges of the minimum spanning forest of points, or of the nodes a and b that the ends belong to, in order."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := top.get(x, x)) != x:
            top[x] = top.get(up, up)
            x = up
        return x

    kept = []
    ends = (lo, hi) if a is None else (a, b)
    for e in np.lexsort((hi, lo, w)).tolist():
        i, j = (find(int(c[e])) for c in ends)
        if i != j:
            top[j] = i
            kept.append(e)
    return np.array(kept, np.int64)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1).astype(float)


def _cells(points: DataFrame, groups: int) -> DataFrame:
    """Each point in every cell of its group. Cells are small in bytes and long in work, so they are dealt to twice as many tasks as there are cells, whose number holds."""
    rows = points.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return rows.withColumn("_a", F.least("_g", "_o")).withColumn("_b", F.greatest("_g", "_o")).drop("_o").repartition(groups * (groups + 1), "_a", "_b").groupBy("_a", "_b")


def _products(p: np.ndarray, q: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """The products of a cell's two groups: places of both sides, and whether they are one; of a group with itself each pair once."""
    sides = [[s[i : i + SIDE] for i in range(0, len(s), SIDE)] for s in (p, q)]
    for m, own in enumerate(sides[0]):
        for n in range(m if same else 0, len(sides[1])):
            yield own, sides[1][n], same and m == n


class Nearest:
    """The k nearest of each of n points so far: squares and ids, in that order."""

    def __init__(self, n: int, k: int):
        self.k, self.square, self.id = k, np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def take(self, at: np.ndarray, ids: np.ndarray, square: np.ndarray) -> None:
        """Pairs of a point's place, another's id and their square."""
        points, row = np.unique(at, return_inverse=True)
        row = np.concatenate([np.repeat(np.arange(len(points)), self.k), row])
        square, ids = np.concatenate([self.square[points].ravel(), square]), np.concatenate([self.id[points].ravel(), ids])
        order = np.lexsort((ids, square, row))
        row = row[order]
        order = order[np.arange(len(row)) - np.searchsorted(row, row) < self.k]
        self.square[points], self.id[points] = square[order].reshape(-1, self.k), ids[order].reshape(-1, self.k)


def neighbours(points: DataFrame, groups: int, k: int) -> DataFrame:
    """points(id, v, _g) -> (id, near): the k nearest other points as (d, id), in that order; all others where there are fewer."""

    def near(key: tuple, t: pa.Table) -> pa.Table:
        a, b = (x.as_py() for x in key)
        t = t.sort_by("id")  # of equally near points the first is the one with the least id
        ids, g, x = t.column("id").to_numpy(), t.column("_g").to_numpy(), _matrix(t.column("v"))
        p, q = np.flatnonzero(g == a), np.flatnonzero(g == b)
        best, floors = Nearest(len(x), k), Floors(x)

        def all_of(own: np.ndarray, other: np.ndarray, square: np.ndarray) -> None:
            j, v = least(square, k)
            best.take(np.repeat(own, j.shape[1]), ids[other[j]].ravel(), v.ravel())

        for own, other, same in _products(p, q, a == b):
            if floors.known:
                low = floors.between(own, other)
                if same:
                    np.fill_diagonal(low, np.inf)
                limits = [floors.limits(best.square[at, -1]) for at in (own, other)]
                for side in range(1 if same else 2):
                    if np.isinf(limits[side]).any():
                        limits[side] = np.minimum(limits[side], floors.first_limits(low, own, other, k, 1 - side))
                hits = [_places(low <= limits[0][:, None]), *([] if same else [_places(low <= limits[1])])]
                del low
            few = [len(h) <= MANY * len(own) * len(other) for h in hits] if floors.known else [False, False]
            square = None if all(few) else squares(x[own], x[other])
            if same and square is not None:
                np.fill_diagonal(square, np.inf)
            for side in range(1 if same else 2):
                if few[side]:
                    i, j = np.divmod(hits[side], len(other))
                    i, j = own[i], other[j]
                    v = squares_of(x, i, j)
                    best.take(*((i, ids[j]) if side == 0 else (j, ids[i])), v)
                elif side == 0:
                    all_of(own, other, square.copy() if not same and not few[1] else square)
                else:
                    all_of(other, own, np.ascontiguousarray(square.T))
        out = []
        for rows in [p] if a == b else [p, q]:
            there = np.isfinite(best.square[rows])
            offsets = np.concatenate([[0], there.sum(1).cumsum()]).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(np.sqrt(best.square[rows][there])), pa.array(best.id[rows][there])], names=["d", "id"])
            out.append(pa.table({"id": pa.array(ids[rows]), "near": pa.ListArray.from_arrays(pa.array(offsets), pairs)}))
        return pa.concat_tables(out)

    found = _cells(points, groups).applyInArrow(near, "id long, near array<struct<d: double, id: long>>")
    return found.groupBy("id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def _core(k: int):
    """The distance of the k-th nearest point, itself the first, by the column near."""
    return F.when(F.size("near") < 1, 0.0).otherwise(F.element_at(F.col("near.d"), F.least(F.size("near"), F.lit(k - 1)))) if k > 1 else F.lit(0.0)


def core_distances(points: DataFrame, groups: int, k: int) -> DataFrame:
    """points(id, v, _g) with core: the distance of the k-th nearest point, itself the first."""
    near = neighbours(points, groups, max(1, k - 1))
    return points.join(near.select("id", _core(k).alias("core")), "id")


def near_edges(near: DataFrame) -> DataFrame:
    """(lo, hi, w): edges of near(id, near, core) under mutual reachability, each once."""
    one = near.select("id", "core", F.explode("near").alias("_n")).select("id", "core", F.col("_n.id").alias("_o"), F.col("_n.d").alias("_d"))
    both = one.join(near.select(F.col("id").alias("_o"), F.col("core").alias("_c")), "_o")
    return both.groupBy(F.least("id", "_o").alias("lo"), F.greatest("id", "_o").alias("hi")).agg(F.min(F.greatest("_d", "core", "_c")).alias("w"))


def bounds(near: DataFrame, k: int) -> DataFrame:
    """(node, bound): the edge (w, lo, hi) that all edges of a point to others than its k near ones come after; null where there are no others."""
    last = F.element_at("near", -1)
    edge = F.struct(last["d"].alias("w"), F.least("id", last["id"]).alias("lo"), F.greatest("id", last["id"]).alias("hi"))
    return near.select(F.col("id").alias("node"), F.when(F.size("near") == k, edge).alias("bound"))


def cell_edges(points: DataFrame, groups: int) -> DataFrame:
    """(lo, hi, w): edges that hold the spanning tree of points(id, v, core, _g) under mutual reachability; with the column _c, of the components that the points belong to."""

    def edges(key: tuple, t: pa.Table) -> pa.Table:
        a, b = (x.as_py() for x in key)
        t = t.sort_by([(c, "ascending") for c in ("_c", "id") if c in t.column_names])
        ids, g, core, x = t.column("id").to_numpy(), t.column("_g").to_numpy(), t.column("core").to_numpy(), _matrix(t.column("v"))
        part = t.column("_c").to_numpy() if "_c" in t.column_names else ids
        steps = np.concatenate([[0], (part[1:] != part[:-1]).cumsum()])
        lo, hi, left, right, w = (np.zeros(0, np.int64),) * 4 + (np.zeros(0),)
        for p, q, same in _products(np.flatnonzero(g == a), np.flatnonzero(g == b), a == b):
            if part[p[0]] == part[p[-1]] == part[q[0]] == part[q[-1]]:
                continue
            d = distances(x[p], x[q])
            np.maximum(d, core[p][:, None], out=d)
            np.maximum(d, core[q], out=d)
            if (steps[p[-1]] - steps[p[0]] + 1) * (steps[q[-1]] - steps[q[0]] + 1) <= PARTS * (len(p) + len(q)):
                i, j, v = lightest(d, ids[p], ids[q], part[p], part[q])
            else:
                i, j, v = tree(len(p), d.__getitem__, ids[p]) if same else tree_between(d, ids[p], ids[q])
            i, j = p[i], q[j]
            lo, hi = np.concatenate([lo, np.minimum(ids[i], ids[j])]), np.concatenate([hi, np.maximum(ids[i], ids[j])])
            left, right, w = np.concatenate([left, part[i]]), np.concatenate([right, part[j]]), np.concatenate([w, v])
            if len(w) > 4 * len(x):  # edges that other products outdo go early
                kept = kruskal(lo, hi, w, left, right)
                lo, hi, left, right, w = (c[kept] for c in (lo, hi, left, right, w))
        kept = kruskal(lo, hi, w, left, right)
        return pa.table({"lo": lo[kept], "hi": hi[kept], "w": w[kept]})

    return _cells(points, groups).applyInArrow(edges, "lo long, hi long, w double")


def _doubled(links: DataFrame, name: str) -> DataFrame:
    """links(c, p) of a forest, roots linking to themselves, with p replaced by the root; each step halves the ways."""
    while True:
        up = links.select(F.col("c").alias("p"), F.col("p").alias("_t"))
        links = stored(links.join(up, "p").select("c", F.col("_t").alias("p"), (F.col("p") != F.col("_t")).alias("_moved")), name)
        if links.where("_moved").isEmpty():
            return links.select("c", "p")
        links = links.select("c", "p")


def spanning_forest(edges: DataFrame, name: str = "forest", bounds: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Boruvka rounds over edges(lo, hi, w), or (lo, hi, w, a, b) between nodes a and b: the minimum spanning forest (lo, hi, w), (node, root) of every node, and the
    edges left between roots a and b. Each component takes its lightest edge; components that are joined by them become one, named after a node of it.
    With bounds(node, bound) there are other edges too, those of a node after its bound: a component takes its lightest edge only if that isn't after its nodes' bounds."""
    e = stored(edges.select("lo", "hi", "w", *(("a", "b") if "a" in edges.columns else (F.col("lo").alias("a"), F.col("hi").alias("b")))), name)
    label = e.select(F.col("a").alias("node")).union(e.select("b")).distinct().withColumn("root", F.col("node"))
    bound = bounds.where("bound is not null").select(F.col("node").alias("c"), "bound") if bounds is not None else None
    taken = []
    while True:
        both = e.select(F.col("a").alias("c"), F.col("b").alias("o"), "w", "lo", "hi").union(e.select("b", "a", "w", "lo", "hi"))
        pick = both.groupBy("c").agg(F.min(F.struct("w", "lo", "hi", "o")).alias("m")).select("c", "m.*")
        if bound is None:
            pick = pick.withColumn("sure", F.lit(True))
        else:
            sure = F.col("bound").isNull() | (F.struct("w", "lo", "hi") <= F.col("bound"))
            pick = pick.join(bound, "c", "left").select("c", "w", "lo", "hi", F.when(sure, F.col("o")).otherwise(F.col("c")).alias("o"), sure.alias("sure"))
        pick = stored(pick, name)
        if pick.where("sure").isEmpty():
            break
        taken.append(pick.where("sure").select("lo", "hi", "w").distinct())
        back = pick.select(F.col("c").alias("o"), F.col("o").alias("_c"))
        # two components may take the same edge; the lesser of them is the root
        links = pick.join(back, "o").select("c", F.when((F.col("_c") == F.col("c")) & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o")).alias("p"))
        links = _doubled(stored(links, name), name)
        for end in ("a", "b"):
            e = e.join(links.select(F.col("c").alias(end), F.col("p").alias("_p")), end).drop(end).withColumnRenamed("_p", end)
        e = stored(e.where("a != b").select("lo", "hi", "w", "a", "b"), name)
        label = stored(label.join(links, F.col("root") == F.col("c"), "left").select("node", F.coalesce("p", "root").alias("root")), name)
        if bound is not None:
            bound = stored(bound.join(links, "c", "left").groupBy(F.coalesce("p", "c").alias("c")).agg(F.min("bound").alias("bound")), name)
    return reduce(DataFrame.union, taken) if taken else e.select("lo", "hi", "w").limit(0), label, e


def spanning_tree(points: DataFrame, near: DataFrame, k: int, group: int) -> DataFrame:
    """(lo, hi, w): the minimum spanning tree of points(id, v) under mutual reachability, by near(id, near, core) with the k nearest of each."""
    limit = stored(bounds(near, k), "density-bounds")
    sure, label, rest = spanning_forest(near_edges(near), "density-forest", limit)
    parts = stored(label.groupBy("root").count(), "density-parts")
    n = parts.count()
    if n == 1:
        return sure
    known = stored(spanning_forest(rest, "density-rest")[0], "density-rest")
    joins = known.agg(F.count("*").alias("n"), F.max("w").alias("w")).first()
    # no edge after the last of those that join all parts is missing, so neither are points whose bound is beyond it
    open_ = limit.where("bound is not null")
    if joins["n"] == n - 1:
        open_ = open_.where(F.col("bound.w") <= joins["w"])
    open_ = open_.join(label, "node").select(F.col("node").alias("id"), F.col("root").alias("_c"))
    pts = in_order(open_.join(points.select("id", "v"), "id").join(near.select("id", "core"), "id"), ["_c", "id"], name="density-open")
    m = open_.count()
    groups = max(1, -(-m // group), min(16, -(-m // SIDE)))
    pts = stored(pts.withColumn("_g", F.floor((F.col("_n") - 1) * groups / max(1, m)).cast("int")).drop("_n"), "density-open")
    found = cell_edges(pts, groups).unionByName(known)
    for end, point in (("a", "lo"), ("b", "hi")):
        found = found.join(label.select(F.col("node").alias(point), F.col("root").alias(end)), point)
    return sure.unionByName(spanning_forest(found.where("a != b"), "density-tree")[0])


_MERGED = "kind string, id long, n long, cluster long, w double, members array<long>"


def _merging(least: int):
    """(edges of one connected part, its components' states) -> _MERGED: its new state, clusters with parent and birth, and points with their cluster."""

    def merge(key: tuple, edges: pa.Table, states: pa.Table) -> pa.Table:
        state = {i: (n, c, m) for i, n, c, m in zip(*(states.column(x).to_pylist() for x in ("id", "n", "cluster", "members")), strict=True)}
        top: dict[int, int] = {}
        rows: list[tuple] = []

        def find(x: int) -> int:
            while (up := top.get(x, x)) != x:
                top[x] = top.get(up, up)
                x = up
            return x

        columns = [edges.column(x).to_numpy() for x in ("number", "a", "b", "w")]
        for e in np.argsort(columns[0]).tolist():
            number, a, b, w = (c[e].item() for c in columns)
            a, b = find(a), find(b)
            (n1, c1, m1), (n2, c2, m2) = state[a], state.pop(b)
            top[b] = a
            members = None
            if c1 is not None and c2 is not None:
                rows += [("child", c1, None, number, w, None), ("child", c2, None, number, w, None)]
                c = number
            elif c1 is None and c2 is None:
                c, members = (number if n1 + n2 >= least else None), m1 + m2
                if c is not None:
                    rows += [("member", m, None, c, None, None) for m in members]
                    members = None
            else:
                c = c2 if c1 is None else c1
                rows += [("member", m, None, c, None, None) for m in (m1 if c1 is None else m2)]
            state[a] = n1 + n2, c, members
        ((n, c, m),) = state.values()
        rows.append(("state", key[0].as_py(), n, c, None, m))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()))
        return pa.table({x.split()[0]: pa.array(col, t) for x, col, t in zip(_MERGED.split(", "), zip(*rows, strict=True), kinds, strict=True)})

    return merge


def merged(edges: DataFrame, least: int, batch: int = BATCH) -> tuple[DataFrame, DataFrame, int | None]:
    """Clusters of a spanning tree (lo, hi, w): (id, parent, w) with the height of birth, (point, cluster), and the cluster of all points."""
    e = stored(in_order(edges, ["w", "lo", "hi"], name="tree").select(F.col("_n").alias("number"), "lo", "hi", "w"), "tree")
    total = e.count()
    label = e.select(F.col("lo").alias("node")).union(e.select("hi")).distinct().withColumn("root", F.col("node"))
    state = label.select(F.col("node").alias("id"), F.lit(1).cast("long").alias("n"), F.lit(None).cast("long").alias("cluster"), F.array("node").alias("members"))
    label, told = stored(label, "tree-label"), []
    for first in range(0, total, batch):
        own = e.where((F.col("number") > first) & (F.col("number") <= first + batch))
        for end, point in (("a", "lo"), ("b", "hi")):
            own = own.join(label.select(F.col("node").alias(point), F.col("root").alias(end)), point)
        own = stored(own.select("number", "a", "b", "w"), "tree-batch")
        if total <= batch:
            part = own.select(F.col("a").alias("node")).union(own.select("b")).distinct().withColumn("root", F.lit(0).cast("long"))
        else:
            part = spanning_forest(own.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.col("w")), "tree-parts")[1]
        part = stored(part, "tree-parts")
        left = own.join(part.select(F.col("node").alias("a"), F.col("root").alias("_l")), "a").groupBy("_l")
        right = state.join(part.select(F.col("node").alias("id"), F.col("root").alias("_s")), "id").groupBy("_s")
        out = stored(left.cogroup(right).applyInArrow(_merging(least), _MERGED), "tree-merged")
        told.append(out)
        new = out.where("kind = 'state'").select("id", "n", "cluster", "members")
        state = stored(state.join(part.select(F.col("node").alias("id")), "id", "left_anti").unionByName(new), "tree-state")
        label = stored(label.join(part.select(F.col("node").alias("root"), F.col("root").alias("_r")), "root", "left").select("node", F.coalesce("_r", "root").alias("root")), "tree-label")
    rows = reduce(DataFrame.union, told)
    whole = state.first()
    return rows.where("kind = 'child'").select("id", F.col("cluster").alias("parent"), "w"), rows.where("kind = 'member'").select(F.col("id").alias("point"), "cluster"), whole["cluster"]


def chosen(clusters: DataFrame, members: DataFrame, whole: int, p: Clustering) -> DataFrame:
    """(id, cluster_id from 0) of the points that aren't noise; clusters are numbered by their least point."""
    clusters = stored(clusters, "clusters")
    climbs = (F.col("w") < p.epsilon) & (F.col("parent") != whole)
    tops = _doubled(stored(clusters.select(F.col("id").alias("c"), F.when(climbs, F.col("parent")).otherwise(F.col("id")).alias("p")), "clusters-up"), "clusters-up")
    split = clusters.groupBy("parent").agg(F.min("w").alias("split")).withColumnRenamed("parent", "c")
    ends = tops.join(split, "c", "left").where(F.col("split").isNull() | (F.col("split") < p.epsilon)).select(F.col("c").alias("cluster"), "p")
    own = stored(members.join(ends, "cluster").select(F.col("point").alias("id"), "p"), "clusters-points")
    numbered = in_order(own.groupBy("p").agg(F.min("id").alias("first")), ["first"], name="clusters-order")
    return own.join(numbered.select("p", (F.col("_n") - 1).cast("int").alias("cluster_id")), "p").select("id", "cluster_id")


def fit(points: DataFrame, p: Clustering, group: int = GROUP, batch: int = BATCH) -> DataFrame:
    """points(id long, v array<double> or array<float>, which is shuffled as it is) with distinct ids and vectors of one dimension, at least as many as a cluster needs -> (id, cluster_id) of those that aren't noise."""
    n, width = points.agg(F.count("*"), F.max(F.size("v"))).first()
    group = max(1, min(group, max(SIDE, COMPONENTS // max(1, width))))
    groups = max(-(-n // group), min(16, -(-n // SIDE)))
    k = max(NEAR, p.min_samples - 1)
    pts = stored(points.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("_g")), "density-points")
    near = stored(neighbours(pts, groups, k).withColumn("core", _core(p.min_samples)), "density-near")
    spanning = stored(spanning_tree(pts, near, k, group), "density-tree")
    clusters, members, whole = merged(spanning, p.min_cluster_size, batch)
    if clusters.isEmpty():
        return points.sparkSession.createDataFrame([], "id long, cluster_id int")  # one cluster alone is not told from the whole
    return chosen(clusters, members, whole, p)
