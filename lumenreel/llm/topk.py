"""Exact top-k search by distributed histogram selection.

Vectors become integers floor(64 x); a score is an integer inner product. Queries and candidates are packed into blocks, and
each pair of a query block and a candidate block is a cell that scores everything in it with one matrix product. A round
counts scores in BUCKETS equal buckets of each query's current interval; counts are summed over cells, and the bucket that holds the
k-th best score is the next interval. When the interval is one value, the k-th score is known: a last pass keeps what
is above it and, of equal scores, the smallest ids that fill up to k. A cell sends the buckets down to where it has k
scores itself, since the k-th overall can't be lower, so a round moves at most k rows per query and cell.

Cases: vectors that are null, empty or hold null or non-finite components take no part; vectors of different lengths
have no score with each other; rows without an id are left out; rows that share an id are each candidates (with the same id) and a
query is searched once per row; fewer than k candidates give all; empty tables give no rows; scores beyond
2^62 are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read

K, SCALE, EVERY = 20, 64, 20
#: Rows of a query block and of a candidate block, and buckets of a round.
QUERIES, CANDIDATES, BUCKETS = 512, 8192, 256
_BLOCK = "dim int, block long, ids binary, mat binary, n int, top double"
RESULT = "query_id long, rank int, vec_id long, score long"


def usable(emb: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id long, dim int, v array<double>) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    ok = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return emb.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.size(v).alias("dim"), F.transform(v, lambda x: F.floor(x * float(scale)).cast("double")).alias("v"))


def blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Packs each partition's vectors into blocks of one dimension; a block's number is the same when its task runs again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        base, count = TaskContext.get().partitionId() << 32, 0

        def send(dim: int) -> pa.RecordBatch:
            nonlocal count
            ids, mats = zip(*held.pop(dim), strict=True)
            ids, mat = np.concatenate(ids), np.concatenate(mats)
            count += 1
            return pa.RecordBatch.from_pylist([{"dim": dim, "block": base + count, "ids": ids.tobytes(), "mat": mat.tobytes(), "n": len(ids), "top": float(np.abs(mat).max())}], schema)

        schema = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("mat", pa.binary()), ("n", pa.int32()), ("top", pa.float64())])
        for b in batches:
            ids, dims = b.column(0).to_numpy(), b.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                mat = b.column(2).take(pa.array(at)).flatten().to_numpy().reshape(-1, dim)
                own = ids[at]
                while len(own):
                    room = rows - sum(len(x) for x, _ in held.get(dim, ()))
                    held.setdefault(dim, []).append((own[:room], mat[:room]))
                    own, mat = own[room:], mat[room:]
                    if sum(len(x) for x, _ in held[dim]) >= rows:
                        yield send(dim)
        for dim in list(held):
            yield send(dim)

    return vectors.mapInArrow(run, _BLOCK)


def scores(q: np.ndarray, c: np.ndarray, top_q: float, top_c: float) -> np.ndarray:
    """Exact inner products of integer-valued rows."""
    most = top_q * top_c * q.shape[1]
    if most < 2**24:
        return q.astype(np.float32) @ c.astype(np.float32).T
    if most < 2**53:
        return q @ c.T
    if most >= 2**62:
        raise ValueError("scores beyond 2^62")
    return q.astype(np.int64) @ c.astype(np.int64).T


def _unpack(r, dim: int, vec: str, ids: str) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(r[ids], np.int64), np.frombuffer(r[vec]).reshape(-1, dim)


def _cells(q: DataFrame, c: DataFrame, per: int, work, schema: str) -> DataFrame:
    """Runs work(query block with its state, candidate block) -> pandas rows once for each pair of blocks of one dimension.

    Query blocks are dealt to `per` slots, candidate blocks to each other side's slot: an equi-join on (dim, query block, slot) brings
    one candidate block at a time to a query block."""

    def run(pairs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pairs:
            for r in batch.to_dict("records"):
                yield from work(r)

    slot = F.pmod(F.xxhash64("block"), F.lit(per)).cast("int")
    left = q.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(per - 1))))
    right = c.select("dim", slot.alias("slot"), F.col("ids").alias("c_ids"), F.col("mat").alias("c_mat"), F.col("top").alias("c_top"))
    return left.join(right.hint("shuffle_merge"), ["dim", "slot"]).mapInPandas(run, schema)


def top_k(emb: DataFrame, is_query, k: int = K, scale: int = SCALE, self_matches: bool = False) -> DataFrame:
    """RESULT: for each row for which the column is_query holds, its k best among the others (ties to the smaller id)."""
    spark = emb.sparkSession
    vectors = usable(emb, scale)
    picked = usable(emb.where(is_query), scale)
    c = cut(blocks(vectors, CANDIDATES), "topk-candidates")
    q = cut(blocks(picked, QUERIES), "topk-queries")
    size = {r["dim"]: r for r in c.groupBy("dim").agg(F.count("*").alias("blocks"), F.max("top").alias("top"), F.sum("n").alias("n")).collect()}
    if not size or q.isEmpty():
        return spark.createDataFrame([], RESULT)
    per = max(1, max(r["blocks"] for r in size.values()))
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        return _select(spark, c, q, size, per, k, self_matches)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def _select(spark, c: DataFrame, q: DataFrame, size: dict, per: int, k: int, self_matches: bool) -> DataFrame:
    def matrix(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        qi, qm = _unpack(r, r["dim"], "mat", "ids")
        ci, cm = _unpack(r, r["dim"], "c_mat", "c_ids")
        return qi, ci, scores(qm, cm, r["top"], r["c_top"])

    def state(r, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = np.frombuffer(r["state"], np.int64).reshape(rows, 3)
        return s[:, 0], s[:, 1], s[:, 2]

    def count(r) -> Iterator[pd.DataFrame]:
        qi, ci, s = matrix(r)
        low, width, want = state(r, len(qi))
        for at in range(0, len(qi), 64):
            i = slice(at, min(at + 64, len(qi)))
            part = s[i].astype(np.int64)
            b = np.floor_divide(part - low[i][:, None], width[i][:, None])
            np.minimum(b, BUCKETS, out=b)  # above the interval: already counted
            ok = (b >= 0) & (b < BUCKETS)
            if not self_matches:
                ok &= qi[i][:, None] != ci
            flat = (b + np.arange(len(b))[:, None] * BUCKETS)[ok]
            h = np.bincount(flat, minlength=len(b) * BUCKETS).reshape(len(b), BUCKETS)
            above = np.cumsum(h[:, ::-1], 1)[:, ::-1] - h  # of this cell's scores, those in higher buckets
            x, y = np.nonzero((h > 0) & (above < want[i][:, None]))
            if len(x):
                yield pd.DataFrame({"block": r["block"], "row": (x + at).astype(np.int32), "bucket": y.astype(np.int32), "n": h[x, y]})

    def last(r) -> Iterator[pd.DataFrame]:
        qi, ci, s = matrix(r)
        kth, _, _ = state(r, len(qi))
        for j in range(len(qi)):
            own = s[j].astype(np.int64)
            near = np.flatnonzero(own >= kth[j])
            if not self_matches:
                near = near[ci[near] != qi[j]]
            if len(near):
                near = near[np.lexsort((ci[near], -own[near]))[:k]]
                yield pd.DataFrame({"block": r["block"], "row": np.int32(j), "query_id": qi[j], "vec_id": ci[near], "score": own[near]})

    # all scores lie in [-most, most]; the first interval covers them, each round narrows it BUCKETS times, the last to one value
    most = max(int(r["top"] * r["top"] * d) for d, r in size.items())
    rounds = 1
    while BUCKETS**rounds < 2 * most + 1:
        rounds += 1

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.tile(np.array([-most, BUCKETS ** (rounds - 1), k], np.int64), (n, 1)).tobytes() for n in b.column("n").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(out, pa.binary())], names=["block", "state"])

    states = cut(q.select("block", "n").mapInArrow(begin, "block long, state binary"), "topk-state")

    def narrow(pdf: pd.DataFrame) -> pd.DataFrame:
        """One query block's sums and state -> its next state."""
        s = np.frombuffer(pdf["state"].iloc[0], np.int64).reshape(-1, 3).copy()
        h = np.zeros((len(s), BUCKETS), np.int64)
        some = pdf[pdf["row"].notna()]
        h[some["row"].astype(int), some["bucket"].astype(int)] = some["n"]
        down = np.cumsum(h[:, ::-1], 1)
        hit = (down >= s[:, 2:]).argmax(1)
        short = down[:, -1] < s[:, 2]  # fewer than k in all: everything counts
        b = np.where(short, 0, BUCKETS - 1 - hit)
        s[:, 2] -= np.where(short, 0, down[np.arange(len(s)), hit] - h[np.arange(len(s)), b])
        s[:, 0] += b * s[:, 1]
        s[:, 1] = np.maximum(1, s[:, 1] // BUCKETS)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "state": [s.tobytes()]})

    for _ in range(rounds):
        counts = _cells(q.join(states, "block"), c, per, count, "block long, row int, bucket int, n long").groupBy("block", "row", "bucket").agg(F.sum("n").alias("n"))
        states = cut(states.join(counts, "block", "left").groupBy("block").applyInPandas(narrow, "block long, state binary"), "topk-state")
    found = cut(_cells(q.join(states, "block"), c, per, last, "block long, row int, query_id long, vec_id long, score long"), "topk-found")
    w = Window.partitionBy("block", "row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS f FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.f, c.f) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
