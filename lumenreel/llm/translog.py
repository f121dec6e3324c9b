"""Transaction log reassembly: transactions of several sources, savepoints and rollbacks, and the shared store after each epoch.

A log is records(position, id, source, kind, key, value) in one order. Each source runs one transaction after the other; commit, abort or the log's end (an
abort) ends it. Rollback undoes what remains of its transaction since the latest savepoint (none: since its start) and removes that savepoint.

1. Records are dealt by ranges of the log's order. A task streams its range in Arrow batches and gives each record the marker (commit or abort) before it in
   its source, if its range has one, and each commit its number in the range. Ranges are stitched by earlier(): the last marker of a source in
   the ranges before, and the commits in the ranges before.
2. A transaction is (source, marker before it), so a hot source is as many keys as it has transactions, and records are dealt by that. In a task the keys
   are composite NumPy ones (transaction, level, position): level counts the savepoints that are open, rollbacks are lexsorted by the key, and one
   searchsorted finds each change's undoer, the next rollback of its transaction at its level. What no rollback undoes is kept at its commit's position, or undone by
   the abort.
3. Of an epoch's kept changes to a key only the last by (commit, position) counts. Epochs are dealt in blocks of BLOCK; each block gets what every key held
   before it from earlier(); changes against the key's value before are totalled an epoch by reduceat and summed up.

A transaction is held by one task; nothing else is, nothing that grows with the log goes to the driver, and nothing is broadcast.

Cases: rows without an id are no records; rows that share an id are records each, in the order of source (null first) and value, and of equal rows any; an id with several
labels deletes if one is toxic; a null source is a source; an empty log gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, earlier, read

KEYS, COMMITS = 300, 4
#: Epochs of a block.
BLOCK = 64
#: Records that a task resolves side by side, at least.
ROWS = 200_000
COMMIT, ABORT, SAVE, BACK, CHANGE = range(5)

_MARKED = "source string, part long, at long, id long, kind int, key int, value long, tpart long, tat long, nth long"
_SOLVED = "what int, id long, undoer long, key int, value long, cpart long, nth long, part long, at long"
_STATES = "kind string, id long, n long, value long"
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in (c.split() for c in ddl.split(", "))])


def _filled(c: pa.Array, value: int) -> np.ndarray:
    return pc.fill_null(c, value).to_numpy(zero_copy_only=False)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of (source, id, kind, key, value) in order -> _MARKED. Holds one number a source."""
    part, at, commits, last = TaskContext.get().partitionId(), 0, 0, {}
    schema = _schema(_MARKED)
    for b in batches:
        n = len(b)
        if not n:
            continue
        kind = b.column(2).to_numpy()
        names = b.column(0).dictionary_encode()
        code = _filled(names.indices, len(names.dictionary))
        names = [*names.dictionary.to_pylist(), None]
        order = np.argsort(code, kind="stable")
        own, ends = code[order], kind[order] <= ABORT
        first = np.concatenate([[True], own[1:] != own[:-1]])
        # the place in `order` of the last marker up to each record, then of the one before it, within its source
        place = np.maximum.accumulate(np.where(ends, np.arange(n), -1))
        before = np.concatenate([[-1], place[:-1]])
        start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        found = before >= start
        tat = np.where(found, at + order[np.maximum(before, 0)], -1)
        held = np.array([last.get(s, -1) for s in names], np.int64)
        tat = np.where(found, tat, held[own])
        out = np.empty(n, np.int64)
        out[order] = tat
        for i in np.flatnonzero(np.concatenate([first[1:], [True]])).tolist():  # the last record of each source
            if place[i] >= start[i]:
                last[names[own[i]]] = at + int(order[place[i]])
        is_commit = kind == COMMIT
        nth = commits + np.cumsum(is_commit)
        commits = int(nth[-1])
        known = pa.array(out < 0)
        row = np.full(n, part)
        tpart = pc.if_else(known, pa.scalar(None, pa.int64()), pa.array(row))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(row), pa.array(at + np.arange(n)), *b.columns[1:], tpart, pc.if_else(known, pa.scalar(None, pa.int64()), pa.array(out)), pa.array(nth)], schema=schema)
        at += n


def levels(tx: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Savepoints open before each record; tx is sorted, records in log order. A rollback without one leaves none open, so the level is the walk of savepoints and
    rollbacks above its least value so far in the transaction."""
    step = (kind == SAVE).astype(np.int64) - (kind == BACK)
    walk = np.cumsum(step) - step  # before the record
    first = np.flatnonzero(np.concatenate([[True], tx[1:] != tx[:-1]]))
    nth = np.cumsum(np.concatenate([[True], tx[1:] != tx[:-1]])) - 1
    walk = walk - walk[first][nth]
    # a running minimum within transactions: each lies lower than all before it by more than any walk is long
    drop = nth * (2 * len(tx) + 2)
    low = np.minimum.accumulate(walk - drop) + drop
    return walk - np.minimum(low, 0)


def undoers(tx: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """For each record the index of the rollback that undoes it, were it a change; -1 if none does."""
    n = len(tx)
    level, position = levels(tx, kind), np.arange(n)
    width = int(level.max(initial=0)) + 1
    back = np.flatnonzero(kind == BACK)
    back = back[np.lexsort((position[back], level[back], tx[back]))]
    group = lambda i: tx[i] * width + level[i]  # noqa: E731  (transaction, level) as one number, position after it
    keys = group(back) * (n + 1) + position[back]
    i = np.searchsorted(keys, group(position) * (n + 1) + position, "right")
    hit = np.minimum(i, max(len(back) - 1, 0))
    return np.where((i < len(back)) & (group(back[hit]) == group(position)), back[hit], -1) if len(back) else np.full(n, -1)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_MARKED sorted by (tpart, tat, source, part, at) -> _SOLVED: kept changes, undone changes."""
    schema = _schema(_SOLVED)

    def resolved(t: pa.Table) -> pa.RecordBatch:
        tpart, tat, kind = (t.column(c).to_numpy() for c in ("tpart", "tat", "kind"))
        code = _filled(t.column("source").combine_chunks().dictionary_encode().indices, -1)
        new = np.concatenate([[True], (tpart[1:] != tpart[:-1]) | (tat[1:] != tat[:-1]) | (code[1:] != code[:-1])])
        tx = np.cumsum(new) - 1
        last = np.concatenate([np.flatnonzero(new)[1:], [len(tx)]])[tx] - 1
        end = kind[last]
        by = undoers(tx, kind)
        change = np.flatnonzero(kind == CHANGE)
        by, end, last = by[change], end[change], last[change]
        what = np.where(by >= 0, BACK, np.where(end == COMMIT, CHANGE, ABORT)).astype(np.int32)
        ids, part, nth = (t.column(c).to_numpy() for c in ("id", "part", "nth"))
        undoer = np.where(by >= 0, ids[np.maximum(by, 0)], ids[last])
        log_end = (by < 0) & (end > ABORT)
        kept = what == CHANGE
        some = t.take(pa.array(change)).combine_chunks()
        col = {c: some.column(c).combine_chunks() for c in ("id", "key", "value", "part", "at")}
        return pa.RecordBatch.from_arrays([pa.array(what), col["id"], pa.array(undoer, mask=log_end | kept), col["key"], col["value"], pa.array(part[last], mask=~kept), pa.array(nth[last], mask=~kept), col["part"], col["at"]], schema=schema)

    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += len(b)
        if rows < ROWS:
            continue
        t = pa.Table.from_batches(held)
        a, b2, s = (t.column(c).combine_chunks() for c in ("tpart", "tat", "source"))
        n = len(t)
        same = (a.to_numpy() == a[n - 1].as_py()) & (b2.to_numpy() == b2[n - 1].as_py())
        same &= (s.is_null() if not s[n - 1].is_valid else pc.fill_null(pc.equal(s, s[n - 1]), False)).to_numpy(zero_copy_only=False)
        cut_at = int(n - np.argmin(same[::-1])) if not same.all() else 0
        if cut_at:
            yield resolved(t.slice(0, cut_at))
        rest = t.slice(cut_at).combine_chunks().to_batches()
        held, rows = rest, sum(map(len, rest)) if cut_at else 0  # a transaction that fills all is read on
    if held and sum(map(len, held)):
        yield resolved(pa.Table.from_batches(held))


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, epoch, key, value) sorted by block, of whole blocks -> the store after each epoch. A row without a key stands for its epoch; a block's
    first rows, at the epoch before it, are what keys held then. A null value: the key isn't stored."""
    schema = _schema(_STATES)

    def block(t: pa.Table) -> pa.RecordBatch:
        epoch, key = t.column("epoch").to_numpy(), _filled(t.column("key").combine_chunks(), -1)
        value = t.column("value").combine_chunks()
        there = value.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
        amount = _filled(value, 0)
        order = np.lexsort((epoch, key))
        e, k, n, v = epoch[order], key[order], there[order], amount[order]
        follows = np.concatenate([[False], k[1:] == k[:-1]]) & (k >= 0)
        dn, dv = n - np.where(follows, np.roll(n, 1), 0), v - np.where(follows, np.roll(v, 1), 0)
        by = np.argsort(e, kind="stable")
        e, dn, dv = e[by], dn[by], dv[by]
        first = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
        n, v = np.cumsum(np.add.reduceat(dn, first)), np.cumsum(np.add.reduceat(dv, first))
        own = e[first] > e[0]  # the epoch before the block
        return pa.RecordBatch.from_arrays([pa.array(["state"] * int(own.sum()), pa.string()), pa.array(e[first][own]), pa.array(n[own]), pa.array(v[own])], schema=schema)

    held: list[pa.RecordBatch] = []
    for b in batches:
        blocks = b.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(b)]
        for i, j in zip(edges, edges[1:]):
            if i == j:
                continue
            if held and held[-1].column(0)[0].as_py() != int(blocks[i]):
                yield block(pa.Table.from_batches(held))
                held = []
            held.append(b.slice(i, j - i))
    if held:
        yield block(pa.Table.from_batches(held))


def mark(log: DataFrame) -> DataFrame:
    """_MARKED of log(source, id, kind, key, value), stored: records in ranges of the order (id, source, value), each with the marker before it."""
    rows = log.repartitionByRange("id").sortWithinPartitions("id", F.col("source").asc_nulls_first(), F.col("kind"), F.col("key"), F.col("value"))
    return cut(rows.select("source", "id", "kind", "key", "value").mapInArrow(_mark, _MARKED), "translog-marked")


def solve(marked: DataFrame, fan: int = 1024) -> DataFrame:
    """_SOLVED of mark()'s records, stored: a row a change; what tells whether it's kept (CHANGE) or undone by a rollback (BACK) or an abort (ABORT)."""
    top = marked.agg(F.max("part")).first()[0] or 0
    ends = marked.groupBy("source", "part").agg(F.max(F.when(F.col("kind") <= ABORT, F.col("at"))).alias("at"))
    ends = ends.withColumn("end", F.when(F.col("at").isNotNull(), F.struct(F.col("part").alias("p"), F.col("at").alias("a"))))
    before = cut(earlier(ends.drop("at"), ["source"], "part", "end", "last", top, fan).select(F.col("source").alias("_s"), F.col("part").alias("_p"), F.col("_before").alias("_b")), "translog-before").hint("merge")  # ranges grow with the log: nothing is broadcast
    known = marked.where("tat is not null")
    # of a range's records only those before its first marker of their source
    loose = marked.where("tat is null").join(before, F.col("source").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p")))
    loose = loose.withColumn("tpart", F.coalesce("_b.p", F.lit(-1))).withColumn("tat", F.coalesce("_b.a", F.lit(-1))).select(known.columns)
    rows = known.unionByName(loose).repartition("tpart", "tat", "source").sortWithinPartitions("tpart", "tat", "source", "part", "at")
    return cut(rows.mapInArrow(_solve, _SOLVED), "translog-solved")


def states(marked: DataFrame, solved: DataFrame, commits: int = COMMITS, fan: int = 1024) -> DataFrame:
    """The store after each epoch of so many commits: ('state', epoch from 1, stored keys, sum of their values)."""
    top, total = marked.agg(F.max("part"), F.count_if(F.col("kind") == COMMIT)).first()
    if not total:
        return marked.sparkSession.createDataFrame([], _STATES)
    epochs = -(-total // commits)
    counts = marked.groupBy("part").agg(F.count_if(F.col("kind") == COMMIT).alias("n"))
    offset = cut(earlier(counts, [], "part", "n", "sum", top, fan).select(F.col("part").alias("_p"), F.coalesce("_before", F.lit(0)).alias("_c")), "translog-commits").hint("merge")
    kept = solved.where(F.col("what") == CHANGE).join(offset, F.col("cpart") == F.col("_p"))
    epoch = (F.floor((F.col("_c") + F.col("nth") - 1) / commits) + 1).cast("long")
    last = kept.groupBy(epoch.alias("epoch"), "key").agg(F.max_by(F.struct("value"), F.struct("cpart", "nth", "part", "at")).alias("v"))
    block = F.floor((F.col("epoch") - 1) / BLOCK).cast("long").alias("block")
    last = cut(last.select(block, "epoch", "key", "v"), "translog-last")
    spark, blocks = marked.sparkSession, -(-epochs // BLOCK)
    ends = last.groupBy(F.col("block").alias("_b"), F.col("key").alias("_k")).agg(F.max_by("v", "epoch").alias("v"))
    ends = ends.withColumn("block", F.col("_b") + 1).withColumnRenamed("_k", "key")  # what a block leaves is there in the next
    grid = spark.range(blocks).select(F.col("id").alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(KEYS - 1))).alias("_k"))
    held = grid.join(ends.select("block", "key", "v").hint("merge"), (F.col("_b") == F.col("block")) & (F.col("_k") == F.col("key")), "left").select(F.col("_b").alias("block"), F.col("_k").alias("key"), "v")
    held = earlier(held, ["key"], "block", "v", "last", blocks, fan).select("block", "key", F.coalesce("v", "_before").alias("v"))
    carry = held.select("block", (F.col("block") * BLOCK).alias("epoch"), "key", F.col("v.value").alias("value"))
    marks = spark.range(1, epochs + 1).select(F.floor((F.col("id") - 1) / BLOCK).cast("long").alias("block"), F.col("id").alias("epoch"), F.lit(None).cast("int").alias("key"), F.lit(None).cast("long").alias("value"))
    rows = carry.unionByName(marks).unionByName(last.select("block", "epoch", "key", F.col("v.value").alias("value")))
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(_states, _STATES)


def reassemble(log: DataFrame, commits: int = COMMITS, fan: int = 1024) -> DataFrame:
    """log(source, id, kind, key, value) -> ('state', epoch, stored keys, sum of values) and, per undone change, ('abort' or 'rollback', id, undoer's id or null, key).

    kind is one of COMMIT, ABORT, SAVE, BACK, CHANGE; key is from 0 to KEYS - 1; a null value deletes the key."""
    marked = mark(log)
    solved = solve(marked, fan)
    undone = solved.where(F.col("what") != CHANGE).select(F.when(F.col("what") == BACK, "rollback").otherwise("abort").alias("kind"), "id", F.col("undoer").alias("n"), F.col("key").cast("long").alias("value"))
    return states(marked, solved, commits, fan).unionByName(undone)


def records(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents as a log: see reassemble()."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    r = h % 23
    kind = F.when(r < 2, COMMIT).when(r == 2, ABORT).when(r < 5, SAVE).when(r < 7, BACK).otherwise(CHANGE)
    key = (F.floor(h / 100) % KEYS).cast("int")
    toxic = labels.where("toxic = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("_t")).distinct().hint("merge")
    rows = docs.where("doc_id is not null").select("source", F.col("doc_id").cast("long").alias("id"), kind.cast("int").alias("kind"), key.alias("key"), F.crc32(F.concat(key.cast("string"), F.lit(":"), F.col("text")).cast("binary")).alias("value"))
    rows = rows.join(toxic, F.col("id") == F.col("_t"), "left")
    change = F.col("kind") == CHANGE
    return rows.select("source", "id", "kind", F.when(change, F.col("key")).alias("key"), F.when(change & F.col("_t").isNull(), F.col("value")).alias("value"))


def op13_transaction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reassemble(records(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


OP13_SQL = r"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
b AS (SELECT doc_id, source, text, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda c, v: xor(t[(xor(c, v) & 255) + 1], c >> 8), 4294967295), 4294967295) AS h FROM documents, tab WHERE doc_id IS NOT NULL),
r AS (SELECT doc_id, source, text, CASE WHEN h % 23 < 2 THEN 0 WHEN h % 23 = 2 THEN 1 WHEN h % 23 < 5 THEN 2 WHEN h % 23 < 7 THEN 3 ELSE 4 END AS kind, h // 100 % 300 AS key FROM b),
x AS (SELECT *, coalesce(count(*) FILTER (kind <= 1) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tx FROM r),
w AS (SELECT *, coalesce(sum(CASE kind WHEN 2 THEN 1 WHEN 3 THEN -1 ELSE 0 END) OVER (PARTITION BY source, tx ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS walk FROM x),
l AS (SELECT *, walk - least(0, min(walk) OVER (PARTITION BY source, tx ORDER BY doc_id)) AS level FROM w),
u AS (SELECT *, min(CASE WHEN kind = 3 THEN doc_id END) OVER (PARTITION BY source, tx, level ORDER BY doc_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS undoer, max(CASE WHEN kind <= 1 THEN doc_id END) OVER (PARTITION BY source, tx) AS ended, coalesce(max(CASE WHEN kind <= 1 THEN kind END) OVER (PARTITION BY source, tx), 1) AS how FROM l),
n AS (SELECT doc_id AS commit_id, row_number() OVER (ORDER BY doc_id) AS nth FROM r WHERE kind = 0),
kept AS (SELECT (nth - 1) // 4 + 1 AS epoch, nth, doc_id, key, text, EXISTS (SELECT 1 FROM labels AS y WHERE y.doc_id = u.doc_id AND toxic = 1) OR text IS NULL AS gone FROM u JOIN n ON ended = commit_id WHERE kind = 4 AND undoer IS NULL AND how = 0),
z AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY epoch, key ORDER BY nth DESC, doc_id DESC) = 1),
v AS (SELECT epoch, key, CASE WHEN gone THEN 0 ELSE 1 END AS n, CASE WHEN gone THEN 0 ELSE xor(list_reduce(list_transform(regexp_extract_all(hex(encode(CAST(key AS VARCHAR) || ':' || text)), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda c, v: xor(t[(xor(c, v) & 255) + 1], c >> 8), 4294967295), 4294967295) END AS value FROM z, tab),
d AS (SELECT epoch, n - coalesce(lag(n) OVER k, 0) AS n, value - coalesce(lag(value) OVER k, 0) AS value FROM v WINDOW k AS (PARTITION BY key ORDER BY epoch) UNION ALL SELECT (nth - 1) // 4 + 1, 0, 0 FROM n),
s AS (SELECT epoch, sum(n) AS n, sum(value) AS value FROM d GROUP BY epoch)
SELECT 'state' AS kind, CAST(epoch AS BIGINT) AS id, CAST(sum(n) OVER (ORDER BY epoch) AS BIGINT) AS n, CAST(sum(value) OVER (ORDER BY epoch) AS BIGINT) AS value FROM s
UNION ALL SELECT 'rollback', doc_id, undoer, CAST(key AS BIGINT) FROM u WHERE kind = 4 AND undoer IS NOT NULL
UNION ALL SELECT 'abort', doc_id, ended, CAST(key AS BIGINT) FROM u WHERE kind = 4 AND undoer IS NULL AND how = 1
"""
