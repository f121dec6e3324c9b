"""Exact substring dedup over words by prefix-partitioned suffix trees.

A window is WINDOW consecutive words; a word goes if a window over it has its word sequence also at an earlier start
(smaller doc_id, or same document and earlier start).

1. Each window has an anchor: the leftmost of its GRAM-word prefixes of suffixes with the least hash. Equal windows have
   the same anchor at the same place, so only anchors whose gram occurs twice can lie in a repeat. A task sends one row per
   gram, however often it met the gram, so a gram in a third of all rows is spread like any other.
2. Suffixes that start at windows with a repeated anchor are partitioned by it. The prefix has variable length: grams met
   more than GROUP times are extended to the whole window. Neighbouring suffixes of one anchor travel as one piece of
   text; of equal pieces a task sends the first and decides the rest at once.
3. A group's suffixes are sorted, which lays out the leaves of its subtree in order; leaves that agree on WINDOW words hang below
   one internal node of that depth, a repeat; all of its leaves but the earliest are returned.
4. Returned starts are collected per document and applied to whole texts.

Cases: null and wordless texts have no words, and texts of fewer than WINDOW words no window; rows without an id lose nothing and
cost others nothing; rows that share an id hold their windows at the same starts, none of them earlier than the other;
empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, small_side

WINDOW, GRAM = 20, 6
#: Anchors of one gram from which its prefix is extended.
GROUP = 4096
#: Words hashed side by side, anchors a task holds before it sends them, and bytes of different pieces it holds (and of rows it sends at once).
BLOCK, HELD, HELD_BYTES = 100_000, 200_000, 6 << 20

_M = np.uint64(0x9E3779B97F4A7C15)
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<first:int,n:int>>"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())])))])


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def anchors(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts one after another: gram hash at each word, anchor word of each window, and first word of each window."""
    n = np.array([len(w) for w in texts], np.int64)
    total = int(n.sum())
    if total < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.fromiter((x for w in texts for x in map(xxhash.xxh64_intdigest, w)), np.uint64, total)
    g = np.zeros(total - GRAM + 1, np.uint64)
    for j in range(GRAM):
        g = g * _M + h[j : j + len(g)]
    g = _mix(g)
    width, low, at, span = WINDOW - GRAM + 1, g, np.arange(len(g)), 1
    while span < width:  # low[i], at[i]: the leftmost least of g[i : i + span]
        step = min(span, width - span)
        right = low[step:] < low[:-step]
        low, at = np.where(right, low[step:], low[:-step]), np.where(right, at[step:], at[:-step])
        span += step
    fits = np.repeat(np.cumsum(n), n)[: len(at)] - np.arange(len(at)) >= WINDOW
    first = np.flatnonzero(fits)
    return g.view(np.int64), at[first], first


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[list[bytes]], list]]:
    """doc_ids, their words, and the values of a third column if there is one."""
    ids, texts, more, size = [], [], [], 0
    for b in batches:
        third = b.column(2) if b.num_columns > 2 else None
        for k, (doc, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1), strict=True)):
            w = words_of(text.as_py())
            if len(w) >= WINDOW:
                ids.append(doc)
                texts.append(w)
                more.append(third[k].values.to_numpy() if third is not None else None)
                size += len(w)
            if size >= BLOCK:
                yield ids, texts, more
                ids, texts, more, size = [], [], [], 0
    if ids:
        yield ids, texts, more


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, gram, doc_id, pos, many): for each gram of the chunk one row under its own hash, many: the chunk has it twice; further
    anchors of such grams need no partner and go under a key of their own."""
    held, size = [], 0

    def send() -> pa.RecordBatch:
        gram, doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(gram, kind="stable")
        gram, doc, pos = gram[order], doc[order], pos[order]
        new = np.concatenate([[True], gram[1:] != gram[:-1]])
        many = ~(new & np.concatenate([new[1:], [True]]))
        own = _mix((gram.view(np.uint64) ^ doc.view(np.uint64) * _M) + pos.astype(np.uint64)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.where(new, gram, own)), pa.array(gram), pa.array(doc), pa.array(pos), pa.array(many)], names=["key", "gram", "doc_id", "pos", "many"])

    for ids, texts, _ in _blocks(batches):
        g, at, _ = anchors(texts)
        at = np.unique(at)
        n = np.array([len(w) for w in texts], np.int64)
        end = np.cumsum(n)
        k = np.searchsorted(end, at, "right")
        held.append((g[at], np.array(ids, np.int64)[k], (at - (end - n)[k]).astype(np.int32)))
        size += len(at)
        if size >= HELD:
            yield send()
            held, size = [], 0
    if size:
        yield send()


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _grams sorted by key -> (gram, doc_id, pos) of those that have a partner. A key has a row per chunk at most."""
    held: pa.Table | None = None

    def of(t: pa.Table) -> pa.RecordBatch:
        key, many = t["key"].to_numpy(), t["many"].to_numpy(zero_copy_only=False)
        new = np.concatenate([[True], key[1:] != key[:-1]])
        keep = many | ~new | ~np.concatenate([new[1:], [True]])
        return t.select(["gram", "doc_id", "pos"]).filter(pa.array(keep)).combine_chunks()

    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        key = t["key"].to_numpy()
        if not len(key) or key[0] == key[-1]:
            held = t
            continue
        k = int(np.flatnonzero(key != key[-1])[-1]) + 1
        yield from of(t.slice(0, k)).to_batches()
        held = t.slice(k)
    if held is not None and held.num_rows:
        yield from of(held).to_batches()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, anchors as pos * 2 + extended) -> (key, doc_id, start, n, piece): n suffixes from start on; a null piece has an earlier
    equal in the same chunk."""
    held: dict[tuple[int, bytes], tuple[int, int, int]] = {}
    out: list[tuple] = []
    size = 0  # bytes of pieces in held

    def batches_of(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 10_000], strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["key", "doc_id", "start", "n", "piece"])
        rows.clear()

    def send(all_held: bool) -> Iterator[pa.RecordBatch]:
        nonlocal size
        yield from batches_of(out)
        if all_held:
            yield from batches_of([(k, d, s, n, p) for (k, p), (d, s, n) in held.items()])
            held.clear()
            size = 0

    def add(key: int, doc: int, start: int, n: int, piece: bytes) -> None:
        nonlocal size
        got = held.get((key, piece))
        if got is not None and got[:2] > (doc, start):
            got, (doc, start) = (doc, start, n), got[:2]
            held[key, piece] = got
        if got is None:
            held[key, piece] = (doc, start, n)
            size += len(piece)
        elif got[:2] < (doc, start):
            out.append((xxhash.xxh64_intdigest(f"{doc} {start}") - (1 << 63), doc, start, n, None))

    for ids, texts, more in _blocks(batches):
        g, at, first = anchors(texts)
        begin = 0
        for doc, w, marks in zip(ids, texts, more, strict=True):
            lo, hi = np.searchsorted(first, [begin, begin + len(w)])
            a = at[lo:hi] - begin
            marks = np.sort(marks)
            known = np.searchsorted(marks, 2 * a)
            hit = (known < len(marks)) & (marks[np.minimum(known, len(marks) - 1)] >> 1 == a)
            edge = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            for s, e in zip(edge.tolist(), [*edge[1:].tolist(), len(a)], strict=True):
                if not hit[s]:
                    continue
                if marks[known[s]] & 1:
                    for p in range(s, e):
                        piece = b" ".join(w[p : p + WINDOW])
                        add(xxhash.xxh64_intdigest(piece) - (1 << 63), doc, p, 1, piece)
                else:
                    add(int(g[begin + a[s]]), doc, s, e - s, b" ".join(w[s : e + WINDOW - 1]))
                if size >= HELD_BYTES or len(out) >= 10_000:
                    yield from send(size >= HELD_BYTES)
            begin += len(w)
    yield from send(True)


def later_leaves(group: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int]]:
    """Pieces (doc_id, start, n, words) of one prefix -> (doc_id, start) of suffixes that repeat an earlier one.

    Suffixes are cut at WINDOW words and sorted: equal neighbours are the leaves below one node of that depth."""
    leaves = []
    for doc, start, n, piece in group:
        ends = [i for i, c in enumerate(piece) if c == 32] if n > 1 else []
        ends.append(len(piece))
        begin = 0
        for k in range(n):
            leaves.append((piece[begin : ends[k + WINDOW - 1] if n > 1 else None], doc, start + k))
            begin = ends[k] + 1
    leaves.sort()
    found, node = [], None
    for words, doc, start in leaves:
        if node is not None and words == node[0]:
            if (doc, start) > node[1:]:
                found.append((doc, start))
        else:
            node = (words, doc, start)
    return found


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by key -> (doc_id, first, n): windows that go, as runs of starts. Holds one key's pieces, of equal single suffixes the
    earliest: a prefix that was extended to the window, however often it occurs, is one piece."""
    key, group = None, []
    single: dict[bytes, tuple[int, int]] = {}
    out: list[tuple[int, int, int]] = []

    def close() -> None:
        run: tuple[int, int, int] | None = None
        group.extend((doc, start, 1, piece) for piece, (doc, start) in single.items())
        for doc, start in sorted(later_leaves(group)) if len(group) > 1 or group and group[0][2] > 1 else ():
            if run and run[0] == doc and run[1] + run[2] == start:
                run = (doc, run[1], run[2] + 1)
                continue
            if run:
                out.append(run)
            run = (doc, start, 1)
        if run:
            out.append(run)

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "first", "n"])

    for b in batches:
        for k, doc, start, n, piece in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if piece is None:
                out.append((doc, start, n))
                continue
            if k != key:
                close()
                key, group, single = k, [], {}
            if n > 1:
                group.append((doc, start, n, piece))
            elif (got := single.setdefault(piece, (doc, start))) != (doc, start):
                single[piece] = min(got, (doc, start))
                out.append((*max(got, (doc, start)), 1))
        if len(out) >= 20_000:
            yield batch(out)
            out.clear()
    close()
    if out:
        yield batch(out)


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, runs of window starts that go) -> RESULT."""
    for b in batches:
        rows = []
        for doc, text, runs in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
            w, spans, gone = words_of(text.as_py()), [], 0
            if runs.is_valid and len(w) >= WINDOW:
                mark = np.zeros(len(w) + 1, np.int64)
                first, n = (runs.values.field(f).to_numpy() for f in ("first", "n"))
                ok = first + n + WINDOW - 1 <= len(w)
                np.add.at(mark, first[ok], 1)
                np.add.at(mark, (first + n + WINDOW - 1)[ok], -1)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(mark[:-1]) > 0, [0]]))).tolist()
                spans = [{"first": s, "n": e - s} for s, e in zip(edge[::2], edge[1::2], strict=True)]
                gone = sum(x["n"] for x in spans)
                kept = [x for s, e in zip([0, *edge[1::2]], [*edge[::2], len(w)], strict=True) for x in w[s:e]]
            else:
                kept = w
            rows.append((doc, len(w), gone, hashlib.sha256(b" ".join(kept)).hexdigest(), spans))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_RESULT)], schema=_RESULT)


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, runs array<struct<first, n>>): starts of windows that occur earlier too; stored."""
    plain = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    grams = plain.mapInArrow(_grams, "key long, gram long, doc_id long, pos int, many boolean").repartition("key").sortWithinPartitions("key")
    found = cut(grams.mapInArrow(_repeated, "gram long, doc_id long, pos int"), "substring-anchors")
    long = small_side(cut(found.groupBy("gram").count().where(F.col("count") > GROUP).select("gram", F.lit(1).alias("extend")), "substring-extended"))
    marks = found.join(long, "gram", "left").groupBy("doc_id").agg(F.collect_set(F.col("pos").cast("long") * 2 + F.coalesce("extend", F.lit(0))).alias("marks"))
    marks = cut(marks.withColumnRenamed("doc_id", "_id"), "substring-marks").hint("shuffle_hash")  # the texts stream by, only a partition's marks are held
    pieces = plain.join(marks, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "marks").mapInArrow(_pieces, "key long, doc_id long, start int, n int, piece binary")
    later = pieces.repartition("key").sortWithinPartitions("key").mapInArrow(_subtrees, "doc_id long, first int, n int")
    return cut(later.groupBy("doc_id").agg(F.collect_set(F.struct("first", "n")).alias("runs")), "substring-runs")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document row: RESULT; removed holds runs of words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    runs = repeats(docs).withColumnRenamed("doc_id", "_id").hint("shuffle_hash")
    return docs.join(runs, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "runs").mapInArrow(_applied, RESULT)


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).drop("removed")


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, doc_id, i, array_to_string(list_slice(w, i + 1, i + 20), ' ') AS k FROM d, LATERAL (SELECT unnest(range(greatest(0, len(w) - 19))) AS i) WHERE doc_id IS NOT NULL),
f AS (SELECT k, min((doc_id, i)) AS first FROM x GROUP BY k HAVING count(*) > 1),
g AS (SELECT r, list(DISTINCT j) AS gone FROM x JOIN f USING (k), LATERAL (SELECT unnest(range(i + 1, i + 21)) AS j) WHERE (doc_id, i) > first GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda v, j: NOT list_contains(gone, j)) END, ' ')) AS kept_sha256 FROM d LEFT JOIN g USING (r)
"""
