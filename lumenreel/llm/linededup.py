"""Fuzzy line dedup: MinHash over character shingles, high-recall banding, exact Jaccard, distributed union-find.

A line's normal form is lower case with white space collapsed; empty ones never count. Equal normal forms are one node
(64-bit hash). Two nodes are linked if the Jaccard similarity of their sets of SHINGLE-character shingles (as 64-bit hashes) is at least
SIMILARITY (a shorter line is one shingle). Candidates share one of BANDS bands of ROWS minima, which finds a pair at 0.8 with
probability over 0.999; every candidate link is checked against the texts. Of each component only the first line
stays: least doc_id, then least line number.

One pass over the texts stores a table of lines: for every node that a task meets its normal form once, and where it occurs, as
one row for up to HELD lines; band keys are computed from that table. So a line that stands in a third of all documents is a row per HELD lines and not
one per document. Keys of one node are dropped, and groups with the same members are checked once. A group of over CHUNK
nodes is dealt to cells of two chunks each; a cell returns a spanning forest of its links. Only nodes that share a band
fetch their normal form.

Cases: null and empty texts have no lines; a text keeps its empty lines; rows that share an id count as one document, whose
lines have the same numbers, so they keep or lose them together; rows without an id are neither changed nor counted; if
every line goes the text is empty; of equal or similar lines of one document the first stays (ties can't occur, a line's
place is unique in it); a text of one very long line is one node, whose shingles are hashed whole; empty tables give no
rows; extra columns are kept by dedup() as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, forget, own_name, read, small_side, spanning

SHINGLE, SIMILARITY = 9, 0.8
BANDS, ROWS = 14, 4
CHUNK = 128
#: Characters hashed at a time, lines and characters a task holds before it sends them, and nodes it remembers in order not to hash them again.
BLOCK, HELD, HELD_CHARS, SEEN = 300_000, 40_000, 4_000_000, 200_000
#: Lines of like length whose minima are taken side by side, and shingles of a line from which it is taken alone.
ABREAST, LONG = 256, 2048
#: Different nodes of one band key that a task holds before it returns them.
OPEN = 1_000_000

_ODD = np.random.default_rng(9).integers(1, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def node(norm: str) -> int:
    return xxhash.xxh64_intdigest(norm.encode("utf-8", "surrogatepass")) - (1 << 63)


def lines_of(text: str | None) -> Iterator[tuple[int, str]]:
    """(number from 0, normal form) of the lines that aren't empty."""
    for i, x in enumerate(text.split("\n") if text else ()):
        if n := normal(x):
            yield i, n


def _hashes(lines: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all k-character shingles of lines that stand one after another, and where each line's begin and end."""
    pad = "\0" * (k - 1)
    c = np.frombuffer((pad.join(lines) + pad).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    h, have, power = c, 1, int(_M)
    for bit in bin(k)[3:]:  # of twice as many characters, and of one more where the bit says so
        h = h[:-have] * np.uint64(power) + h[have:]
        have, power = 2 * have, power * power & (2**64 - 1)
        if bit == "1":
            h = h[: len(c) - have] * _M + c[have:]
            have, power = have + 1, power * int(_M) & (2**64 - 1)
    first = np.cumsum(n + k - 1) - (n + k - 1)
    return _mix(h), first, first + np.maximum(1, n - k + 1)


def _minima(v: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """uint32[function, line]: the least value of each line's shingles under every hash function."""
    out = np.empty((len(_ODD), len(first)), np.uint32)
    if count.max() >= LONG:
        for i, (s, n) in enumerate(zip(first.tolist(), count.tolist(), strict=True)):
            out[:, i] = [(v[s : s + n] * a).min() for a in _ODD]
        return out
    grid = v[first + np.minimum(np.arange(count.max())[:, None], count - 1)]  # a column a line, its last shingle repeated
    turned = np.empty_like(grid)
    for i, a in enumerate(_ODD):
        np.minimum.reduce(np.multiply(grid, a, out=turned), axis=0, out=out[i])
    return out


def band_keys(lines: list[str], k: int = SHINGLE) -> np.ndarray:
    """int64[line, band]; computed for lines of like length side by side."""
    keys = np.empty((len(lines), BANDS), np.int64)
    order = np.argsort(np.fromiter(map(len, lines), np.int64, len(lines)), kind="stable").tolist()
    at = 0
    while at < len(order):
        most, size, end = len(lines[order[at]]) * 5 // 4 + 8, 0, at
        while end < len(order) and end - at < ABREAST and len(lines[order[end]]) <= most and (size < BLOCK or end == at):
            size += len(lines[order[end]])
            end += 1
        part = order[at:end]
        h, first, stop = _hashes([lines[i] for i in part], k)
        least = _minima((h >> np.uint64(32)).astype(np.uint32), first, stop - first).reshape(BANDS, ROWS, -1)
        x = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], len(part), 1)
        for i in range(ROWS):
            x = _mix(x * _M + least[:, i])
        keys[part] = x.view(np.int64).T
        at = end
    return keys


def shingle_sets(lines: list[str], k: int = SHINGLE) -> list[np.ndarray]:
    """The set of each line's shingles, as sorted distinct hashes."""
    out: list[np.ndarray] = []
    begin = size = 0
    for i, n in enumerate(lines):
        size += len(n)
        if size >= BLOCK or i + 1 == len(lines):
            h, first, end = _hashes(lines[begin : i + 1], k)
            for s, e in zip(first.tolist(), end.tolist(), strict=True):
                v = np.sort(h[s:e])
                new = np.empty(len(v), bool)
                new[0] = True
                np.not_equal(v[1:], v[:-1], out=new[1:])
                out.append(v[new])
            begin, size = i + 1, 0
    return out


LINES = "node long, norm string, of array<struct<doc_id:long,line:int>>"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> LINES: norm only where the task meets a node first; of is in order."""
    seen: set[int] = set()
    norms: list[str] = []
    docs: list[int] = []
    at: list[int] = []
    size = 0

    def send() -> pa.RecordBatch:
        doc, line, ids = np.array(docs, np.int64), np.array(at, np.int32), np.fromiter(map(node, norms), np.int64, len(norms))
        order = np.lexsort((line, doc, ids))
        begin = np.flatnonzero(np.concatenate([[True], np.diff(ids[order]) != 0]))
        nodes = ids[order[begin]]
        fresh = np.array([i not in seen for i in nodes.tolist()], bool)
        if len(seen) + int(fresh.sum()) > SEEN:
            seen.clear()
        seen.update(nodes[fresh].tolist())
        norm = [norms[i] if new else None for i, new in zip(order[begin].tolist(), fresh.tolist(), strict=True)]
        of = pa.StructArray.from_arrays([pa.array(doc[order]), pa.array(line[order])], names=["doc_id", "line"])
        of = pa.ListArray.from_arrays(pa.array(np.concatenate([begin, [len(ids)]]), pa.int32()), of)
        for x in (norms, docs, at):
            x.clear()
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(norm, pa.string()), of], names=["node", "norm", "of"])

    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            for i, n in lines_of(text.as_py()):
                norms.append(n)
                docs.append(doc)
                at.append(i)
                size += len(n)
            if len(norms) >= HELD or size >= HELD_CHARS:
                yield send()
                size = 0
    if norms:
        yield send()


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, norm) -> (key, node), a row a band; a batch's lines are hashed at most BLOCK characters at a time."""
    for b in batches:
        ids = b.column(0).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(band_keys(b.column(1).to_pylist()).ravel()), pa.array(np.repeat(ids, BANDS))], names=["key", "node"])


def _shared(batches: Iterator[pa.RecordBatch], most: int = OPEN) -> Iterator[pa.RecordBatch]:
    """Rows (key, node) sorted by key -> those whose key has another node, in order, once each; a node may come again under a key of
    over `most` different nodes. Holds one batch and the nodes of one key, `most` at most."""
    none = np.zeros(0, np.int64)
    key, nodes, out = None, none, False  # the last key, its nodes that haven't been returned, and whether some have

    def rows(k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["key", "node"])

    for b in batches:
        k, n = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(k):
            continue
        begin = 0
        if key is not None:  # what the batch goes on with
            begin = int(np.searchsorted(k, key, "right"))
            nodes = np.union1d(nodes, n[:begin])
            if out and len(nodes) or len(nodes) > most or begin < len(k) and len(nodes) > 1:
                yield rows(np.full(len(nodes), key), nodes)
                nodes, out = none, True
            if begin == len(k):
                continue
        last = int(np.searchsorted(k, k[-1], "left"))
        key, nodes, out = k[-1], np.unique(n[last:]), False
        k, n = k[begin:last], n[begin:last]
        order = np.lexsort((n, k))
        k, n = k[order], n[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (n[1:] != n[:-1])])[: len(k)]
        k, n = k[new], n[new]
        same = k[1:] == k[:-1]
        keep = (np.concatenate([[False], same]) | np.concatenate([same, [False]]))[: len(k)]
        yield rows(k[keep], n[keep])
    if out and len(nodes) or len(nodes) > 1:
        yield rows(np.full(len(nodes), key), nodes)


def group_sums() -> list[Column]:
    """Columns that tell a key's set of nodes: a count and sums of 31 bits of hashes, which can't overflow."""
    return [F.count("*").alias("n"), *[F.sum(F.shiftrightunsigned(F.xxhash64("node", F.lit(i)), 33)).alias(f"x{i}") for i in range(4)]]


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Jaccard similarity of two sets of sorted distinct values."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return same >= least * (len(both) - same) - 1e-9


def similar_pairs(sets: list[np.ndarray], least: float = SIMILARITY, columns: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of similar sets among many: intersections of all pairs at once, as products of the sets' rows over the values that
    two of them hold, a bounded number of values at a time."""
    n = np.array([len(x) for x in sets])
    values, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    shared = np.cumsum(times > 1) - 1
    ok = times[where] > 1
    row, col = row[ok], shared[where[ok]]
    both, width = np.zeros((len(sets), len(sets)), np.float32), int((times > 1).sum())
    columns = min(columns, max(1, width))
    for at in range(0, width, columns):
        x = np.zeros((len(sets), columns), np.float32)
        part = (col >= at) & (col < at + columns)
        x[row[part], col[part] - at] = 1
        both += x @ x.T
    i, j = np.nonzero(np.triu(both >= least * (n[:, None] + n - both) - 1e-6, 1))
    return i, j


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, node, norm, chunk, cross) sorted by cell and node -> links (a, b) that span what is similar in each cell."""
    links: list[tuple[int, int]] = []
    cell, ids, sets, chunks, across = None, [], [], [], False

    def close() -> None:
        if len(ids) < 2 or len(ids) == 2 and not similar(*sets):
            return
        i, j = similar_pairs(sets) if len(ids) > 2 else (np.array([0]), np.array([1]))
        links.extend((ids[x], ids[y]) for x, y in zip(*(x.tolist() for x in spanning(len(ids), i, j, np.array(chunks), across)), strict=True))

    for b in batches:
        for c, i, n, chunk, cross in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), shingle_sets(b.column(2).to_pylist()), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
            if c != cell:
                close()
                cell, ids, sets, chunks, across = c, [], [], [], cross
            if not ids or ids[-1] != i:
                ids.append(i)
                sets.append(n)
                chunks.append(chunk)
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], names=["a", "b"])
            links.clear()
    close()
    if links:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], names=["a", "b"])


def similar_links(norms: DataFrame) -> DataFrame:
    """(a long, b long): links that connect the similar nodes of a stored table (node, norm); stored."""
    bands = norms.mapInArrow(_bands, "key long, node long").repartition("key").sortWithinPartitions("key")  # one long: a radix sort
    cand = cut(bands.mapInArrow(_shared, "key long, node long"), "line-candidates")
    sets = cand.groupBy("key").agg(*group_sums())
    groups = cut(sets.groupBy("n", "x0", "x1", "x2", "x3").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("n")), "line-groups")
    need = cut(cand.select("node").distinct(), "line-need")
    texts = cut(norms.join(small_side(need), "node", "left_semi").groupBy("node").agg(F.min("norm").alias("norm")), "line-texts", "zstd")
    cells = (  # a node meets its text once a key, before it is dealt to the cells of its group
        cut(cand.join(groups, "key"), "line-members").join(texts, "node")
        .withColumn("c", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select(F.xxhash64("key", F.least("c", "o"), F.greatest("c", "o")).alias("cell"), "node", "norm", F.col("c").alias("chunk"), (F.col("c") != F.col("o")).alias("cross"))
    )
    links = cut(cells.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(_verified, "a long, b long"), "line-links")
    forget(cand, groups, need, texts)
    return links


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, gone array<boolean>: whether each line up to the last such goes, of array<struct<line, kept_doc_id, kept_line>>) of
    documents that lose lines; stored."""
    plain = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lines = cut(plain.mapInArrow(_lines, LINES), "lines", "zstd")
    links = similar_links(lines.where("norm is not null").select("node", "norm"))
    comp = components(links, "line-cc")
    # of nodes that occur twice or have a link: the class, and its first line
    own = lines.select("node", F.get("of", F.lit(0)).alias("first"), F.size("of").cast("long").alias("n")).groupBy("node").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    own = cut(own.join(comp, "node", "left").where("n > 1 or root is not null").select("node", F.coalesce("root", "node").alias("root"), "first"), "line-nodes")
    first = cut(own.groupBy("root").agg(F.min("first").alias("first")), "line-first")
    known = cut(own.select("node", "root").join(first, "root").select("node", "first"), "line-known")
    again = lines.select("node", "of").join(small_side(known), "node").select(F.explode("of").alias("x"), "first").where("x != first")
    x = F.struct(F.col("x.line").alias("line"), F.col("first.doc_id").alias("kept_doc_id"), F.col("first.line").alias("kept_line"))
    of = again.select("x.doc_id", x.alias("x")).groupBy("doc_id").agg(F.array_sort(F.collect_set("x")).alias("of"))
    line = F.col("of.line")
    steps = F.arrays_zip(line.alias("at"), F.concat(F.array(F.lit(-1)), F.slice(line, F.lit(1), F.size("of") - 1)).alias("before"))
    flags = F.flatten(F.transform(steps, lambda s: F.concat(F.array_repeat(F.lit(False), s["at"] - s["before"] - 1), F.array(F.lit(True)))))
    out = cut(of.select("doc_id", flags.alias("gone"), "of"), "line-removals")
    forget(lines, links, comp, own, first, known)
    return out


def _kept(text, gone):
    """The text without the lines that gone marks, in one pass over them."""
    kept = F.filter(F.split(text, "\n"), lambda x, i: ~F.coalesce(F.get(gone, i), F.lit(False)))
    return F.when(gone.isNull(), text).otherwise(F.array_join(kept, "\n"))


def dedup(docs: DataFrame) -> DataFrame:
    """docs with only the first line of each class; every row and column stays."""
    of, marks = own_name(docs, "_gone_id"), own_name(docs, "_gone")
    gone = small_side(cut(removals(docs).select(F.col("doc_id").alias(of), F.col("gone").alias(marks)), "line-gone"))
    return docs.join(gone, F.col("doc_id") == F.col(of), "left").withColumn("text", _kept(F.col("text"), F.col(marks))).select(docs.columns)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, duplicates (line, and the document and line kept for it), kept_sha256."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    gone = small_side(removals(docs)).withColumnRenamed("doc_id", "_gone_id")
    n = F.when(F.col("text").isNull() | (F.col("text") == ""), 0).otherwise(F.size(F.split("text", "\n")))
    empty = F.array().cast("array<struct<line:int,kept_doc_id:bigint,kept_line:int>>")
    return docs.join(gone, F.col("doc_id") == F.col("_gone_id"), "left").select(
        "doc_id", n.cast("long").alias("n_lines"), F.coalesce(F.size("of"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("of", empty).alias("duplicates"), F.sha2(F.coalesce(_kept(F.col("text"), F.col("gone")), F.lit("")), 256).alias("kept_sha256")
    )
