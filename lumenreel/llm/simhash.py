"""SimHash near-duplicates: exact links at up to 3 differing bits through a Gray-ordered hierarchical Hamming index.

Fingerprints (64 bits over word shingles) are reduced to distinct values first, so copies cost nothing. The index is
partitioned by shared bits: 5 blocks of 12 or 13 bits; two fingerprints that differ in at most 3 bits agree on at
least 2 blocks, so each of the 10 pairs of blocks gives a table keyed by those bits. In a key's group fingerprints are
sorted by Gray rank; runs of neighbours (two, in large groups LEAF) are leaves, and every upper node keeps the bits its whole subtree shares
(mask and pattern). Pairs of nodes are searched from the root: the shared bits of both that differ are the differences
accumulated so far, and a pair over the limit is pruned with everything below. A group of over CHUNK fingerprints is
dealt to cells of two chunks each, so no task holds more than two chunks of a group; a cell returns a spanning forest
of its links, never all of them. Components of the forests come from distributed union-find.

Where a least similarity is asked for, pairs whose sets of word shingles have that Jaccard similarity are linked too. Their fingerprints may
differ in more bits than blocks can find, so candidates share a MinHash band (linededup's BANDS and ROWS), and each is checked on its sets.

Cases: null and wordless texts have fingerprint zero and are linked like any other; rows with the same id share what
they link to; a null id stays in the result and is never a class id (null if a class has none else); empty tables
give no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import linededup
from .common import components, cut, forest, forget, own_name, read, small_side, spanning

WORDS, SEED, BITS = 3, 42, 3
#: Groups of up to SMALL fingerprints have leaves of two and are searched together; larger ones have leaves of LEAF, one tree at a time.
LEAF, SMALL, CHUNK = 16, 64, 2048
_BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


MASKS = [_signed(sum(((1 << n) - 1) << at for at, n in (a, b))) for i, a in enumerate(_BLOCKS) for b in _BLOCKS[i + 1 :]]


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def _shingles(words: list[bytes], n: int) -> Iterator[np.ndarray]:
    """64-bit hashes of a text's shingles in order, in blocks; the text has words."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(n, len(words))
    stop = ends[k - 1 :].tolist()
    start = [0, *(ends[: len(words) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(start), 65_536):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(start[at : at + 65_536], stop[at : at + 65_536], strict=True)], "<u8")


def _majority(blocks: Iterable[np.ndarray]) -> int:
    ones, count = np.zeros(64, np.int64), 0
    for h in blocks:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        count += len(h)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, n: int = WORDS) -> int:
    """Unsigned 64-bit SimHash; words are runs without ASCII white space, shingles count as often as they occur."""
    words = _words(text)
    return _majority(_shingles(words, n)) if words else 0


def fingerprints(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """(doc_id long, fp long) for every row; fp holds the 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), n) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(c: Column) -> Column:
    """The position of a 64-bit pattern in the reflected Gray code: each bit is the parity of the bits from it up."""
    return reduce(lambda x, k: x.bitwiseXOR(F.shiftrightunsigned(x, k)), (1, 2, 4, 8, 16, 32), c)


def _within(pattern: np.ndarray, mask: np.ndarray, x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    """Whether the bits that node x's whole subtree shares differ from those of node y in at most limit places."""
    return np.bitwise_count((pattern[x] ^ pattern[y]) & mask[x] & mask[y]) <= limit


def _rows(offsets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, place in its group) of every row of groups that lie one behind the other."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - offsets[group]


def group_links(fp: np.ndarray, starts: np.ndarray | None = None, limit: int = BITS, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j), i before j, within groups of Gray-ordered fingerprints (uint64); starts are the groups' first rows (none: one group).

    Every group has a tree of its own, and the trees of all groups are built and searched level by level together."""
    starts = np.zeros(1, np.int64) if starts is None else np.asarray(starts, np.int64)
    size = np.diff(np.append(starts, len(fp)))
    count = -(-size // leaf)
    offset = np.cumsum(count) - count
    group, place = _rows(offset, count)
    at = (starts[group] + place * leaf)[:, None] + np.arange(leaf)
    end = (starts + size)[group][:, None]
    real, members = at < end, fp[np.minimum(at, end - 1)]
    ones, zeros = np.bitwise_and.reduce(members, 1), ~np.bitwise_or.reduce(members, 1)
    levels = [(ones, ones | zeros)]  # pattern of the shared bits, mask of the shared bits
    roots, children = [offset[count == 1]], [None]
    while (more := count > 1).any():  # groups whose root stands take no part any more
        offset, count = offset[more], count[more]
        upper = -(-count // 2)
        above = np.cumsum(upper) - upper
        group, place = _rows(above, upper)
        left = offset[group] + 2 * place
        right = np.minimum(left + 1, (offset + count - 1)[group])
        pattern, mask = levels[-1]
        both = mask[left] & mask[right] & ~(pattern[left] ^ pattern[right])
        levels.append((pattern[left] & both, both))
        children.append((left, right))
        offset, count = above, upper
        roots.append(offset[count == 1])
    x = y = np.zeros(0, np.int64)
    for (pattern, mask), root, below in zip(levels[::-1], roots[::-1], children[::-1], strict=True):
        x, y = np.concatenate([x, root]), np.concatenate([y, root])
        near = _within(pattern, mask, x, y, limit)
        x, y = x[near], y[near]
        if below is not None:
            left, right = below
            x2, y2 = right[x] > left[x], right[y] > left[y]
            turned = x2 & (x != y)  # a node met with itself needs its two children in one order only
            x, y = (
                np.concatenate([left[x], left[x[y2]], right[x[turned]], right[x[x2 & y2]]]),
                np.concatenate([left[y], right[y[y2]], left[y[turned]], right[y[x2 & y2]]]),
            )
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max((1 << 20) // leaf**2, 1)
    for k in range(0, len(x), step):
        p, q = x[k : k + step], y[k : k + step]
        c, i, j = np.nonzero((np.bitwise_count(members[p][:, :, None] ^ members[q][:, None, :]) <= limit) & real[p][:, :, None] & real[q][:, None, :])
        i, j = at[p[c], i], at[q[c], j]
        ok = i < j
        out_a.append(i[ok])
        out_b.append(j[ok])
    return np.concatenate(out_a), np.concatenate(out_b)


def _tree_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, fp) sorted by cell and Gray rank -> spanning links (a, b) of each cell."""

    def of(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(cell[1:] != cell[:-1]) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(cell)]])
        size = ends - starts
        few = np.repeat((size > 1) & (size <= SMALL), size)
        at = np.flatnonzero(few)
        i, j = group_links(fp[at], np.flatnonzero(np.diff(cell[at], prepend=cell[at][:1] - 1)), leaf=2)
        a, b = [at[i]], [at[j]]
        for s, e in zip(starts[size > SMALL], ends[size > SMALL], strict=True):
            i, j = group_links(fp[s:e])
            a.append(i + s)
            b.append(j + s)
        root = forest(len(fp), np.concatenate(a), np.concatenate(b))
        i = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[i].view(np.int64)), pa.array(fp[root[i]].view(np.int64))], names=["a", "b"])

    cell, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        cell = np.concatenate([cell, batch.column(0).to_numpy()])
        fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
        if len(cell) > 100_000 and cell[0] != cell[-1]:
            k = int(np.flatnonzero(cell != cell[-1])[-1]) + 1
            yield of(cell[:k], fp[:k])
            cell, fp = cell[k:].copy(), fp[k:].copy()
    if len(cell):
        yield of(cell, fp)


def links(distinct: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a long, b long): links that connect what links at up to BITS bits connect, from distinct(fp long)."""
    tables = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(MASKS)])).alias("x")).select("fp", "x.t", "x.key")
    hot = small_side(cut(tables.groupBy("t", "key").count().where(F.col("count") > chunk), "simhash-hot"))
    n = F.coalesce(F.ceil(F.col("count") / chunk).cast("int"), F.lit(1))
    cells = (
        tables.join(hot, ["t", "key"], "left")
        .withColumn("n", n)
        .withColumn("c", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select(F.xxhash64("t", "key", F.least("c", "o"), F.greatest("c", "o")).alias("cell"), "fp")
    )
    return cells.repartition("cell").sortWithinPartitions("cell", gray_rank(F.col("fp")), "fp").mapInArrow(_tree_links, "a long, b long")


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """int64[band] of one set."""
    v = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.array([(v * a).min() for a in linededup._ODD], np.uint64).reshape(linededup.BANDS, linededup.ROWS)
    x = np.arange(1, linededup.BANDS + 1, dtype=np.uint64)
    for column in least.T:
        x = linededup._mix(x * linededup._M + column)
    return x.view(np.int64)


HASHED = "doc_id long, fp long, node long, text_hash long, keys array<long>"


def hashed(docs: DataFrame, n: int) -> DataFrame:
    """HASHED for every row: the fingerprint, a hash of the words and one of the text, and the MinHash band keys of the shingles, from one
    computation of their hashes; node is null and keys are empty without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, nodes, keys = [], [], []
            for t in b.column(1):
                if words := _words(t.as_py()):
                    h = list(_shingles(words, n))
                    fps.append(_signed(_majority(h)))
                    nodes.append(_signed(xxhash.xxh64_intdigest(b" ".join(words))))
                    keys.append(band_keys(np.unique(np.concatenate(h))))
                else:
                    fps.append(0)
                    nodes.append(None)
                    keys.append(np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), pa.array(nodes, pa.int64()), b.column(2), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "fp", "node", "text_hash", "keys"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(run, HASHED)


def similar_links(docs: DataFrame, table: DataFrame, n: int, least: float) -> DataFrame:
    """(a long, b long): links between the fingerprints of texts whose shingle sets have a Jaccard similarity of least or more; table is hashed(docs),
    stored. Only texts that share a band with another are read again; stored."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for t in b.column(0):
                if not (words := _words(t.as_py())):
                    continue
                h = list(_shingles(words, n))
                got.append((_signed(xxhash.xxh64_intdigest(b" ".join(words))), _signed(_majority(h)), np.unique(np.concatenate(h)).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([g[j] for g in got], k) for j, k in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["node", "fp", "shingles"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, fps, found, chunks, across = None, [], [], [], False

        def of() -> pa.RecordBatch:
            fp = np.array(fps, np.int64)
            i, j = spanning(len(fp), *linededup.similar_pairs(found, least), np.array(chunks), across)
            return pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[j])], names=["a", "b"])

        for b in batches:
            for c, f, x, chunk, cross in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if c != cell:
                    if len(fps) > 1:
                        yield of()
                    cell, fps, found, chunks, across = c, [], [], [], cross
                fps.append(f)
                found.append(np.frombuffer(x.as_py(), np.uint64))
                chunks.append(chunk)
        if len(fps) > 1:
            yield of()

    keys = table.select(F.explode("keys").alias("key"), "node").repartition("key").sortWithinPartitions("key")
    cand = cut(keys.mapInArrow(linededup._shared, "key long, node long"), "simhash-candidates")
    groups = cand.groupBy("key").agg(*linededup.group_sums())
    groups = cut(groups.groupBy("n", "x0", "x1", "x2", "x3").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / linededup.CHUNK).cast("int").alias("n")), "simhash-groups")
    need = cut(cand.select("node").distinct(), "simhash-need")
    wanted = cut(table.select("node", "text_hash").join(small_side(need), "node", "left_semi").select("text_hash").distinct(), "simhash-wanted")
    text = docs.select(F.col("text").cast("string").alias("text")).where("text is not null").withColumn("text_hash", F.xxhash64("text"))
    again = text.join(small_side(wanted), "text_hash", "left_semi").select("text")
    known = cut(again.mapInArrow(sets, "node long, fp long, shingles binary").groupBy("node").agg(F.min("fp").alias("fp"), F.min("shingles").alias("shingles")), "simhash-sets")
    cells = (  # a node meets its set once a key, before it is dealt to the cells of its group
        cut(cand.join(groups, "key"), "simhash-members").join(known, "node")
        .withColumn("c", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select(F.xxhash64("key", F.least("c", "o"), F.greatest("c", "o")).alias("cell"), "fp", "shingles", F.col("c").alias("chunk"), (F.col("c") != F.col("o")).alias("cross"))
    )
    # links of texts: at most a spanning forest of each cell
    links = cut(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(verified, "a long, b long"), "simhash-links")
    forget(cand, groups, need, wanted, known)
    return links


def _classes(docs: DataFrame, n: int, least: float | None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (fp, n_copies, class, component_id): class is a fingerprint of the component. Both are stored, so that
    the partition of a fingerprint that very many rows share can be split where they are joined."""
    fps = cut(fingerprints(docs, n) if least is None else hashed(docs, n), "simhash-fp")
    reps = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies")), "simhash-reps")
    near = links(reps.select("fp"))
    comp = components(near if least is None else near.union(similar_links(docs, fps, n, least)), "simhash-cc")
    own = cut(reps.join(comp, comp.node == reps.fp, "left").select("fp", "rep", "n_copies", F.coalesce("root", "fp").alias("class")), "simhash-own")
    first = cut(own.groupBy("class").agg(F.min("rep").alias("component_id")), "simhash-first")
    classes = cut(own.join(first, "class").select("fp", "n_copies", "class", "component_id"), "simhash-of")
    forget(comp, own, first, reps)
    return fps.select("doc_id", "fp"), classes


def near_duplicates(docs: DataFrame, n: int = WORDS, least: float | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_copies): one row per document row. With least, texts of that similarity are linked too."""
    fps, classes = _classes(docs, n, least)
    return fps.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_copies")


def keep_one(docs: DataFrame, n: int = WORDS, least: float | None = None) -> DataFrame:
    """docs without the rows whose id isn't the least of their class; of rows that share an id and a class one stays, rows without an id all."""
    fps, classes = _classes(docs, n, least)
    found = cut(fps.join(classes, "fp").select("doc_id", "fp", "class", "component_id"), "simhash-classes")
    if found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        gone = cut(found.where("doc_id != component_id").select("doc_id").distinct(), "simhash-gone")
        return docs.join(small_side(gone), "doc_id", "left_anti").select(docs.columns)
    at, own = docs.columns.index("text"), own_name(docs, "_fp")

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), n) for t in b.column(at)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp)], names=[*b.schema.names, own])

    stay = cut(found.where("doc_id = component_id").groupBy("doc_id", "class").agg(F.min("fp").alias(own)).select("doc_id", own), "simhash-stay")
    rows = docs.where("doc_id is not null").mapInArrow(marked, StructType([*docs.schema.fields, StructField(own, LongType())]))
    kept = rows.join(stay, ["doc_id", own], "left_semi").dropDuplicates(["doc_id", own]).select(docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
