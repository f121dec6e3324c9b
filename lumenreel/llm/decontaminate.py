"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark windows, one scan of each text.

Normal form: UTF-8 bytes, A-Z lower-cased, every ASCII byte that is not a letter or digit taken for a space; words are the runs
between. A pattern is a window of WORDS consecutive item words (an item of fewer words, but not none, is one window).

The automaton's letters are words: a node is a sequence of word numbers, so a window has as many nodes as words and not as
bytes. It is built level by level in arrays of 17 bytes a node (keys of the edges in order, failure link, nearest node with a
pattern, depth), once in a worker, and kept for the worker's later tasks. A text is scanned once; since no pattern has
over WORDS words, texts are cut into segments that begin WORDS - 1 words early, and all segments of a block step side by side.
A benchmark of more than NODES nodes is refused, never cut. Hit words are mapped back to code points of the original text.

Cases: a null or wordless text has no words and no hits; null or wordless items give no windows; items without an id count
for hits, but are not listed; repeated items count once by id; rows that share a doc_id are each answered; very long
texts are scanned whole, BLOCK words at a time; extra columns are not read by decontaminate() and are kept by clean(). An empty
benchmark leaves every document clean; no documents give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

WORDS = 10
#: Nodes of the automaton, at 17 bytes each; and bytes of benchmark text that are collected.
NODES, BENCHMARK_BYTES = 12_000_000, 64 << 20
#: Words of a segment, and words of texts that are scanned side by side.
SEGMENT, BLOCK = 96, 400_000

_KEEP = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_NORM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans array<struct<start:int,end:int>>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("hit_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORM).split() if text else []


class _Numbers(dict):
    """Word -> number from 1; 0 for a word that no window has."""

    def __missing__(self, word: bytes) -> int:
        return 0


class Automaton:
    """Aho-Corasick over sequences of word numbers."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int = WORDS):
        self.n, self.numbers = n, _Numbers()
        seqs = [(item, w) for item, text in items if (w := words_of(text))]
        for _, w in seqs:
            for x in w:
                if x not in self.numbers:
                    self.numbers[x] = len(self.numbers) + 1
        self.base = len(self.numbers) + 1
        flat = np.array([self.numbers[x] for _, w in seqs for x in w], np.int64)
        size = np.array([len(w) for _, w in seqs], np.int64)
        count = np.maximum(1, size - n + 1)
        item = np.repeat(np.arange(len(seqs)), count)
        at = (np.cumsum(size) - size)[item] + np.arange(len(item)) - (np.cumsum(count) - count)[item]
        length = np.minimum(n, size[item])
        # level by level: a node is a pair (parent, word); keys of later levels are larger, so all keys together are in order
        node, keys, level = np.zeros(len(item), np.int64), [], [0, 1]
        for d in range(n):
            on = np.flatnonzero(length > d)
            if not len(on):
                break
            key, where = np.unique(node[on] * self.base + flat[at[on] + d], return_inverse=True)
            node[on] = level[-1] + where
            keys.append(key)
            level.append(level[-1] + len(key))
            if level[-1] > NODES:
                raise ValueError(f"the benchmark's windows need over {NODES} nodes; raise NODES if workers have 17 bytes for each, or split the benchmark")
        self.keys = np.concatenate([np.zeros(0, np.int64), *keys])
        self.root = np.zeros(self.base, np.int32)
        if keys:
            self.root[keys[0]] = 1 + np.arange(len(keys[0]))
        self.depth = np.repeat(np.arange(len(level) - 1), np.diff(level)).astype(np.int8)
        # the items of the nodes that end a window
        self.names = [i for i, _ in seqs]
        order = np.lexsort((item, node))
        node, item = node[order], item[order]
        self.ends, first = np.unique(node, return_index=True)
        self.first, self.item = np.append(first, len(node)).astype(np.int32), item.astype(np.int32)
        self.fail, self.near = np.zeros(level[-1], np.int32), np.zeros(level[-1], np.int32)
        self.near[self.ends] = self.ends
        for d in range(1, len(level) - 1):
            own = np.arange(level[d], level[d + 1])
            if d > 1:
                parent, word = np.divmod(self.keys[own - 1], self.base)
                self.fail[own] = self.step(self.fail[parent], word)
            self.near[own] = np.where(self.near[own] > 0, own, self.near[self.fail[own]])

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states after a word each."""
        out = np.zeros(len(state), np.int32)
        todo = np.flatnonzero(word)
        s, w = state[todo].astype(np.int64), word[todo]
        while len(todo):
            begin = s == 0
            out[todo[begin]] = self.root[w[begin]]
            todo, s, w = todo[~begin], s[~begin], w[~begin]
            k = s * self.base + w
            at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            found = self.keys[at] == k
            out[todo[found]] = at[found] + 1
            todo, s, w = todo[~found], self.fail[s[~found]].astype(np.int64), w[~found]
        return out

    def matches(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the last word, node of the longest pattern that ends there), in texts that stand one after another."""
        if not len(self.keys) or not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        n = -(-lengths // SEGMENT)
        text = np.repeat(np.arange(len(lengths)), n)
        begin = (np.cumsum(lengths) - lengths)[text]
        own = begin + (np.arange(len(text)) - (np.cumsum(n) - n)[text]) * SEGMENT
        stop = np.minimum(own + SEGMENT, begin + lengths[text])
        start = np.maximum(begin, own - self.n + 1)
        order = np.argsort(start - stop, kind="stable")  # the longest first, so that those still running are a prefix
        own, stop, start = own[order], stop[order], start[order]
        state, places, nodes = np.zeros(len(start), np.int32), [], []
        left = np.searchsorted(-(stop - start), -np.arange(int((stop - start).max())), "left")
        for t, k in enumerate(left.tolist()):
            at = start[:k] + t
            state[:k] = self.step(state[:k], words[at])
            near = self.near[state[:k]]
            hit = np.flatnonzero((near > 0) & (at >= own[:k]))
            places.append(at[hit])
            nodes.append(near[hit])
        return np.concatenate(places), np.concatenate(nodes)

    def items_at(self, nodes: np.ndarray) -> list[str]:
        """Ids of the items whose windows end where these nodes' patterns do."""
        found: set[str] = set()
        todo = np.unique(nodes)
        while len(todo := todo[todo > 0]):
            for i in np.searchsorted(self.ends, todo).tolist():
                found.update(self.names[j] for j in self.item[self.first[i] : self.first[i + 1]].tolist())
            todo = np.unique(self.near[self.fail[todo]])
        return sorted(found - {None})

    def scan(self, texts: list[str | None]) -> list[tuple[int, np.ndarray | None, list[str]]]:
        """For each text: its words, a hit flag for each word or None, and the item ids with occurring windows."""
        out: list[tuple[int, np.ndarray | None, list[str]]] = []
        held: list[list[bytes]] = []
        size = 0

        def flush() -> None:
            lengths = np.array([len(w) for w in held], np.int64)
            words = np.fromiter((x for w in held for x in map(self.numbers.__getitem__, w)), np.int64, int(lengths.sum()))
            place, node = self.matches(words, lengths)
            order = np.argsort(place, kind="stable")
            place, node = place[order], node[order]
            end = np.cumsum(lengths)
            cut = np.searchsorted(place, np.concatenate([[0], end]))
            for i, w in enumerate(held):
                p, q = place[cut[i] : cut[i + 1]], node[cut[i] : cut[i + 1]]
                if not len(p):
                    out.append((len(w), None, []))
                    continue
                last = p - (end[i] - len(w))
                mark = np.zeros(len(w) + 1, np.int64)
                np.add.at(mark, last + 1 - self.depth[q], 1)
                np.add.at(mark, last + 1, -1)
                out.append((len(w), np.cumsum(mark[:-1]) > 0, self.items_at(q)))
            held.clear()

        for t in texts:
            held.append(words_of(t))
            size += len(held[-1])
            if size >= BLOCK:
                flush()
                size = 0
        if held:
            flush()
        return out


_BUILT: dict[tuple[int, str, int], Automaton] = {}


def automaton(shared, n: int) -> Automaton:
    """The automaton of a broadcast benchmark, built once in a worker; a worker keeps one."""
    items = shared.value
    key = (len(items), hashlib.sha256(repr(items).encode("utf-8", "surrogatepass")).hexdigest(), n)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(items, n)
    return _BUILT[key]


def spans_of(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words as code-point offsets of the original text, end exclusive."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [(m.start(), m.end()) for m in _KEEP.finditer(raw.translate(_NORM))]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    b = np.frombuffer(raw, np.uint8)
    point = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])  # code points before each byte
    return [{"start": int(point[at[i][0]]), "end": int(point[at[j - 1][1]])} for i, j in edge.reshape(-1, 2)]


def _items(benchmark: DataFrame) -> list[tuple[str | None, str]]:
    """The benchmark's items, after a check of their size."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > BENCHMARK_BYTES:
        raise ValueError(f"benchmark texts hold {size} bytes; raise BENCHMARK_BYTES or split the benchmark")
    return [(r[0], r[1]) for r in benchmark.where("text is not null").select(F.col("item_id").cast("string"), F.col("text").cast("string")).collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WORDS) -> DataFrame:
    """One row per document row: SCHEMA. A narrow scan of docs; only the size-checked benchmark is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(_items(benchmark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(shared, n)
        for batch in batches:
            cols: list[list] = [[] for _ in _ARROW]
            texts = batch.column(1).to_pylist()
            for doc, text, (count, hit, items) in zip(batch.column(0).to_pylist(), texts, auto.scan(texts), strict=True):
                row = (doc, count, int(hit.sum()) if hit is not None else 0, len(items), hashlib.sha256(",".join(items).encode("utf-8", "surrogatepass")).hexdigest(), hit is not None, spans_of(text, hit) if hit is not None else [])
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, n: int = WORDS) -> DataFrame:
    """docs, all columns, without the rows in which a benchmark window occurs."""
    shared, at = docs.sparkSession.sparkContext.broadcast(_items(benchmark)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(shared, n)
        for batch in batches:
            yield batch.filter(pa.array([hit is None for _, hit, _ in auto.scan(batch.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("hit_spans")


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(list_slice(w, i + 1, i + least(10, len(w))), ' ') AS k FROM b, LATERAL (SELECT unnest(range(greatest(1, len(w) - 9))) AS i) WHERE len(w) > 0),
o AS (SELECT r, i, l.n, array_to_string(list_slice(w, i + 1, i + l.n), ' ') AS k FROM d, (SELECT DISTINCT n FROM p) l, LATERAL (SELECT unnest(range(greatest(0, len(w) - l.n + 1))) AS i)),
h AS (SELECT r, i, o.n, item FROM o JOIN p ON o.k = p.k AND o.n = p.n),
c AS (SELECT r, count(DISTINCT j) AS n_hit FROM h, LATERAL (SELECT unnest(range(i, i + n)) AS j) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
