"""Best-fit packing by length patterns: as few sequences of at most LIMIT tokens as can be had, without cutting what fits into one.

1. Texts are tokenised once; a row a piece (length, checksum, and its number among its task's pieces of that length) is stored.
2. The histogram of lengths below LIMIT, at most LIMIT - 1 rows, meets on the driver. Patterns of up to DEPTH pieces that fill a sequence exactly
   are enumerated, and repeat counts are fitted to the histogram by non-negative least squares (accelerated projected gradient; Krell et al. 2021
   pack by such patterns). Counts are rounded along their running sum, and cut back to the pieces there are. What is left is packed best-fit decreasing
   on the histogram, a group of like sequences at a time.
3. The plan is a list of slots (length, first rank, sequence, offset), bounded by LIMIT alone: at most about LIMIT^2 / 4 rows. A piece finds its slot from its rank
   among all pieces of its length, so no sequence is ever gathered: ranks are counts of the tasks before, plus the number in the task.

Tokenisation: words between white space are looked up in a table a worker fills as it goes; a word that isn't there goes to tokenizers. No rule of the tokenizer
reaches over white space, so ids are those of the whole text (tested).

Cases: a null text is empty and packs as its end id 0 alone; empty input gives no rows; repeated rows and rows that share an id are packed each on its own, rows
without an id with a null doc_id; texts longer than a sequence are cut into full pieces and a rest; words of a million characters are encoded whole; extra
columns are not read.
"""

from __future__ import annotations

import array
import bisect
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, earlier, read

LIMIT = 2048
#: Most pieces in an enumerated pattern, and steps of the fit.
DEPTH, STEPS = 3, 200
#: Characters of a text that are split into words at a time, entries of a worker's tables of words and of their parts, and bytes of a word that is kept.
SLICE, KEPT, PARTS_KEPT, KEPT_BYTES = 1 << 20, 3 << 18, 1 << 19, 64

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"
_TYPES = {"long": pa.int64(), "int": pa.int32()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in (c.split() for c in ddl.split(", "))])


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies use for each byte: itself where it prints, else the next one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordBpe(dict):
    """Ids of a text as little-endian uint32 bytes. Maps a word's UTF-8 bytes to its ids; a missing word is split as the tokenizer's file says and
    its parts are encoded by the tokenizer's model, or, outside printing Latin-1, the word by the tokenizer as a whole."""

    PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
    PLAIN = re.compile("[\x21-\x7e\xa1-\xff]*")
    SIMPLE = re.compile(rb"([a-z]+)([!-&(-/:-@\[-`{-~]*)")  # letters, then signs without an apostrophe

    def __init__(self, path: str | None = None):
        import public_tokenizers
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.tokenize, self.letters, self.parts = self.tokenizer.model.tokenize, _byte_letters(), {}

    def _part(self, part: bytes) -> bytes:
        letters = part.decode() if part.isascii() else part.decode("latin-1").translate(self.letters)  # printing ASCII stands for itself
        a = array.array("I", [t.id for t in self.tokenize(letters)])
        if sys.byteorder == "big":
            a.byteswap()
        if len(self.parts) >= PARTS_KEPT:
            self.parts.clear()
        self.parts[part] = got = a.tobytes()
        return got

    def __missing__(self, word: bytes) -> bytes:
        if len(word) > KEPT_BYTES:
            return self._whole(word.decode("utf-8", "replace"))
        parts = self.parts
        if m := self.SIMPLE.fullmatch(word.lower()):
            a, b = m.groups()
            got = parts.get(a) or self._part(a)
            if b:
                got += parts.get(b) or self._part(b)
        else:
            text = word.decode("utf-8", "replace")
            if self.PLAIN.fullmatch(text):
                got = b"".join([parts.get(p) or self._part(p) for p in map(str.encode, self.PARTS.findall(text.lower()))])
            else:
                got = self._whole(text)
        if len(self) >= KEPT:
            self.clear()
        self[word] = got
        return got

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        get = self.__getitem__
        if len(text) <= SLICE:
            return b"".join(map(get, text.encode("utf-8", "replace").split()))
        out, at = [], 0
        while at < len(text):
            end = at + SLICE
            if end < len(text):
                space = min((i for i in (text.find(c, end) for c in " \n\t\r") if i >= 0), default=len(text))
                end = space
            out.append(b"".join(map(get, text[at:end].encode("utf-8", "replace").split())))
            at = end
        return b"".join(out)


def patterns(lengths: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Rows of DEPTH descending lengths (0: none) that sum to limit."""
    s = np.asarray(lengths, np.int64)
    has = np.zeros(limit + 1, bool)
    has[s] = True
    i, j = (x.ravel() for x in np.meshgrid(s, s, indexing="ij"))
    k = limit - i - j
    ok = (i >= j) & (k >= 0) & (j >= k)
    i, j, k = i[ok], j[ok], k[ok]
    ok = (k == 0) | has[k]
    return np.stack([i[ok], j[ok], k[ok]], 1)


def fit(rows: np.ndarray, hist: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that minimise the squared distance of what they hold from hist."""

    def holds(x: np.ndarray) -> np.ndarray:
        h = np.bincount(rows.ravel(), np.repeat(x, rows.shape[1]), minlength=len(hist))
        h[0] = 0
        return h

    def back(r: np.ndarray) -> np.ndarray:
        return r[rows].sum(1)

    v, bound = np.ones(len(rows)), 1.0
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = back(holds(v))
        bound = float(np.linalg.norm(v))
        v /= bound
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        r = holds(y) - hist
        r[0] = 0
        new = np.maximum(y - back(r) / (1.02 * bound), 0)
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        x, y = new, new + (was - 1) / t * (new - x)
    return x


def best_fit(hist: np.ndarray, limit: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing on a histogram: (((length, copies), ...), sequences) of groups of like sequences. Each length adds at most two groups to
    those it passes, whatever its count."""
    groups: dict[int, list] = {}
    rooms: list[int] = []

    def add(room: int, held: tuple, n: int) -> None:
        if n:
            if room not in groups:
                groups[room] = []
                bisect.insort(rooms, room)
            groups[room].append((held, n))

    for l in range(len(hist) - 1, 0, -1):  # noqa: E741
        c = int(hist[l])
        while c:
            i = bisect.bisect_left(rooms, l)
            if i == len(rooms):
                full, part = divmod(c, limit // l)
                add(limit - limit // l * l, ((l, limit // l),), full)
                add(limit - part * l, ((l, part),), int(part > 0))
                break
            room = rooms[i]
            held, n = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(i)
            copies = min(room // l, c)
            k = min(n, c // copies)
            add(room, held, n - k)
            add(room - copies * l, held + ((l, copies),), k)
            c -= copies * k
    return [g for b in groups.values() for g in b]


def plan(hist: np.ndarray, limit: int = LIMIT) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Groups of like sequences that hold every piece of hist (pieces by length, below limit) once; fitted patterns first, then best-fit groups."""
    left, out = np.zeros(limit + 1, np.int64), []
    left[: len(hist)] = hist
    rows = patterns(np.flatnonzero(left), limit)
    if len(rows):
        x = fit(rows, left.astype(float))
        whole = np.floor(x)
        n = (whole + np.diff(np.floor(np.cumsum(x - whole) + 0.5), prepend=0)).astype(np.int64)
        for i in np.flatnonzero(n > 0):
            held: dict[int, int] = {}
            for l in rows[i].tolist():  # noqa: E741
                if l:
                    held[l] = held.get(l, 0) + 1
            k = min(int(n[i]), *(int(left[l]) // c for l, c in held.items()))
            if k > 0:
                for l, c in held.items():  # noqa: E741
                    left[l] -= c * k
                out.append((tuple(held.items()), k))
    return out + best_fit(left, limit)


class Slots:
    """A plan as arrays, to look places up by length and rank."""

    def __init__(self, groups: list):
        rows, seq = [], 0
        for held, n in groups:
            at = 0
            for l, copies in held:  # noqa: E741
                rows.append((l, copies, n * copies, seq, at))
                at += l * copies
            seq += n
        a = np.array(rows, np.int64).reshape(-1, 5)
        a = a[np.argsort(a[:, 0], kind="stable")]
        self.length, self.copies, self.seq, self.at = a[:, 0], a[:, 1], a[:, 3], a[:, 4]
        total = np.cumsum(a[:, 2]) - a[:, 2]
        start = np.searchsorted(self.length, self.length, "left")
        self.first = total - total[start] if len(a) else total  # rank of a slot's first piece among those of its length
        self.key = (self.length << 48) | self.first

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, (length << 48) | rank, "right") - 1
        nth, copy = np.divmod(rank - self.first[i], self.copies[i])
        return self.seq[i] + nth, self.at[i] + copy * length


def _tokenise(limit: int, path: str | None):
    held: list[WordBpe] = []
    schema = _schema(_PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(WordBpe(path))
        bpe, part, nth, rows = held[0], TaskContext.get().partitionId(), [0] * (limit + 1), []
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = memoryview((bpe.ids(text.as_py()) if text.is_valid else b"") + b"\0\0\0\0")
                for piece, start in enumerate(range(0, len(ids) // 4, limit)):
                    own = ids[4 * start : 4 * (start + limit)]
                    n = len(own) // 4
                    rows.append((doc, piece, start, n, zlib.crc32(own), part, nth[n]))
                    nth[n] += 1
                if len(rows) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """PACKED, a row a piece. Sequences of the plan are numbered from 0, pieces of exactly limit tokens have sequences of their own below 0."""
    pieces = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_tokenise(limit, path), _PIECES), "patternpack-pieces")
    short = pieces.where(F.col("length") < limit)
    hist = np.zeros(limit, np.int64)
    for length, n in short.groupBy("length").count().collect():  # at most limit - 1 rows
        hist[length] = n
    shared = docs.sparkSession.sparkContext.broadcast(Slots(plan(hist, limit)))  # bounded by limit alone
    tasks = short.groupBy("length", "part").agg(F.count("*").alias("n"))
    top = pieces.agg(F.max("part")).first()[0] or 0
    base = earlier(tasks, ["length"], "part", "n", "sum", top).select("length", "part", F.coalesce("_before", F.lit(0)).cast("long").alias("_before"))
    schema = _schema(PACKED)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(i).to_numpy() for i in (3, 5))
            seq, at = shared.value.places(length, rank)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(at)], schema=schema)

    ranked = short.join(base, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("nth")).alias("rank"))
    full = pieces.where(F.col("length") == limit)
    own = full.select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.shiftleft("part", 40) - F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return ranked.mapInArrow(place, PACKED).unionByName(own)


def op12_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
