"""Phrase collocation mining: contiguous phrases that are much more frequent than their parts, in each language.

1. Sketch. Each task hashes all its words and phrases into a count-min sketch of one row (CELLS saturating 8-bit counters, a fixed size) and sends its blocks;
   blocks are summed, and a bit a cell, whether it reached the least count, is all that goes on: CELLS / 8 bytes, a broadcast of a fixed size. A phrase whose
   bit, or a part's, is clear can't be frequent enough; a wider sketch lets fewer others pass, and results don't depend on it.
2. Scan. A task reads its texts in shards of about SHARD words. The phrases of a shard whose bit is set are compiled into one pyahocorasick automaton a language. Words
   are spelled by their numbers, and a delimiter that is in no phrase stands between pieces, so that no match starts within a word or reaches over a delimiter. The
   automaton counts all matches, overlaps included. Counts of shards are summed in a shuffle; only then the threshold applies.
3. Scores. Each candidate meets the counts of its parts in one join on (language, part); a stored table on both sides lets a part that is in very many candidates
   be split. Arithmetic is in decimals of 38 digits, exact while counts stay below 10^16.

Automata hold a shard's candidates only, so memory doesn't grow with the corpus or its candidates.

Cases: null and wordless texts have no words; a null language is `und`; repeated rows count each; words that aren't valid UTF-8 count by their bytes; equal scores go by the
count, then by the phrase; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read, small_side

LONGEST, LEAST, TOP, INSIDE = 3, 10, 2000, 50
#: log2 of the sketch's cells, and of a block's.
CELLS, BLOCK = 27, 16
#: Words of a shard, different words at which it ends too, bytes split at a time, and symbols scanned at a time.
SHARD, DIFFERENT, SLICE, STEP = 6_000_000, 1 << 20, 1 << 20, 250_000

#: What becomes of each byte: A-Z lower case, tab a space, a delimiter 0xFF, which is in no UTF-8 text.
_TABLE = bytes(0xFF if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_EDGE = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_BITS = 21  # of a word's number in a shard
_DIGIT = 6  # of a letter that spells word numbers for the automaton

_COUNTS = "lang string, words int, phrase binary, n long"
_ARROW = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.binary()), ("n", pa.int64())])


class _Words(dict):
    """Numbers words as they come; 0 is the delimiter."""

    def __init__(self):
        super().__init__({b"\xff": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Shard:
    """Texts as word numbers, one array a language. `skip` of its first symbols were counted by the shard before."""

    def __init__(self, context: dict[str, list[bytes]] | None = None):
        self.numbers, self.arrays, self.skip, self.size = _Words(), {}, {}, 0
        for lang, words in (context or {}).items():
            self.arrays[lang] = [np.array([self.numbers[w] for w in words], np.int32)]
            self.skip[lang] = len(words)

    def add(self, lang: str, data: bytes) -> None:
        words = data.translate(_TABLE).replace(b"\xff", b" \xff ").split()
        self.arrays.setdefault(lang, []).append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def full(self) -> bool:
        return self.size >= SHARD or len(self.numbers) >= DIFFERENT

    def languages(self) -> Iterator[tuple[str, np.ndarray, int]]:
        for lang, parts in self.arrays.items():
            yield lang, np.concatenate(parts), self.skip.get(lang, 0)

    def tail(self, lang: str, longest: int) -> list[bytes]:
        """The last words of a text that goes on in the next shard."""
        codes = np.concatenate(self.arrays[lang])[-(longest - 1) :] if longest > 1 else np.zeros(0, int)
        names = list(self.numbers)
        zeros = np.flatnonzero(codes == 0)
        return [names[c] for c in codes[zeros[-1] + 1 if len(zeros) else 0 :].tolist()]

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, self.numbers), np.uint64, len(self.numbers))


def shards(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[Shard]:
    """Shards of (lang, text as bytes); a delimiter stands between texts. Texts are split a slice at a time, however long they are."""
    shard = Shard()
    for b in batches:
        waiting: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if not text.is_valid:
                continue
            data = text.as_py()
            if len(data) > SLICE:
                at = 0
                while at < len(data):
                    edge = _EDGE.search(data, at + SLICE)
                    end = edge.start() if edge else len(data)
                    shard.add(lang, (b"\xff" if at == 0 else b"") + data[at:end] + (b"\xff" if end == len(data) else b""))
                    at = end
                    if shard.full():
                        context = {lang: shard.tail(lang, longest)} if at < len(data) else None
                        yield shard
                        shard = Shard(context)
                continue
            waiting.setdefault(lang, [b""]).append(data)
            sizes[lang] = sizes.get(lang, 0) + len(data)
            if sizes[lang] >= SLICE:
                shard.add(lang, b"\xff".join([*waiting.pop(lang), b""]))
                del sizes[lang]
                if shard.full():
                    yield shard
                    shard = Shard()
        for lang, data in waiting.items():
            shard.add(lang, b"\xff".join([*data, b""]))
        if shard.full():
            yield shard
            shard = Shard()
    if shard.arrays:
        yield shard


def _grams(codes: np.ndarray, k: int, skip: int) -> np.ndarray:
    """First places of the k-word phrases that end at `skip` or later."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ok = codes[:n] > 0
    for i in range(1, k):
        ok &= codes[i : n + i] > 0
    ok[: max(0, skip - k + 1)] = False
    return np.flatnonzero(ok).astype(np.int32)


def _cells(codes: np.ndarray, first: np.ndarray, k: int, hashes: np.ndarray, lang: str, cells: int) -> np.ndarray:
    out, start = np.empty(len(first), np.uint32), np.uint64(xxhash.xxh64_intdigest(lang.encode(), k))
    for at in range(0, len(first), STEP):  # so that what is held beside `out` stays small
        own = first[at : at + STEP]
        h = np.full(len(own), start, np.uint64)
        for i in range(k):
            h += hashes[codes[own + i]] * _MULTIPLIERS[i]
            h ^= h >> np.uint64(29)
            h *= _MULTIPLIERS[5]
        out[at : at + STEP] = (h ^ (h >> np.uint64(32))) >> np.uint64(64 - cells - 3) & np.uint64((1 << cells) - 1)
    return out


def _plain(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))


def sketch(plain: DataFrame, longest: int, least: int, cells: int = CELLS) -> np.ndarray:
    """A bit for each cell, packed: whether words and phrases of up to `longest` words that fall into it number `least` or more."""
    block = min(BLOCK, cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << cells, np.uint8)
        for shard in shards(batches, longest):
            hashes = shard.hashes()
            for lang, codes, skip in shard.languages():
                for k in range(1, longest + 1):
                    got, n = np.unique(_cells(codes, _grams(codes, k, skip), k, hashes, lang, cells), return_counts=True)
                    table[got] = np.minimum(table[got] + n, 255)  # n is wider, so the sum doesn't wrap
        pack = zstandard.ZstdCompressor(level=1)
        for i in range(1 << (cells - block)):
            own = table[i << block : (i + 1) << block]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pack.compress(own.tobytes())], pa.binary())], names=["block", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, open_ = None, None, zstandard.ZstdDecompressor()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(held >= least).tobytes()], pa.binary())], names=["block", "bits"])

        for b in batches:
            for i, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = np.frombuffer(open_.decompress(data.as_py()), np.uint8)
                if i != at:
                    if at is not None:
                        yield out()
                    at, held = i, own.astype(np.uint16)
                else:
                    held = np.minimum(held + own, 255)
        if at is not None:
            yield out()

    summed = plain.mapInArrow(count, "block int, counts binary").repartition("block").sortWithinPartitions("block").mapInArrow(total, "block int, bits binary")
    bits = np.zeros((1 << cells) // 8, np.uint8)
    size = (1 << block) // 8
    for i, data in summed.collect():  # a fixed number of blocks, CELLS / 8 bytes in all
        bits[i * size : (i + 1) * size] = np.frombuffer(data, np.uint8)
    return bits


def _symbols(numbers: np.ndarray, digits: int) -> str:
    """Word numbers as text of so many letters each, one alphabet a place, so that a match can't start within a word; 0 is a delimiter in each place."""
    places = [np.where(numbers > 0, 0x100 * (i + 1) + ((numbers >> (_DIGIT * (digits - 1 - i))) & ((1 << _DIGIT) - 1)), 1) for i in range(digits)]
    return np.stack(places, -1).astype("<u4").tobytes().decode("utf-32-le")


def _matches(codes: np.ndarray, keys: np.ndarray, k_of: np.ndarray, skip: int, longest: int) -> np.ndarray:
    """Occurrences of each phrase (keys: its word numbers, _BITS each, first word highest) that end at `skip` or later, overlaps included.

    Words that are in no phrase stand as delimiters; the others are numbered anew, frequent ones first, and spelled in letters of a small alphabet, since
    the automaton looks through the branches of a node one by one."""
    low = (1 << _BITS) - 1
    words = [np.stack([(keys[k_of == k] >> (_BITS * i)) & low for i in range(k - 1, -1, -1)], -1) for k in range(2, longest + 1)]
    used = np.unique(np.concatenate([w.ravel() for w in words]))
    seen = np.bincount(codes, minlength=int(codes.max(initial=0)) + 1)
    number = np.zeros(len(seen), np.int64)
    number[used[np.argsort(-seen[used], kind="stable")]] = np.arange(1, len(used) + 1)
    digits = 1
    while len(used) >> (_DIGIT * digits):
        digits += 1
    machine, v = ahocorasick.Automaton(ahocorasick.STORE_INTS), 0
    for k, w in enumerate(words, 2):
        text, size = _symbols(number[w].ravel(), digits), k * digits
        for i in range(len(w)):
            machine.add_word(text[i * size : (i + 1) * size], v)
            v += 1
    machine.make_automaton()
    counts, codes = np.zeros(len(keys), np.int64), number[codes]
    for at in range(0, len(codes), STEP):
        start = max(0, at - longest + 1)
        found = np.fromiter(chain.from_iterable(machine.iter(_symbols(codes[start : at + STEP], digits))), np.int64).reshape(-1, 2)
        counts += np.bincount(found[found[:, 0] >= (max(at, skip) - start) * digits, 1], minlength=len(keys))
    return counts


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, cells: int = CELLS) -> DataFrame:
    """(lang, words, phrase, n), stored: words and phrases of up to `longest` (4 at most, as a phrase of one more wouldn't fit a number) words that occur
    `least` times or more (255 at most), and a row with words = 0 a language with the number of its words."""
    if not (2 <= longest and _BITS * longest <= 63 and 1 <= least <= 255):
        raise ValueError("phrases of 2 or 3 words, occurring 1 to 255 times at least")
    plain = _plain(docs)
    shared = docs.sparkSession.sparkContext.broadcast(sketch(plain, longest, least, cells))  # a fixed size

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for shard in shards(batches, longest):
            hashes, names = shard.hashes(), list(shard.numbers)
            for lang, codes, skip in shard.languages():
                rows_n, rows_k, rows_p = [int((codes[skip:] > 0).sum())], [0], [b""]
                keys, sizes = [], []
                for k in range(1, longest + 1):
                    first = _grams(codes, k, skip)
                    c = _cells(codes, first, k, hashes, lang, cells)
                    passes = (bits[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 > 0
                    if k > 1:  # what is frequent has frequent parts
                        passes &= often[first] & often[first + 1]
                    first = first[passes]
                    often = np.zeros(len(codes) + 1, bool)
                    often[first] = True
                    if k == 1:  # single words are counted as they are; only phrases need an automaton
                        got, n = np.unique(codes[first], return_counts=True)
                        rows_n += n.tolist()
                        rows_k += [1] * len(got)
                        rows_p += [names[i] for i in got.tolist()]
                        continue
                    key = np.zeros(len(first), np.int64)
                    for i in range(k):
                        key = (key << _BITS) | codes[first + i]
                    keys.append(np.unique(key))
                    sizes.append(np.full(len(keys[-1]), k))
                keys, sizes = np.concatenate(keys), np.concatenate(sizes)
                if len(keys):
                    counts = _matches(codes, keys, sizes, skip, longest)
                    low = (1 << _BITS) - 1
                    rows_n += counts.tolist()
                    rows_k += sizes.tolist()
                    rows_p += [b" ".join([names[(key >> (_BITS * i)) & low] for i in range(k - 1, -1, -1)]) for key, k in zip(keys.tolist(), sizes.tolist(), strict=True)]
                for i in range(0, len(rows_n), 50_000):
                    own = slice(i, i + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows_n[own]), pa.string()), pa.array(rows_k[own], pa.int32()), pa.array(rows_p[own], pa.binary()), pa.array(rows_n[own], pa.int64())], schema=_ARROW)

    counts = plain.mapInArrow(scan, _COUNTS).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).where(f"n >= {int(least)} or words = 0")
    return cut(counts.select("lang", "words", F.col("phrase").cast("string").alias("phrase"), "n"), "collocations-counts")


def mine(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, inside: int = INSIDE, cells: int = CELLS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best `top` phrases. l and r are the counts of the two parts of the lowest-scoring cut, of equal
    ones the first; a phrase that `inside` % or more of go into one longer candidate is left out."""
    known = phrase_counts(docs, longest, least, cells)
    words = F.split("phrase", " ")
    spans = [(s, m, k) for k in range(2, longest + 1) for s in range(k) for m in range(1, k - s + 1) if m < k and (s == 0 or s + m == k or m > 1)]
    part = F.filter(F.array(*[F.when(F.col("words") == k, F.struct(F.lit(s).alias("s"), F.lit(m).alias("m"), F.array_join(F.slice(words, s + 1, m), " ").alias("part"))) for s, m, k in spans]), lambda x: x.isNotNull())
    parts = known.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(part).alias("x")).select("lang", "phrase", "words", "a", "x.*")
    counts = known.where("words > 0").select(F.col("lang").alias("_l"), F.col("phrase").alias("_p"), F.col("n").alias("f"))
    met = parts.join(counts, (F.col("lang") == F.col("_l")) & (F.col("part") == F.col("_p")))
    # each row tells its phrase a part's count, and the part, if it is a phrase too, whether it goes into this one
    c = range(1, longest)
    own = F.struct(F.col("phrase").alias("phrase"), F.col("a").alias("a"), F.col("words").alias("words"), *[F.when((F.col("s") == 0) & (F.col("m") == k), F.col("f")).alias(f"l{k}") for k in c], *[F.when((F.col("s") == k) & (F.col("s") + F.col("m") == F.col("words")), F.col("f")).alias(f"r{k}") for k in c], F.lit(False).alias("gone"))
    nothing = [F.lit(None).cast("long").alias(f"{x}{k}") for x in "lr" for k in c]
    other = F.struct(F.col("part").alias("phrase"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("int").alias("words"), *nothing, F.lit(True).alias("gone"))
    goes = (F.col("m") > 1) & (F.lit(100) * F.col("a") >= F.lit(inside) * F.col("f"))
    told = met.select("lang", F.explode(F.when(goes, F.array(own, other)).otherwise(F.array(own))).alias("x")).select("lang", "x.*")
    cols = ["a", "words", *[f"{x}{k}" for x in "lr" for k in c], "gone"]
    one = told.groupBy("lang", "phrase").agg(*[F.max(x).alias(x) for x in cols]).where("not gone and a is not null")

    def score(k: int):
        wide = lambda x: f"cast({x} as decimal(18,0))"
        return F.expr(f"case when words > {k} then struct(cast({wide('a')} * {wide('a')} * cast(1000000 as decimal(7,0)) as decimal(38,0)) div cast({wide(f'l{k}')} * {wide(f'r{k}')} as decimal(38,0)) as score, {k} as k, l{k} as l, r{k} as r) end")

    best = one.withColumn("b", F.array_min(F.filter(F.array(*[score(k) for k in c]), lambda x: x.isNotNull()))).select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), F.col("b.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = best.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    total = small_side(known.where("words = 0").select("lang", "n"))
    return first.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(read(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS x FROM documents)),
g AS (SELECT lang, k, array_to_string(list_slice(w, i + 1, i + k), ' ') AS phrase FROM p, (SELECT unnest([1, 2, 3]) AS k), LATERAL (SELECT unnest(range(greatest(0, len(w) - k + 1))) AS i)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 10),
t AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang),
q AS MATERIALIZED (SELECT lang, phrase, k, a, j, array_to_string(w[:j], ' ') AS p1, array_to_string(w[j + 1:], ' ') AS p2 FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (SELECT q.lang, q.phrase, a, j, x.n AS l, y.n AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(x.n AS HUGEINT) * y.n) AS BIGINT) AS score FROM q JOIN f AS x ON x.lang = q.lang AND x.phrase = p1 JOIN f AS y ON y.lang = q.lang AND y.phrase = p2),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
e AS MATERIALIZED (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE k = 3),
o AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN e ON e.lang = c.lang AND e.phrase = c.phrase WHERE 100 * e.a >= 50 * c.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(t.n AS BIGINT) AS n, score
FROM b JOIN t USING (lang) ANTI JOIN o USING (lang, phrase) QUALIFY rank <= 2000
"""
