"""Language identification by a byte convolutional network.

A window is LENGTH bytes of UTF-8; bytes fall in 64 classes (letters without case, white space, digits, marks, and the bytes of
other scripts by their value). Filters of WIDTHS classes slide over the window, each keeps its largest response, and a
softmax layer reads those. The network is trained in numpy by Adam on windows of a bounded sample of labelled rows (SAMPLE),
some cut short so that short texts are known too. A filter's response is a sum of table rows, one per class it spans; for scoring the
tables of neighbouring places are added up beforehand, so a response takes half as many look-ups.

A text is scored whole, in batches of fixed-length windows; a document's answer is the softmax of its windows' mean log-probabilities weighted
by their lengths.

Cases: a null text and one without a letter (Unicode category L) are `und` with score 0; with no labelled rows every text is `und`; with one
language every other text is that one; rows without an id are scored and not learned from; rows that share an id are each
scored, and of those drawn for training each counts; a very long text is scored whole, PART windows at a time; of languages
with equal probability the first in order is given; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

LENGTH, WIDTHS, FILTERS = 512, (2, 3, 4), 8
#: Labelled documents of each language in the training sample, and windows of each document.
SAMPLE, PER_DOCUMENT = 1200, 2
#: Windows that are scored side by side, and windows of documents that are held at a time.
TOGETHER, PART = 64, 2048

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def byte_class(b: int) -> int:
    """0 is padding; 1 to 26 letters, 27 white space, 28 digits, 29 apostrophe, 30 other marks, 31 to 63 the rest by value."""
    c = chr(b).lower()
    if "a" <= c <= "z":
        return ord(c) - 96
    if b < 128:
        return 27 if c.isspace() else 28 if c.isdigit() else 29 if c == "'" else 30
    return 31 + b % 33


CLASS = np.array([byte_class(b) for b in range(256)], np.uint8)


@dataclass
class Network:
    langs: list[str]
    tables: dict[tuple[int, int], np.ndarray]  # (width, place) -> [64, FILTERS]
    bias: np.ndarray  # [len(WIDTHS) * FILTERS]
    out: np.ndarray  # [len(WIDTHS) * FILTERS + 1, langs]; the last row is the bias

    def combined(self) -> dict[int, list[np.ndarray]]:
        """For each width the tables of its pairs of places, [64 * 64, FILTERS], and of a last single place."""
        t = self.tables
        return {w: [(t[w, j][:, None] + t[w, j + 1][None]).reshape(4096, FILTERS).astype(np.float32) if j + 1 < w else t[w, j].astype(np.float32) for j in range(0, w, 2)] for w in WIDTHS}

    def log_probs(self, windows: np.ndarray, lengths: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        """windows: uint8 classes [n, LENGTH], 0 after lengths."""
        x = windows.astype(np.uint16)
        pairs = x[:, :-1] * np.uint16(64) + x[:, 1:]
        pooled = []
        real = lengths.max() if len(lengths) else 0
        for w in WIDTHS:
            n = max(1, min(LENGTH, int(real)) - w + 1)
            r = np.zeros((len(x), n, FILTERS), np.float32)
            for j, t in zip(range(0, w, 2), tables[w], strict=True):
                r += t[(pairs if j + 1 < w else x)[:, j : j + n]]
            short = lengths < n + w - 1
            if short.any():
                r[short] = np.where((np.arange(n) < np.maximum(1, lengths[short, None] - w + 1))[:, :, None], r[short], -np.inf)
            pooled.append(r.max(1))
        h = np.maximum(np.concatenate(pooled, 1) + self.bias, 0)
        z = h @ self.out[:-1] + self.out[-1]
        z = z - z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def train(samples: list[tuple[bytes, str]], epochs: int = 8, seed: int = 3, rate: float = 0.01) -> Network:
    langs = sorted({s[1] for s in samples})
    rng = np.random.default_rng(seed)
    tables = {(w, j): rng.normal(0, 0.3, (64, FILTERS)) for w in WIDTHS for j in range(w)}
    net = Network(langs, tables, np.zeros(len(WIDTHS) * FILTERS), rng.normal(0, 0.3, (len(WIDTHS) * FILTERS + 1, len(langs))))
    if len(langs) < 2:
        return net
    x = np.zeros((len(samples), LENGTH), np.uint8)
    n = np.array([min(LENGTH, len(s[0])) for s in samples])
    for i, (b, _) in enumerate(samples):
        x[i, : n[i]] = CLASS[np.frombuffer(b[:LENGTH], np.uint8)]
    y = np.array([langs.index(s[1]) for s in samples])
    params = [*tables.values(), net.bias, net.out]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 32):
            i = order[at : at + 32]
            most = np.where(rng.random(len(i)) < 0.4, rng.integers(12, LENGTH, len(i)), LENGTH)
            xs, ns = x[i].astype(np.int64), np.minimum(n[i], most)
            xs[np.arange(LENGTH) >= ns[:, None]] = 0
            pooled, where = [], []
            for w in WIDTHS:
                p = LENGTH - w + 1
                r = sum(tables[w, j][xs[:, j : j + p]] for j in range(w))
                r[np.arange(p) >= np.maximum(1, ns[:, None] - w + 1)] = -np.inf
                a = r.argmax(1)
                where.append(a)
                pooled.append(np.take_along_axis(r, a[:, None], 1)[:, 0])
            h = np.concatenate(pooled, 1) + net.bias
            act = np.maximum(h, 0)
            z = act @ net.out[:-1] + net.out[-1]
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[np.arange(len(i)), y[i]] -= 1
            z /= len(i)
            gh = (z @ net.out[:-1].T) * (h > 0)
            grads = []
            for k, w in enumerate(WIDTHS):
                g = gh[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    t = np.zeros((64, FILTERS))
                    np.add.at(t, (xs[np.arange(len(i))[:, None], where[k] + j], np.arange(FILTERS)), g)
                    grads.append(t)
            grads += [gh.sum(0), np.concatenate([act.T @ z, z.sum(0)[None]])]
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Learns from rows with an id, a text and a language that aren't held out; windows at places drawn by hash."""
    text = F.col("text").cast("string")
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out("doc_id") & text.rlike(r"\p{L}"))
    n = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not n:
        return None
    share = F.create_map(*[F.lit(x) for lang, c in n.items() for x in (lang, int(1e6 * min(1, sample / c)))])
    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.element_at(share, F.col("lang")))
    at = lambda i: F.pmod(F.xxhash64("doc_id", F.lit(i)), F.greatest(F.lit(1), F.length(text) - LENGTH // 2)).cast("int") + 1
    windows = some.select("doc_id", "lang", F.explode(F.array(*[F.substr(text, at(i), F.lit(LENGTH)) for i in range(PER_DOCUMENT)])).alias("w"))
    got = sorted((r["doc_id"], r["w"], r["lang"]) for r in windows.collect())
    return train([(w.encode("utf-8", "surrogatepass"), lang) for _, w, lang in got])


def has_letter(text: str) -> bool:
    """Whether a character is of Unicode category L; digits, numbers like a half or a circled one, marks and symbols are none."""
    return any(map(str.isalpha, text))


class Scorer:
    def __init__(self, net: Network | None):
        self.net = net
        self.tables = net.combined() if net else {}

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        net = self.net
        found: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        some = [i for i, t in enumerate(texts) if t and has_letter(t)] if net else []
        part: list[int] = []
        raw: list[bytes] = []
        size = 0
        for i in some:
            part.append(i)
            raw.append(texts[i].encode("utf-8", "surrogatepass"))
            size += len(raw[-1])
            if size >= PART * LENGTH:
                self.score(part, raw, found)
                part, raw, size = [], [], 0
        if part:
            self.score(part, raw, found)
        return found

    def score(self, part: list[int], raw: list[bytes], found: list[tuple[str, float]]) -> None:
        """Fills found for the texts part, whose bytes are raw: windows of PART at a time, their weighted sums by text."""
        net = self.net
        n = np.array([len(r) for r in raw])
        count = -(-n // LENGTH)
        starts = np.cumsum(count) - count
        total = np.zeros((len(raw), len(net.langs)))
        classes = np.zeros(int(count.sum()) * LENGTH, np.uint8)
        for k, r in zip(starts, raw, strict=True):
            classes[k * LENGTH : k * LENGTH + len(r)] = CLASS[np.frombuffer(r, np.uint8)]
        flat = classes.reshape(-1, LENGTH)
        text = np.repeat(np.arange(len(raw)), count)
        own = np.minimum(LENGTH, n[text] - (np.arange(len(flat)) - starts[text]) * LENGTH)
        order = np.argsort(own, kind="stable")
        for k in range(0, len(order), TOGETHER):
            i = order[k : k + TOGETHER]
            np.add.at(total, text[i], net.log_probs(flat[i], own[i], self.tables) * own[i, None])
        mean = total / n[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for i, row in zip(part, p, strict=True):
            found[i] = (net.langs[int(row.argmax())], float(row.max()))


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """One row per document row: SCHEMA; a narrow scan."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            got = scorer(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
