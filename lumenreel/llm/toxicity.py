"""Toxicity: a linear-chain conditional random field tags toxic tokens; marginals aggregate to a document score.

Training takes a bounded sample of labelled rows (SAMPLE) and works on the driver. Tokens of toxic documents are
labelled toxic if the token or one of its prefixes is tied to toxic documents by a likelihood-ratio test that
allows for the number of features tried; where a feature also turns up by chance in clean documents, its least number of
times in a document that ties it is taken (TIMES). Near-copies in the sample count once there. The CRF has two states, weights
for a token's word, prefixes and suffix, and transition weights; it is trained on windows of tokens by the exact gradient
(forward-backward). A document's score is a logistic function, fitted on the sample, of the expected number of toxic tokens and the
number of all tokens, both as logarithms, so that a chance token in a long text doesn't count like two in a short one.

Scoring is a narrow scan of whole texts; the chain runs over a text from its first token to its last. The ratio of the two
states' forward values obeys a one-line recursion whose step is a Moebius map, so the steps of a run of SPAN tokens are one 2 x 2
matrix: all runs of a batch are multiplied up side by side, the runs of a text are chained, and within runs the recursion goes
on from what the run before left (backward likewise). Texts are taken PART tokens at a time, so memory doesn't depend on
how long they are beside the longest one.

Cases: null, empty and wordless texts score as documents with no toxic token; several labels of one document: the
largest counts, null labels don't; with no labelled rows every score is 0, with one class only its prior; rows that share an id
are each scored, and each drawn for training counts; a score of exactly REJECT is toxic; empty tables give no rows; extra
columns are not read by a score and are kept by reject().
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Labelled documents of each class (0, 1) in the training sample, and the longest text in it, in code points.
SAMPLE, SAMPLE_CHARS = (3000, 1500), 20_000
TRAIN_WINDOW, TRAIN_WINDOWS = 64, 4000
#: Tokens of a run whose steps are multiplied up, and tokens of documents that are scored at a time.
SPAN, PART = 64, 400_000
REJECT = 0.3
#: Share of toxic documents among those with a feature, from which the feature can mark a token for training.
PURE = 0.9
#: Times up to which a feature's number in a document is told apart when it is tied to toxic ones.
TIMES = 4
#: Marginals below it don't count in a document's score.
LEAST = 0.1
#: Weight of the logistic fit's pull to (1, 0, 0); its inputs span about a unit.
PULL = 0.02
#: Token types a worker remembers the weight of.
KNOWN = 300_000

_WORD = re.compile(r"\w+")
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int,p:double>>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))])


def features(word: str) -> list[str]:
    """The word, its prefixes of 3 to 6 letters and its suffix of 3."""
    return [word, *(f"{word[:k]}*" for k in (3, 4, 5, 6) if len(word) > k), *([f"*{word[-3:]}"] if len(word) > 3 else [])]


@dataclass
class Model:
    weights: dict[str, float]  # by feature: toxic over clean
    bias: float
    chain: np.ndarray  # 2 x 2 weights of a step from state to state
    scale: tuple[float, float, float]  # of the score: slopes of the columns of _inputs()
    constant: float | None = None  # the score where nothing could be learned

    def emission(self, word: str) -> float:
        w = self.weights
        return self.bias + sum(w.get(f, 0.0) for f in features(word))


class _Known(dict):
    def __init__(self, of, limit: int):
        self.of, self.limit = of, limit

    def __missing__(self, word: str) -> float:
        if len(self) >= self.limit:
            self.clear()
        self[word] = x = self.of(word)
        return x


def chain_odds(e: np.ndarray, real: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward odds of state 1 for windows e[B, T] of emission weights; real marks tokens, not padding."""
    a = np.exp(chain)
    x = np.exp(np.clip(e, -40, 40)) * 1.0
    fwd, bwd = np.ones_like(x), np.ones_like(x)
    r = np.ones(len(x))
    for t in range(x.shape[1]):
        r = x[:, t] * ((a[0, 1] + r * a[1, 1]) / (a[0, 0] + r * a[1, 0]) if t else r)
        np.clip(r, 1e-30, 1e30, out=r)
        fwd[:, t] = r
    b = np.ones(len(x))
    for t in range(x.shape[1] - 2, -1, -1):
        r = np.where(real[:, t + 1], x[:, t + 1] * b, 1.0)
        b = np.where(real[:, t + 1], (a[1, 0] + a[1, 1] * r) / (a[0, 0] + a[0, 1] * r), 1.0)
        np.clip(b, 1e-30, 1e30, out=b)
        bwd[:, t] = b
    return fwd, bwd


def _runs(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, text) of the runs of texts that stand one after another."""
    n = -(-lengths // size)
    text = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(text)) - (np.cumsum(n) - n)[text]
    return (np.cumsum(lengths) - lengths)[text] + k * size, np.minimum(size, lengths[text] - k * size), text


def _chained(maps: np.ndarray, text: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The vector (2) that enters each run: begin for a text's first, else what the maps (2 x 2) of the text's runs before it make of
    begin. Maps of all texts are multiplied up by doubling distances, scaled so that nothing overflows."""
    n = len(text)
    upto = maps.copy()  # the product over the runs of the same text in reach, the latest on the left
    step = 1
    while step < n:
        i = np.flatnonzero(text[step:] == text[:-step]) + step
        if not len(i):
            break
        upto[i] = upto[i] @ upto[i - step]
        upto[i] /= upto[i].max((1, 2), keepdims=True)
        step *= 2
    out = np.tile(begin, (n, 1))
    after = np.flatnonzero(text[1:] == text[:-1]) + 1
    out[after] = upto[after - 1] @ begin
    return out / out.max(1, keepdims=True)


def marginals(e: np.ndarray, lengths: np.ndarray, chain: np.ndarray, size: int = SPAN) -> np.ndarray:
    """P(toxic) of each token, given all tokens of its text; e: emission weights of texts one after another."""
    out = np.zeros(len(e))
    if not len(e):
        return out
    start, n, text = _runs(lengths, size)
    a, x = np.exp(chain - chain.max()), np.exp(np.clip(e, -40, 40))
    t = np.arange(int(n.max()))
    real = t < n[:, None]
    x = np.where(real, x[np.where(real, start[:, None] + t, 0)], 1.0)
    first = np.concatenate([[True], text[1:] != text[:-1]])
    # forward (f0, f1): a text begins with (1, x); a step is f -> D(x) A' f. A run's map takes in the step to its first token, but for a
    # text's first run, which begins with D(x) alone
    eye = np.eye(2)
    ahead = np.tile(eye, (len(n), 1, 1))
    for k in t:
        m = np.einsum("ij,rjk->rik", a.T, ahead)
        if k == 0:
            m = np.where(first[:, None, None], ahead, m)
        m = m * np.stack([np.ones(len(n)), x[:, k]], 1)[:, :, None]
        m /= m.max((1, 2), keepdims=True)
        ahead = np.where(real[:, k, None, None], m, ahead)
    f = _chained(ahead, text, np.ones(2))
    # backward (b0, b1): ends with (1, 1); a step back over token x is b -> A D(x) b. A run's map steps over all its tokens
    back = np.tile(eye, (len(n), 1, 1))
    for k in t:
        m = np.einsum("rij,jk->rik", back, a) * np.stack([np.ones(len(n)), x[:, k]], 1)[:, None, :]
        m /= m.max((1, 2), keepdims=True)
        back = np.where(real[:, k, None, None], m, back)
    b = _chained(back[::-1], text[::-1], np.ones(2))[::-1]
    # within runs, as odds of state 1
    odds = np.ones_like(x)
    r = f[:, 1] / np.maximum(f[:, 0], 1e-300)
    for k in t:
        r = x[:, k] * np.where(first if k == 0 else False, r, (a[0, 1] + r * a[1, 1]) / (a[0, 0] + r * a[1, 0]))
        r = np.clip(r, 1e-30, 1e30)
        odds[:, k] = r
    r = b[:, 1] / np.maximum(b[:, 0], 1e-300)
    for k in t[::-1]:
        odds[:, k] *= np.where(real[:, k], np.clip(r, 1e-30, 1e30), 1.0)
        y = x[:, k] * np.clip(r, 1e-30, 1e30)
        r = np.where(real[:, k], (a[1, 0] + a[1, 1] * y) / (a[0, 0] + a[0, 1] * y), r)
    out[(start[:, None] + t)[real]] = (odds / (1 + odds))[real]
    return out


def tokens_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _one_of_each(docs: list[list[str]]) -> list[int]:
    """Indices without near-copies: 4 of 8 equal minima of hashed word triples make a copy."""
    seen: dict[tuple[int, int], set[int]] = {}
    kept = []
    odd = np.array([2 * xxhash.xxh64_intdigest(bytes([k])) + 1 & (2**64 - 1) for k in range(8)], np.uint64)
    for i, w in enumerate(docs):
        if not w:
            continue
        h = np.array([xxhash.xxh64_intdigest(" ".join(w[j : j + 3])) for j in range(max(1, len(w) - 2))], np.uint64)
        key = [(k, int((h * o >> np.uint64(1)).min())) for k, o in enumerate(odd)]
        same = Counter(j for x in key for j in seen.get(x, ()))
        if not same or max(same.values()) < 4:
            kept.append(i)
            for x in key:
                seen.setdefault(x, set()).add(i)
    return kept


def associated(docs: list[list[str]], toxic: list[int], stands_for: tuple[float, float] = (1.0, 1.0)) -> dict[str, int]:
    """Features tied to toxic documents beyond what chance gives among so many, each with the least times (1 to TIMES) that
    a document must hold it; stands_for: the labelled rows that a clean and a toxic document of the sample stand for."""
    n1 = sum(toxic)
    n0 = len(toxic) - n1
    if not n1 or not n0:
        return {}
    base = n1 / (n0 + n1)
    held = Counter(x for w, y in zip(docs, toxic, strict=True) if y for x in _pairs(w, features))
    tried = {f for x in {x for w in docs for x in w} for f in features(x)}
    need = np.log(len(tried) + sum(k > 1 for _, k in held) + 1) + 2
    held = {x: a for x, a in held.items() if a * np.log(1 / base) >= need}  # others fail even if no clean document holds them
    names = {f for f, _ in held}
    of = _Known(lambda word: [f for f in features(word) if f in names], KNOWN)
    clean = Counter(x for w, y in zip(docs, toxic, strict=True) if not y for x in _pairs(w, of.__getitem__) if x in held)
    found: dict[str, int] = {}
    for (f, k), a in held.items():
        b = clean[f, k]
        p, share = a / (a + b), a * stands_for[1] / (a * stands_for[1] + b * stands_for[0])
        if p >= base and share >= PURE and a * np.log(p / base) + (b * np.log((1 - p) / (1 - base)) if b else 0) >= need:
            found[f] = min(k, found.get(f, k))
    return found


def _times(words: list[str], of) -> Counter:
    """How often each feature occurs; of: the features of a word."""
    out: Counter = Counter()
    for x, n in Counter(words).items():
        for f in of(x):
            out[f] += n
    return out


def _pairs(words: list[str], of) -> Iterator[tuple[str, int]]:
    """(feature, k) for each k up to TIMES such that the feature occurs k times or more."""
    return ((f, k) for f, n in _times(words, of).items() for k in range(1, min(n, TIMES) + 1))


def train(texts: list[str], toxic: list[int], stands_for: tuple[float, float] = (1.0, 1.0), rounds: int = 40, seed: int = 7) -> Model:
    """stands_for: as in associated(); where classes were drawn at different rates, scores are still those of the labelled rows."""
    zero = np.zeros((2, 2))
    if len(set(toxic)) < 2:
        return Model({}, 0.0, zero, (0.0, 0.0, 0.0), float(np.mean(toxic)) if toxic else 0.0)
    docs = [tokens_of(t) for t in texts]
    some = _one_of_each(docs)
    ties = associated([docs[i] for i in some], [toxic[i] for i in some], stands_for)
    rng = np.random.default_rng(seed)
    seqs: list[tuple[list[str], np.ndarray]] = []
    for i in some:
        marks = {f for f, n in _times(docs[i], features).items() if n >= ties.get(f, n + 1)} if toxic[i] else set()
        y = np.array([any(f in marks for f in features(w)) for w in docs[i]], np.int8)
        seqs += [(docs[i][k : k + TRAIN_WINDOW], y[k : k + TRAIN_WINDOW]) for k in range(0, len(y), TRAIN_WINDOW)]
    hit = [k for k, (_, y) in enumerate(seqs) if y.any()]
    rest = [k for k, (_, y) in enumerate(seqs) if not y.any()]
    pick = [*rng.permutation(hit)[: TRAIN_WINDOWS // 2], *rng.permutation(rest)[: TRAIN_WINDOWS // 2]]
    seqs = [seqs[k] for k in pick]
    df = Counter(f for w, _ in seqs for f in {f for x in set(w) for f in features(x)})
    names = {f: k for k, f in enumerate(f for f, c in sorted(df.items()) if c >= 3)}
    types: dict[str, int] = {}
    tokens = [[types.setdefault(x, len(types)) for x in w] for w, _ in seqs]
    of_type = np.full((len(types), 6), len(names))
    for x, k in types.items():
        got = [names[f] for f in features(x) if f in names]
        of_type[k, : len(got)] = got
    real = np.arange(TRAIN_WINDOW) < np.array([len(w) for w in tokens])[:, None]
    ids, gold = np.zeros(real.shape, np.int64), np.zeros(real.shape)
    ids[real] = np.concatenate(tokens)
    gold[real] = np.concatenate([y for _, y in seqs])
    weight, bias, chain = np.zeros(len(names) + 1), -3.0, zero.copy()
    ada_w, ada_b, ada_c = np.full(len(weight), 1e-3), 1e-3, np.full((2, 2), 1e-3)
    both = real[:, 1:]
    seen = np.array([[((gold[:, :-1] == i) & (gold[:, 1:] == j) & both).sum() for j in (0, 1)] for i in (0, 1)], float)
    for _ in range(rounds):
        weight[-1] = 0
        e = np.where(real, weight[of_type].sum(1)[ids] + bias, 0.0)
        fwd, bwd = chain_odds(e, real, chain)
        p = fwd * bwd / (1 + fwd * bwd)
        miss = np.where(real, gold - p, 0.0)
        by_type = np.bincount(ids[real], miss[real], len(types))
        g = np.zeros(len(weight))
        np.add.at(g, of_type, np.repeat(by_type[:, None], 6, 1))
        g -= 0.5 * weight
        a, f0 = np.exp(chain), 1 / (1 + fwd[:, :-1])
        after = np.exp(np.clip(e[:, 1:], -40, 40)) * bwd[:, 1:]
        joint = np.stack([f0 * a[0, 0], f0 * a[0, 1] * after, (1 - f0) * a[1, 0], (1 - f0) * a[1, 1] * after])
        joint = np.where(both, joint / joint.sum(0), 0).sum((1, 2)).reshape(2, 2)
        gc, gb = seen - joint - 0.5 * chain, miss.sum() - 0.5 * bias
        ada_w, ada_c, ada_b = ada_w + g**2, ada_c + gc**2, ada_b + gb**2
        weight, chain, bias = weight + 0.5 * g / np.sqrt(ada_w), chain + 0.2 * gc / np.sqrt(ada_c), bias + 0.2 * gb / np.sqrt(ada_b)
    model = Model({f: float(weight[k]) for f, k in names.items() if abs(weight[k]) > 1e-4}, float(bias), chain, (1.0, 0.0, 0.0))
    x, y = _inputs(expected(model, docs), docs), np.array(toxic, float)
    v = np.where(y > 0, stands_for[1], stands_for[0])
    rest = np.array(model.scale)
    scale = rest.copy()
    for _ in range(30):  # Newton's steps for the logistic fit, with a weak pull to rest
        q = 1 / (1 + np.exp(-np.clip(x @ scale, -30, 30)))
        h = (x * (v * q * (1 - q))[:, None]).T @ x + PULL * np.eye(3)
        scale = scale + np.linalg.solve(h, x.T @ (v * (y - q)) - PULL * (scale - rest))
    model.scale = tuple(float(k) for k in scale)
    return model


def _inputs(x: np.ndarray, docs: list[list[str]]) -> np.ndarray:
    """What a score is a logistic function of, a row a document; the length counts as far as there are toxic tokens."""
    return np.stack([np.log1p(x), np.log1p([len(w) for w in docs]) * x / (1 + x), np.ones(len(docs))], 1)


def expected(model: Model, docs: list[list[str]], known: dict[str, float] | None = None, tokens: bool = False):
    """Expected number of toxic tokens of each document, over tokens of LEAST at least, so that length alone adds nothing; with
    tokens, also each document's marginals."""
    known = _Known(model.emission, KNOWN) if known is None else known
    n = np.array([len(w) for w in docs], np.int64)
    e = np.fromiter((x for w in docs for x in map(known.__getitem__, w)), float, int(n.sum()))
    p = marginals(e, n, model.chain)
    ends = np.cumsum(n)
    total = np.concatenate([[0.0], np.cumsum(np.where(p >= LEAST, p, 0.0))])
    x = np.maximum(total[ends] - total[ends - n], 0)
    return (x, np.split(p, ends[:-1])) if tokens else x


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """Learns from rows that aren't held out; the sample is drawn by a hash of the id, so it is the same each time."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out("doc_id")).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    n = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    some = known.where(F.when(F.col("y") == 1, pick < int(1e6 * min(1, sample[1] / max(1, n.get(1, 0))))).otherwise(pick < int(1e6 * min(1, sample[0] / max(1, n.get(0, 0))))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") <= chars).join(F.broadcast(some), "doc_id").collect()
    rows = sorted(((r["doc_id"], r["text"], r["y"]) for r in rows))
    drawn = Counter(r[2] for r in rows)
    return train([r[1] for r in rows], [r[2] for r in rows], tuple(max(1.0, n.get(y, 0) / max(1, drawn[y])) for y in (0, 1)))


class Scorer:
    """Holds the model and the words' weights in a worker."""

    def __init__(self, model: Model, part: int = PART):
        self.model, self.known, self.part = model, _Known(model.emission, KNOWN), part

    def __call__(self, texts: list[str | None], want_spans: bool) -> tuple[np.ndarray, list[list[dict]]]:
        m = self.model
        if m.constant is not None:
            return np.full(len(texts), m.constant), [[] for _ in texts]
        scores, spans = np.zeros(len(texts)), [[] for _ in texts]
        part: list[int] = []
        docs: list[list[str]] = []

        def send() -> None:
            x, p = expected(m, docs, self.known, True)
            scores[part] = 1 / (1 + np.exp(-np.clip(_inputs(x, docs) @ np.array(m.scale), -30, 30)))
            if want_spans:
                for i, q in zip(part, p, strict=True):
                    spans[i] = self.spans(texts[i], q)
            part.clear()
            docs.clear()

        size = 0
        for i, t in enumerate(texts):
            part.append(i)
            docs.append(tokens_of(t))
            size += len(docs[-1])
            if size >= self.part:
                send()
                size = 0
        if part:
            send()
        return scores, spans

    @staticmethod
    def spans(text: str | None, p: np.ndarray) -> list[dict]:
        if not len(p) or p.max() < 0.5:
            return []
        low = text.lower()
        if len(low) == len(text):
            return [{"start": w.start(), "end": w.end(), "p": float(q)} for w, q in zip(_WORD.finditer(low), p, strict=True) if q >= 0.5]
        at = np.cumsum([0, *(len(c.lower()) for c in text)])  # a few letters are longer in lower case
        return [{"start": int(np.searchsorted(at, w.start(), "right")) - 1, "end": int(np.searchsorted(at, w.end(), "left")), "p": float(q)} for w, q in zip(_WORD.finditer(low), p, strict=True) if q >= 0.5]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document row: SCHEMA."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            s, spans = scorer(b.column(2).to_pylist(), True)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= REJECT).astype(np.int32)), pa.array(spans, _ARROW.field(4).type)], schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """docs, all columns, without the rows predicted toxic."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            s, _ = scorer(b.column(at).to_pylist(), False)
            yield b.filter(pa.array(s < REJECT))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))
