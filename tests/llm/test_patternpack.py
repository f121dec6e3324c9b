"""Pattern packing: ids against tokenizers, plans against their histograms, placement against a brute-force count."""

import random
import zlib

import numpy as np
import pytest
from lumenreel.llm import patternpack as pp
from lumenreel.llm.common import earlier

from . import fixtures as fx


@pytest.fixture(scope="module")
def bpe():
    return pp.WordBpe()


def whole(bpe, text):
    return np.array(bpe.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_ids_are_the_tokenizers(bpe):
    rng = random.Random(3)
    alphabets = ["abcXYZ'stremvld ", "".join(map(chr, range(0x20, 0x180))), "aé́İß ΣΑς  　中文 \n\t\x0b\x0c\x1c\x85", "0123456789²½. ,!'’%#é ", "<|endoftext|> start"]
    for i in range(3000):
        text = "".join(rng.choice(alphabets[i % len(alphabets)]) for _ in range(rng.randint(0, 60)))
        assert bpe.ids(text) == whole(bpe, text), repr(text)
    for text in ["it's I'LL we'Re 'S 's's", "<|endoftext|>", "\U0001f600é!", " " * 3_000_000, "x" * 300_000, "\n\t " * 500_000 + "end", ("word, " * 300_000)]:
        assert bpe.ids(text) == whole(bpe, text)


def held(groups, limit):
    h = np.zeros(limit, int)
    for pattern, n in groups:
        assert sum(a * b for a, b in pattern) <= limit and n > 0
        for a, b in pattern:
            h[a] += b * n
    return h


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_each_piece_once_in_few_sequences(seed):
    rng = np.random.default_rng(seed)
    limit = 64 if seed % 2 else 256
    draws = np.clip(rng.lognormal(3, 1, 5 if seed == 0 else 2000 * 10 ** (seed % 3)), 1, limit - 1).astype(int) if seed != 3 else np.full(3000, limit // 3)
    hist = np.bincount(draws, minlength=limit)[:limit]
    groups = pp.plan(hist, limit)
    assert (held(groups, limit) == hist).all()
    used = sum(n for _, n in groups)
    plain = sum(n for _, n in pp.best_fit(hist, limit))
    assert used <= plain * 1.005 + 1
    if seed != 3:
        assert used <= -(-int((hist * np.arange(limit)).sum()) // limit) * 1.01 + 1


def test_fit_finds_exact_counts():
    rows = pp.patterns(np.array([10, 20, 30, 34]), 64)
    assert {tuple(r) for r in rows.tolist()} == {(34, 30, 0), (34, 20, 10)}
    hist = np.zeros(65)
    hist[[34, 30, 20, 10]] = 7, 4, 3, 3
    assert np.allclose(pp.fit(rows, hist, 500)[[tuple(r) == (34, 30, 0) for r in rows.tolist()]], 4, atol=1e-3)


@pytest.mark.parametrize("limit", [32, 2048])
def test_pieces(spark, bpe, limit):
    data = fx.rows() + [(900, "one two three", "en", None, 1, 1, 1)] * 40 + [(901, "y " * 9000, None, None, None, None, None)]
    got = pp.pack_documents(fx.docs(spark, data), limit).collect()
    want = []
    for r in data:
        ids = (whole(bpe, r[1]) if r[1] else b"") + b"\0\0\0\0"
        want += [(r[0], p, s, len(ids[4 * s : 4 * (s + limit)]) // 4, zlib.crc32(ids[4 * s : 4 * (s + limit)])) for p, s in enumerate(range(0, len(ids) // 4, limit))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= limit
    total = sum(r.length for r in got)
    assert len(by) <= -(-total // limit) * 1.02 + 2


def test_empty(spark):
    assert pp.pack_documents(fx.empty(spark)).count() == 0


@pytest.mark.parametrize("how", ["sum", "last"])
@pytest.mark.parametrize("fan", [3, 1000])
def test_earlier(spark, how, fan):
    rng = random.Random(5)
    rows = [(k, at, rng.choice([None, rng.randint(0, 99)])) for k in ("a", None, "b") for at in rng.sample(range(60), 25)]
    got = earlier(spark.createDataFrame(rows, "k string, at long, v long"), ["k"], "at", "v", how, 60, fan).collect()
    assert len(got) == len(rows)
    for r in got:
        was = [v for k, at, v in sorted(rows, key=lambda x: x[1]) if k == r.k and at < r["at"] and v is not None]
        assert r["_before"] == ((sum(was) if how == "sum" else was[-1]) if was else None)
