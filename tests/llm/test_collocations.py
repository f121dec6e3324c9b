"""Phrase collocation mining against a count of all phrases in one process."""

import random
from collections import Counter

import duckdb
import pytest
import regex
from lumenreel.llm import collocations as cl

from . import fixtures as fx


def brute(docs, longest=3, least=10, top=2000, inside=50):
    f, total = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in regex.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = regex.findall("[^ \t]+", piece)
            total[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    cand = {p: n for p, n in f.items() if len(p[1]) > 1 and n >= least}
    out = {}
    for (lang, w), a in cand.items():
        longer = [n for (lg, v), n in cand.items() if lg == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if any(100 * n >= inside * a for n in longer):
            continue
        score, k = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i, p.decode(), -a, left, r, total[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, r) in enumerate(sorted(rows)[:top], 1))


def texts(seed, n=120, words=25):
    rng = random.Random(seed)
    vocab = ["a", "B", "b", "é", "ÉA", "x'y", "ß", "1", "\x00", "中", "new", "York", "city", "of"] + [f"w{i}" for i in range(words)]
    gap = lambda: rng.choice([" "] * 8 + ["  ", "\t", ". ", ", ", "\n", ";", "!x ", "\r\n"])
    out = [("".join(rng.choice(vocab[: rng.choice([6, len(vocab)])]) + gap() for _ in range(rng.randint(0, 90))), rng.choice(["en", "en", "fr", None, ""])) for _ in range(n)]
    return [*out, (None, "en"), ("", None), (" \t.,", "fr"), ("new York city " * 40, "en"), ("x x x x x x x x x x x x x x", "xx")]


def mined(spark, docs, **kw):
    d = spark.createDataFrame([(i, t, lang, None, 0, 1, 2) for i, (t, lang) in enumerate(docs)], fx.SCHEMA).repartition(3)
    return sorted(map(tuple, cl.mine(d, **kw).collect()))


@pytest.mark.parametrize("kw", [{"cells": 20}, {"cells": 6}, {"cells": 20, "least": 3, "top": 7, "inside": 80}, {"cells": 18, "longest": 2, "least": 1}])
def test_against_brute_force(spark, kw):
    docs = texts(1)
    assert mined(spark, docs, **kw) == brute(docs, **{k: v for k, v in kw.items() if k != "cells"})


def test_shards_and_slices(spark, monkeypatch):
    """Texts cut into slices and shards in their midst count like whole ones."""
    import pyarrow as pa

    docs = [(t, lang) for t, lang in texts(2) if t is not None] + [(" ".join("abcdef"[i * i % 6] for i in range(900)), "en")]
    batch = pa.RecordBatch.from_arrays([pa.array([x[1] or "und" for x in docs]), pa.array([x[0].encode() for x in docs])], names=["lang", "text"])

    def counted():
        got = Counter()
        for s in cl.shards(iter([batch.slice(0, 50), batch.slice(50)]), 3):
            names = list(s.numbers)
            for lang, codes, skip in s.languages():
                for k in (1, 2, 3):
                    first = cl._grams(codes, k, skip)
                    got.update((lang, *[names[codes[i + j]] for j in range(k)]) for i in first.tolist())
                    if k == 2 and len(first):
                        import numpy as np

                        keys = np.unique((codes[first].astype(np.int64) << cl._BITS) | codes[first + 1])
                        counts = cl._matches(codes, keys, np.full(len(keys), 2), skip, 3)
                        assert counts.sum() == len(first)
        return got

    whole = counted()
    for slice_, shard, step in ((40, 10**9, 7), (64, 30, 5), (1, 1, 1)):
        monkeypatch.setattr(cl, "SLICE", slice_)
        monkeypatch.setattr(cl, "SHARD", shard)
        monkeypatch.setattr(cl, "STEP", step)
        assert counted() == whole


def test_cases(spark):
    assert cl.mine(fx.empty(spark), cells=16).count() == 0
    assert mined(spark, [(None, None), ("", "en")], cells=16) == []
    # the lowest cut, of equal ones the first; a phrase inside a longer one goes, the longer one stays
    docs = [("p q r", "en")] * 10 + [("p q s", "en")] * 11
    got = mined(spark, docs, cells=16)
    assert got == brute(docs) and [r[2] for r in got] == ["p q s", "p q r"]


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits: the scores of large counts, by the operator's own expression."""
    import numpy as np

    assert 3_000_000_019**2 * 1_000_000 > np.iinfo(np.int64).max
    row = spark.sql("select cast(cast(3000000019 as decimal(18,0)) * cast(3000000019 as decimal(18,0)) * cast(1000000 as decimal(7,0)) as decimal(38,0)) div cast(cast(3000000021 as decimal(18,0)) * cast(3000000020 as decimal(18,0)) as decimal(38,0)) as s").first()
    assert row.s == 1_000_000 * 3_000_000_019**2 // (3_000_000_021 * 3_000_000_020)


def test_same_as_sql(spark):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{fx.D}/documents.parquet'")
    want = sorted(c.sql(f"select lang, rank, phrase, a, l, r, n, score from ({cl.OP11_SQL})").fetchall())
    assert sorted(map(tuple, cl.op11_collocations(spark, fx.D).collect())) == want and len(want) > 50
