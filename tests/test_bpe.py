"""Byte-pair encoding against a naive loop of merges and against a public tokenizer of the same vocabulary."""

import gzip
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenreel.functions import bpe
from lumenreel.plans import catalog

D = "/root/testdata/sf0.001"
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def public():
    return bpe.read_merges(P.path("word_bpe_49k.json"))


def naive(parts, rank):
    """Merge every place of the earliest pair from left to right, until no pair has a rank."""
    while True:
        ranked = [rank[x] for x in zip(parts, parts[1:]) if x in rank]
        if not ranked:
            return parts
        out, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and rank.get((parts[i], parts[i + 1])) == min(ranked):
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out


def letters(own, word):
    x = [own.letters[b] for b in word.encode()]
    return [*x[:-1], x[-1] + bpe.WORD_END]


def test_any_order_of_merges():
    """Lists in which a merge stands before those that make its parts, too."""
    rng = random.Random(5)
    for _ in range(400):
        whole = ["a", "b", "a</w>", "b</w>"]
        pairs = {}
        for _ in range(rng.randrange(1, 14)):
            a, b = rng.choice([x for x in whole if not x.endswith("</w>")]), rng.choice(whole)
            pairs[(a, b)] = None
            whole.append(a + b)
        order = list(pairs)
        rng.shuffle(order)
        own = bpe.Encoder(order)
        for _ in range(10):
            word = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 30)))
            assert own.parts(word) == naive(letters(own, word), own.rank), (order, word)


@settings(max_examples=200, deadline=None)
@given(st.text(min_size=1, max_size=40).filter(lambda x: x.encode("utf-8", "ignore").decode() == x))
def test_naive_loop_with_public_merges(public, word):
    own = bpe.encoder(public)
    assert own.parts(word) == naive(letters(own, word), own.rank)


def test_ids_are_the_vocabulary_s(public):
    own = bpe.encoder(public)
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = json.load(f)
    want = vocabulary["model"]["vocab"] | {x["content"]: x["id"] for x in vocabulary["added_tokens"]}
    assert own.id == want


def test_same_as_tokenizer(spark, public):
    """Documents and random strings; the tokenizer is another implementation and reads the same file."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rng = random.Random(7)
    texts = [r[0] or "" for r in spark.read.parquet(f"{D}/documents.parquet").select("text").collect()]
    texts += ["".join(rng.choice("abcdé’'st 12½ß漢🙂\n\t.,!-_") for _ in range(rng.randrange(0, 300))) for _ in range(300)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", bpe.bpe_ids(F.col("t"), public).alias("ids")).collect()
    for r in got:
        ids = t.encode(bpe.clean(texts[r["i"]]), add_special_tokens=False).ids[:75]
        assert r["ids"] == [49406, *ids, 49407] + [0] * (75 - len(ids)), texts[r["i"]][:80]


def test_cases(spark, public):
    s, e = 49406, 49407
    own = bpe.encoder(public)
    dog = own.word_ids("dog")
    rows = [(None,), ("",), (" \n\t ",), ("DOG &amp;amp; dog",), ("<|startoftext|> dog <|ENDOFTEXT|>",), ("dog " * 500,), ("é",), ("dog",), ("dog",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(bpe.bpe_ids(F.col("t"), public, 8)).collect()]
    assert got[0] == got[1] == got[2] == [s, e, 0, 0, 0, 0, 0, 0]
    assert got[3] == [s, *dog, *own.word_ids("&"), *dog, e, 0, 0, 0] and got[4] == [s, s, *dog, e, e, 0, 0, 0]
    assert got[5] == [s, *dog * 6, e] and got[6] == [s, *own.word_ids("é"), e, 0, 0, 0, 0, 0] and got[7] == got[8]
    assert spark.createDataFrame([], "t string").select(bpe.bpe_ids(F.col("t"), public)).count() == 0
    mended = spark.createDataFrame([("d0g",)], "t string").select(bpe.bpe_ids(F.col("t"), public, 3, lambda t: t.replace("0", "o"))).first()[0]
    assert mended == [s, *dog, e]
    with pytest.raises(ValueError):
        bpe.bpe_ids(F.col("t"), public, 1)


def test_long_words_and_a_full_cache(spark, public, monkeypatch):
    """A word of 400,000 letters takes n log n steps; a full cache is emptied, which changes no id."""
    own = bpe.Encoder(public)
    word = "abracadabra" * 36_000
    assert len("".join(own.parts(word))) == len(word) + len(bpe.WORD_END)
    short = "abracadabra" * 20
    assert own.parts(short) == naive(letters(own, short), own.rank)
    monkeypatch.setattr(bpe, "CACHE", 4)
    texts = [f"w{i} dog cat bird" for i in range(50)]
    assert [own.text_ids(t) for t in texts] == [bpe.encoder(public).text_ids(t) for t in texts] and len(own.known) <= 4


def test_merge_files(tmp_path):
    lines = "#version\na b\nab c</w>\n\n"
    (tmp_path / "m.txt").write_text(lines)
    with gzip.open(tmp_path / "m.txt.gz", "wt") as f:
        f.write(lines)
    (tmp_path / "m.json").write_text(json.dumps({"model": {"merges": ["a b", ["ab", "c</w>"]]}}))
    want = (("a", "b"), ("ab", "c</w>"))
    assert {bpe.read_merges(str(tmp_path / x)) for x in ("m.txt", "m.txt.gz", "m.json")} == {want}
    assert bpe.read_merges(str(tmp_path / "m.txt"), 1) == want[:1] and len(bpe.Encoder(want).id) == 516


def test_query(spark, public):
    """Every document has its row, and ids as the naive loop gives them."""
    own = bpe.encoder(public)
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in catalog.queries()["text_token_ids"](spark, D).collect()}
    assert set(got) == set(text)
    for i, r in list(got.items())[:40]:
        ids = [own.id[x] for w in own.words.findall(bpe.clean(text[i] or "")) for x in naive(letters(own, w), own.rank)][:75]
        assert r["ids"] == [49406, *ids, 49407] + [0] * (75 - len(ids)) and r["n"] == len(ids) + 2
