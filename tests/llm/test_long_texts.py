"""Texts that a tokeniser can't take whole in one way are taken in another, with the same ids."""

import numpy as np
import pytest
from lumenreel.llm import packing
from tokenizers import Tokenizer


@pytest.mark.parametrize("text", [" " * 5_000_000, "\n" * 2_000_000 + "end", "a " + "\t" * 1_500_000 + " b  c", " \n" * 700_000 + "x" * 1000, "word  <|endoftext|>" * 3000 + "\u3000" * 200_000])
def test_long_runs_of_white_space(text):
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    assert packing.ByteBpe().ids(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_short_runs_take_the_quick_way():
    b = packing.ByteBpe()
    assert b.ids("a" + " " * 5000 + "b") and b.whole is None


def test_one_such_document_packs(spark):
    docs = spark.createDataFrame([(1, " " * 1_200_000), (2, "short")], "doc_id long, text string")
    got = packing.pack_documents(docs).collect()
    assert sum(r.length for r in got if r.doc_id == 1) == [r.doc_tokens for r in got if r.doc_id == 1][0]
