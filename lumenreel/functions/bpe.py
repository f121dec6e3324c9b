"""Byte-pair encoding of texts into a fixed number of ids, by a list of merges that is an input.

A text is cleaned (NFC, HTML entities resolved twice, white space to single blanks, lower case), cut into words, and each word's UTF-8 bytes
are merged pair by pair, the earliest merge of the list first. A word's candidate pairs wait in a heap by (merge, place), so a word of
n bytes takes n log n steps and not a pass over the word for each merge. Workers keep the ids of words they met, up to CACHE words.

Cases: a null text is an empty one, start and end alone; a text's words are merged only until its ids are full, which gives the same ids as merging
all; the names of start and end inside a text stand for themselves; letters that no merge joins stay single bytes, so every text has ids.
"""

from __future__ import annotations

import gzip
import heapq
import html
import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, functions as F

#: Fixed values of the public vocabulary: names of start and end, the mark of a word's end, the length of a text's ids, and the cut into words.
START, END, WORD_END, LENGTH = "<|startoftext|>", "<|endoftext|>", "</w>", 77
WORDS = r"<\|startoftext\|>|<\|endoftext\|>|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Words of up to CACHE_LETTERS letters are remembered, CACHE of them at most.
CACHE, CACHE_LETTERS = 1 << 17, 40


def byte_letters() -> dict[int, str]:
    """The letter of each byte, in the order of their ids: printing Latin-1 stands for itself, the rest follows from code point 256 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_merges(path: str, most: int | None = None) -> tuple[tuple[str, str], ...]:
    """Pairs of a merge list, earliest first: a tokenizer's JSON file, or lines of two parts (gzip or not) under a heading line; at most the first most pairs."""
    with (gzip.open if path.endswith(".gz") else open)(path, "rt", encoding="utf-8") as f:
        if ".json" in path:
            pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in json.load(f)["model"]["merges"]]
        else:
            next(f, None)
            pairs = [tuple(parts) for line in f if len(parts := line.split()) == 2]
    return tuple(pairs[:most])


class Encoder:
    """Ids of texts. Ids: the byte letters, the same with a word's end, each merge's whole, start, end; of equal wholes the last counts."""

    def __init__(self, merges: Iterable[tuple[str, str]]):
        self.letters = byte_letters()
        self.rank = {pair: i for i, pair in enumerate(merges)}
        single = list(self.letters.values())
        names = [*single, *(x + WORD_END for x in single), *(a + b for a, b in self.rank), START, END]
        self.id = {name: i for i, name in enumerate(names)}
        self.words = regex.compile(WORDS, regex.IGNORECASE)
        self.known: dict[str, list[int]] = {START: [self.id[START]], END: [self.id[END]]}

    def parts(self, word: str) -> list[str]:
        """The parts that a word's bytes are merged to."""
        part = [self.letters[b] for b in word.encode("utf-8", "replace")]
        part[-1] += WORD_END
        n = len(part)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))  # neighbours; n is past the end
        rank = self.rank
        waiting = [(r, i) for i in range(n - 1) if (r := rank.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(waiting)
        while waiting:
            now, joined = waiting[0][0], []
            while waiting and waiting[0][0] == now:  # every place of this merge from the left, before any pair that it makes
                i = heapq.heappop(waiting)[1]
                j = after[i]
                if not part[i] or j >= n or rank.get((part[i], part[j])) != now:
                    continue  # one of the two went into another pair
                part[i], part[j] = part[i] + part[j], ""
                after[i] = after[j]
                if after[i] < n:
                    before[after[i]] = i
                joined.append(i)
            for i in joined:
                for a, b in ((before[i], i), (i, after[i])):
                    if a >= 0 and b < n and (r := rank.get((part[a], part[b]))) is not None:
                        heapq.heappush(waiting, (r, a))
        return [x for x in part if x]

    def word_ids(self, word: str) -> list[int]:
        ids = self.known.get(word)
        if ids is None:
            ids = [self.id[x] for x in self.parts(word)]
            if len(word) <= CACHE_LETTERS:
                if len(self.known) >= CACHE:
                    self.known = {START: self.known[START], END: self.known[END]}
                self.known[word] = ids
        return ids

    def text_ids(self, text: str, most: int | None = None) -> list[int]:
        """The first most ids of a cleaned text, or all."""
        out: list[int] = []
        for w in self.words.finditer(text):
            out += self.word_ids(w.group())
            if most is not None and len(out) >= most:
                return out[:most]
        return out

    def rows(self, texts: list[str], length: int) -> np.ndarray:
        """int32[text, length]: start, ids, end, zeros; a longer text is cut so that the end stays."""
        out = np.zeros((len(texts), length), np.int32)
        for row, t in zip(out, texts, strict=True):
            ids = [self.id[START], *self.text_ids(t, length - 2), self.id[END]]
            row[: len(ids)] = ids
        return out


@lru_cache(maxsize=2)
def encoder(merges: tuple[tuple[str, str], ...]) -> Encoder:
    """One encoder a worker process and list of merges."""
    return Encoder(merges)


def clean(text: str, repair: Callable[[str], str] | None = None) -> str:
    text = html.unescape(html.unescape(unicodedata.normalize("NFC", repair(text) if repair else text)))
    return " ".join(text.split()).lower()


def bpe_ids(c: Column, merges: tuple[tuple[str, str], ...], length: int = LENGTH, repair: Callable[[str], str] | None = None) -> Column:
    """Texts as array<int> of length ids by these merges. repair() mends broken encodings before the cleaning, where the caller has a way to. The
    list of merges goes to the workers with the function: its size is the vocabulary's, whatever the data. Equal texts of a batch are encoded once."""
    if length < 2:
        raise ValueError("start and end need two ids")

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(merges)
        for b in batches:
            at, texts = pd.factorize(b.fillna(""))
            yield pd.Series(list(own.rows([clean(t, repair) for t in texts], length)[at]), dtype=object)

    return run(c.cast("string"))
