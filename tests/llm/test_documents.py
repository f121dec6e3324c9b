"""Decontamination, packing, SimHash, line and substring dedup against plain versions."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumenreel.llm import common, decontaminate, linededup, packing, simhash, substring

from .fixtures import D, docs, empty, rows


class Sets(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            self[x] = x = self[self[x]]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self[b] = a


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, 1000 + i) for i in range(1, 400)] + [(2000 + i, 2001 + i) for i in range(150)]
    s = Sets()
    for a, b in edges:
        s.join(a, b)
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: s.find(x) for e in edges for x in e if any(y != x for f in edges if x in f for y in f)}
    path = [(i, i + 1) for i in range(3000)]  # a long path takes many rounds
    rng.shuffle(path)
    assert {r["root"] for r in common.components(spark.createDataFrame(path, "a long, b long")).select("root").distinct().collect()} == {0}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_hits(text, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        v = words(t)
        for k in range(max(1, len(v) - n + 1) if v else 0):
            win = v[k : k + n]
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    ids |= {str(item)} - {"None"}
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def test_decontaminate(spark):
    data = rows()
    lines = [t for r in data if r[1] for t in r[1].split("\n")]
    items = [(1, lines[6]), (2, "one, TWO"), (3, None), (4, " ... "), (10, " ".join(lines[-4].split()[:14])), (10, " ".join(lines[-4].split()[:14])), (None, "x"), (11, "x"), (None, lines[8])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r)[:5] for r in decontaminate.decontaminate(docs(spark), bench).collect()), key=str)
    assert got == sorted(((r[0], *plain_hits(r[1], items)) for r in data), key=str)
    r = decontaminate.decontaminate(docs(spark), bench).where("doc_id = 4").first()
    assert [tuple(s) for s in r["hit_spans"]] == [(0, 7)] and r["contaminated"]
    kept = decontaminate.clean(docs(spark), bench)
    assert kept.columns == docs(spark).columns and kept.count() == sum(not plain_hits(x[1], items)[1] for x in data)
    assert decontaminate.decontaminate(empty(spark), bench).count() == 0
    assert not decontaminate.decontaminate(docs(spark), bench.where("false")).where("contaminated").count()


def test_automaton_finds_overlapping_and_nested_windows(monkeypatch):
    rng = random.Random(7)
    word = lambda: rng.choice("abcd")  # noqa: E731  few words, so windows overlap and suffixes of windows begin others
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 3, 5, 9, 10, 11, 14])))) for i in range(12)] + [(None, "a b c d d c b a")]
    texts = [" ".join(word() for _ in range(rng.choice([0, 1, 7, 40, 300, 1000]))) for _ in range(12)] + [None, "zz zz", "A-b.C"]
    for segment, block in ((96, 400_000), (1, 50), (7, 400_000)):
        monkeypatch.setattr(decontaminate, "SEGMENT", segment)
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        for keep in (items, [i for i in items if len(i[1].split()) > 5], []):
            got = decontaminate.Automaton(keep).scan(texts)
            assert [(n, int(h.sum()) if h is not None else 0, len(i), hashlib.sha256(",".join(i).encode()).hexdigest()) for n, h, i in [(n, h, sorted(map(str, i))) for n, h, i in got]] == [plain_hits(t, keep) for t in texts]


def test_a_benchmark_beyond_the_bound_is_refused(monkeypatch):
    monkeypatch.setattr(decontaminate, "NODES", 20)
    with pytest.raises(ValueError, match="20 nodes"):
        decontaminate.Automaton([(1, " ".join(map(str, range(30))))])


def test_tokens_are_those_of_the_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    t, bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.ByteBpe()
    for x in ["", " ", "a  b", "a \n b", " x", "x ", "don't 'll", "é x²3 ½ 日本", "\n\n a", "a b", "<|endoftext|> 12345 \t\t!", *[r[1] for r in rows() if r[1]]]:
        t.encode_special_tokens = True
        assert np.frombuffer(bpe.ids(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_pack_documents(spark):
    bpe = packing.ByteBpe()
    data = [r for r in rows() if r[0] is not None]
    got = packing.pack_documents(docs(spark, data)).collect()
    ids = {r[0]: [*np.frombuffer(bpe.ids(r[1] or ""), "<u4").tolist(), 0] for r in data}
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part)) and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, t in ids.items():
        at = 0
        for s, n in sorted(pieces[d]):
            assert s == at
            at += n
        assert at == len(t)
    padding = 0
    for p in seqs.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0
    assert packing.pack_documents(empty(spark)).count() == 0


def test_pack_of_rows_without_or_with_shared_ids(spark):
    got = Counter()
    data = [(None, "a b", None, None, 0, 0, 0), (None, None, None, None, 0, 0, 0), (7, "x", None, None, 0, 0, 0), (7, "x", None, None, 0, 0, 0), (7, "y z", None, None, 0, 0, 0), (8, "word " * 9000, None, None, 0, 0, 0)]
    for r in packing.pack_documents(docs(spark, data)).collect():
        got[r["doc_id"]] += r["length"]
    bpe = packing.ByteBpe()
    want = Counter()
    for d, t, *_ in data:
        want[d] += len(bpe.ids(t or "")) // 4 + 1
    assert got == want


def test_tokens_of_random_strings():
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(9)
    t, bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.ByteBpe()
    t.encode_special_tokens = True
    alphabet = "ab zé日ß½²①\t\n\r '.-_<|>0١\u0301\u200d😀\u00a0"
    for _ in range(3000):
        x = "".join(rng.choice(alphabet) if rng.random() < 0.8 else chr(rng.choice([rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x11000)])) for _ in range(rng.randrange(30)))
        assert np.frombuffer(bpe.ids(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, ascii(x)


def test_packed_conversations(spark):
    rng = random.Random(6)
    words = lambda n: " ".join(rng.choice(["one", "two", "three", "Étion"]) for _ in range(n))
    data = [(c, t, "assistant" if t % 2 else "user", words(rng.choice([1, 30, 200, 900]))) for c in range(40) for t in range(6)]
    data += [(90, 0, "assistant", "alone"), (91, 0, "user", None), (91, 1, "assistant", None), (92, 1, "assistant", "x"), (92, 0, "user", "b"), (92, 0, "user", "a"), (None, 1, "assistant", "x"), (93, None, "assistant", "x"), (93, 1, None, "x")]
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("prompt", F.lit("clash")).withColumn("tokens", F.lit(5)).repartition(3)
    limits = packing.Limits(256, 5, 100)
    bpe = packing.ByteBpe()
    n = lambda x: len(bpe.ids(x or "")) // 4
    said = {}
    for c, t, r, x in data:
        if c is not None and t is not None and r == "user":
            said[c, t] = min(x or "", said.get((c, t), x or ""))
    want = {(c, t): (n(said.get((c, t - 1), "")) + n(x) + 1, n(x) + 1) for c, t, r, x in data if r == "assistant" and c is not None and t is not None}
    seqs, done = defaultdict(list), Counter()
    for r in packing.pack_conversations(turns, limits).collect():
        key = r["conv_id"], r["turn"]
        assert (r["tokens"], r["loss"]) == want[key]
        done[key] += r["length"]
        seqs[r["sequence_id"]].append((r["offset"], r["length"], max(0, r["start"] + r["length"] - max(r["start"], r["tokens"] - r["loss"]))))
    assert done == Counter({k: t for k, (t, _) in want.items()})
    for p in seqs.values():
        assert [o for o, _, _ in sorted(p)] == [sum(x[1] for x in sorted(p)[:i]) for i in range(len(p))]
        assert sum(x[1] for x in p) <= 256 and len(p) <= 5 and sum(x[2] for x in p) <= 100
    assert any(sum(x[2] for x in p) == 100 and sum(x[1] for x in p) < 256 for p in seqs.values())  # the loss limit binds alone
    real = packing.packed_conversations(spark, "/root/testdata/sf0.01").collect()
    tasks, used = {r["sequence_id"] >> 40 for r in real}, len({r["sequence_id"] for r in real})
    pieces = {(r["conv_id"], r["turn"]): (r["tokens"], r["loss"]) for r in real}
    least = max(sum(t for t, _ in pieces.values()) / 1024, sum(b for _, b in pieces.values()) / 768)
    print(used, least, len(tasks))
    assert used <= 1.1 * least + 10 * len(tasks)  # a task's last sequence is cut to powers of two
    assert packing.pack_conversations(turns.where("false")).count() == 0


@pytest.mark.parametrize("cut", [True, False])
def test_pack_keeps_limits(cut):
    rng = random.Random(5)
    limits = packing.Limits(100, 4, 60)
    ex = [(i, n := rng.randint(1, 100), min(n, rng.randint(0, 60))) for i in range(500)] + ([(999, 1000, 700)] if cut else [])
    seqs, done = defaultdict(list), Counter()
    loss = {k: (t, l) for k, t, l in ex}
    for k, start, n, s, at in packing.pack(iter(ex), limits, cut, 50):
        t, l = loss[k]
        seqs[s].append((at, n, max(0, start + n - max(start, t - l))))
        done[k] += n
    assert done == Counter({k: t for k, t, _ in ex})
    for p in seqs.values():
        assert sum(x[1] for x in p) <= 100 and len(p) <= 4 and sum(x[2] for x in p) <= 60
    if not cut:
        with pytest.raises(ValueError):
            list(packing.pack(iter([(1, 101, 1)]), limits, False))


def plain_fingerprint(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark):
    data = rows()
    got = simhash.near_duplicates(docs(spark)).collect()
    fps = [(r[0], plain_fingerprint(r[1])) for r in data]
    s = Sets()
    for i, (_, a) in enumerate(fps):
        for j, (_, b) in enumerate(fps):
            if (a ^ b).bit_count() <= 3:
                s.join(i, j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(fps):
        least[s.find(i)].append(d)
    want = sorted(((d, f"{f:016x}", min(x for x in least[s.find(i)] if x is not None)) for i, (d, f) in enumerate(fps)), key=str)
    assert sorted((tuple(r)[:3] for r in got), key=str) == want
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.keep_one(docs(spark))
    assert kept.columns == docs(spark).columns
    assert {r["doc_id"] for r in kept.collect()} == {x[2] for x in want} | {None}
    twice = docs(spark, rows() + rows())
    assert simhash.keep_one(twice).where("doc_id is not null").count() == len({x[2] for x in want})


def test_simhash_links_at_a_similarity(spark):
    rng = random.Random(6)
    base, data = [[rng.choice("abcdefghij") + str(rng.randrange(200)) for _ in range(120)] for _ in range(6)], []
    for w in base:
        for k in (0, 1, 2, 3, 8):
            v = list(w)
            for at in range(5, 5 + 14 * k, 14):
                v[at] = "changed"
            data.append((len(data), " ".join(v), None, None, 0, 0, 0))
    data += [(100, None, None, None, 0, 0, 0), (101, "", None, None, 0, 0, 0)]
    sets = {r[0]: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for r in data if (w := (r[1] or "").split())}
    fps, want = {r[0]: plain_fingerprint(r[1], 5) for r in data}, Sets()
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert sum((fps[a] ^ fps[b]).bit_count() > 3 for a, b in pairs) > 10
    for a, b in [*pairs, *[(a, b) for a in fps for b in fps if (fps[a] ^ fps[b]).bit_count() <= 3]]:
        want.join(a, b)
    assert {r["doc_id"] for r in simhash.keep_one(docs(spark, data), 5, 0.8).collect()} == {want.find(a) for a in fps}
    assert simhash.keep_one(empty(spark), 5, 0.8).count() == 0


def test_keep_one_decides_per_row(spark):
    rng = random.Random(8)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(5))
    data = [(i, t, None, None, 0, 0, 0) for i, t in [(1, a), (2, a), (2, b), (3, b), (4, c), (4, d), (5, e), (5, e), (None, a)]]
    got = Counter((r["doc_id"], r["text"]) for r in simhash.keep_one(docs(spark, data)).collect())
    assert got == Counter([(1, a), (2, b), (4, c), (4, d), (5, e), (None, a)])


def test_hamming_index_is_exact(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [int(b) for b in base] + [int(b) ^ sum(1 << int(x) for x in rng.choice(64, rng.integers(1, 6), replace=False)) for b in base for _ in range(12)]
    near = sorted(set(near))
    want = Sets()
    for i, a in enumerate(near):
        for b in near[:i]:
            if (a ^ b).bit_count() <= 3:
                want.join(a, b)
    signed = [(x - 2**64 if x >> 63 else x,) for x in near]
    for chunk in (2048, 8):
        got = Sets()
        for r in simhash.links(spark.createDataFrame(signed, "fp long"), chunk).collect():
            a, b = r["a"] % 2**64, r["b"] % 2**64
            got.join(a, b)
        assert all((got.find(a) == got.find(b)) == (want.find(a) == want.find(b)) for a in near for b in near[::7])
    gray = sorted(near, key=lambda x: x)
    fp = np.array(gray, np.uint64)
    a, b = simhash.group_links(fp)
    assert {(int(i), int(j)) for i, j in zip(a, b, strict=True)} == {(i, j) for j in range(len(fp)) for i in range(j) if (gray[i] ^ gray[j]).bit_count() <= 3}


def gray(x):
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(k))
    return x


@pytest.mark.parametrize("leaf", [1, 2, 3, 16])
def test_trees_of_many_groups(leaf):
    """Groups of any size searched together give each its own links, near copies or not."""
    rng = np.random.default_rng(leaf)
    parts = []
    for n in [1, 2, 3, 1, 64, 65, *rng.integers(1, 90, 30).tolist(), 300]:
        base = rng.integers(0, 2**63, 1 + n // 4, dtype=np.uint64)
        x = np.unique(np.array([int(rng.choice(base)) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(n)], np.uint64))
        parts.append(x[np.argsort(gray(x), kind="stable")])
    fp, starts = np.concatenate(parts), np.cumsum([0] + [len(x) for x in parts[:-1]])
    want = {(s + i, s + j) for s, x in zip(starts.tolist(), parts, strict=True) for j in range(len(x)) for i in range(j) if (int(x[i]) ^ int(x[j])).bit_count() <= 3}
    a, b = simhash.group_links(fp, starts, leaf=leaf)
    assert len(a) == len(want) and set(zip(a.tolist(), b.tolist(), strict=True)) == want
    none = simhash.group_links(fp[:0], starts[:0], leaf=leaf)
    assert len(none[0]) == len(none[1]) == 0


def test_index_prunes_and_finds_all_links(spark, monkeypatch):
    """Over the fingerprints of sf0.1: every link comes out of a tree, and pairs of nodes are pruned above the leaves."""
    import pyarrow as pa

    path = "/root/testdata/sf0.1/documents.parquet"
    fp = np.array([r[0] for r in simhash.fingerprints(spark.read.parquet(path)).select("fp").distinct().collect()], np.int64).view(np.uint64)
    fp = fp[np.argsort(gray(fp), kind="stable")]
    seen, real = [0, 0], simhash._within

    def counted(pattern, mask, x, y, limit):
        near = real(pattern, mask, x, y, limit)
        seen[0] += int((x != y).sum())
        seen[1] += int((~near).sum())
        return near

    monkeypatch.setattr(simhash, "_within", counted)
    got, want = set(), set()
    for m in simhash.MASKS:
        key = (fp & np.uint64(m % 2**64)).view(np.int64)
        order = np.argsort(key, kind="stable")
        batch = pa.RecordBatch.from_arrays([pa.array(key[order]), pa.array(fp[order].view(np.int64))], names=["cell", "fp"])
        for b in simhash._tree_links(iter([batch])):
            got |= {frozenset(x) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    for i in range(len(fp)):
        want |= {frozenset((int(fp[i : i + 1].view(np.int64)[0]), int(fp[j : j + 1].view(np.int64)[0]))) for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= 3) + i + 1}
    a, b = Sets(), Sets()
    for x, y in map(tuple, got):
        a.join(x, y)
    for x, y in map(tuple, want):
        b.join(x, y)
    assert want and {x: a.find(x) for p in want for x in p} == {x: b.find(x) for p in want for x in p} and not {x for p in got for x in p} - {x for p in want for x in p}
    assert 0 < seen[1] <= seen[0], seen


def test_gray_rank(spark):
    got = spark.range(64).select(simhash.gray_rank(F.col("id").bitwiseXOR(F.shiftrightunsigned("id", 1))).alias("r"), "id").where("r != id")
    assert got.count() == 0


def plain_lines(data):
    k, first, gone, nodes = 9, {}, defaultdict(list), {}
    for d, t, *_ in sorted((r for r in data if r[0] is not None), key=lambda r: r[0]):
        for i, n in linededup.lines_of(t):
            nodes.setdefault(n, frozenset(n[j : j + k] for j in range(max(1, len(n) - k + 1))))
    s, names = Sets(), list(nodes)
    for i, a in enumerate(names):
        for b in names[:i]:
            both = len(nodes[a] & nodes[b])
            if both >= 0.8 * (len(nodes[a]) + len(nodes[b]) - both) - 1e-9:
                s.join(a, b)
    for d, t, *_ in sorted((r for r in data if r[0] is not None), key=lambda r: r[0]):
        for i, n in linededup.lines_of(t):
            if first.setdefault(s.find(n), (d, i)) != (d, i):
                gone[d].append(i)
    return gone


@pytest.mark.parametrize("chunk", [128, 2])
def test_line_dedup(spark, monkeypatch, chunk):
    monkeypatch.setattr(linededup, "CHUNK", chunk)
    data = rows()
    gone = plain_lines(data)
    got = linededup.dedup(docs(spark))
    assert got.columns == docs(spark).columns
    want = sorted(((r[0], r[1] if r[0] is None or r[1] is None else "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in gone[r[0]])) for r in data), key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == want
    assert sum(map(len, gone.values())) > 20
    assert linededup.dedup(empty(spark)).count() == 0


def test_line_query_against_a_plain_version(spark, tmp_path):
    data = rows(3)
    docs(spark, data).drop("key", "node").write.parquet(f"{tmp_path}/documents.parquet")
    gone = plain_lines(data)
    first = {}  # of each class, over all lines in order
    s, names = Sets(), {}
    for d, t, *_ in sorted((r for r in data if r[0] is not None), key=lambda r: r[0]):
        for i, n in linededup.lines_of(t):
            names[d, i] = n
    texts = sorted(set(names.values()))
    sets = {n: frozenset(n[j : j + linededup.SHINGLE] for j in range(max(1, len(n) - linededup.SHINGLE + 1))) for n in texts}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                s.join(a, b)
    for k in sorted(names):
        first.setdefault(s.find(names[k]), k)
    want = []
    for d, t, *_ in data:
        lost = sorted(gone[d]) if d is not None else []
        text = t if d is None or t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in lost)
        want.append((d, len(t.split("\n")) if t else 0, len(lost), [(i, *first[s.find(names[d, i])]) for i in lost], hashlib.sha256((text or "").encode()).hexdigest()))
    got = [(r["doc_id"], r["n_lines"], r["n_removed"], [tuple(x) for x in r["duplicates"]], r["kept_sha256"]) for r in linededup.op4_line_dedup(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_lines_of_rows_that_share_an_id(spark):
    text = "a line that is long enough to be alike\nanother line\n\na third line here"
    data = [(1, text, None, None, 0, 0, 0), (2, text, None, None, 0, 0, 0), (2, text, None, None, 0, 0, 0), (None, text, None, None, 0, 0, 0), (3, "\n".join(["same line again and again"] * 20_000), None, None, 0, 0, 0)]
    got = sorted(((r["doc_id"], r["text"]) for r in linededup.dedup(docs(spark, data)).collect()), key=str)
    assert got == sorted([(1, text), (2, ""), (2, ""), (3, "same line again and again"), (None, text)], key=str)


def test_a_hot_line_is_a_row_a_chunk(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(linededup, "HELD", 100)
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([f"the line in every document\nown line {i} of it" for i in range(1000)])], names=["doc_id", "text"])
    out = pa.Table.from_batches(linededup._lines(iter([batch])))
    hot = linededup.node("the line in every document")
    assert out.num_rows == 1000 + 20 and sum(r == hot for r in out["node"].to_pylist()) == 20
    assert sum(len(x) for x in out["of"].to_pylist()) == 2000 and sum(x is not None for x in out["norm"].to_pylist()) == 1001


def test_line_query(spark):
    r = linededup.op4_line_dedup(spark, D)
    assert r.count() == spark.read.parquet(f"{D}/documents.parquet").count()
    assert r.where("n_removed > n_lines or size(duplicates) != n_removed").count() == 0


def test_shared_keys_across_batches():
    import pyarrow as pa

    rng = random.Random(4)
    pairs = sorted(((rng.randrange(30), rng.randrange(12)) for _ in range(200)), key=lambda p: p[0])
    want = sorted({p for p in pairs if len({n for k, n in pairs if k == p[0]}) > 1})
    for size in (1, 2, 3, 7, 200):
        for most in (1_000_000, 3):
            cuts = [pairs[i : i + size] for i in range(0, len(pairs), size)]
            got = [x for b in linededup._shared((pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*x, strict=True)], names=["key", "node"]) for x in cuts), most) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            assert (got if most > 3 else sorted(set(got))) == want


def plain_substring(data):
    first, out = {}, []
    for d, t, *_ in sorted((r for r in data if r[0] is not None), key=lambda r: r[0]):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for i in range(len(w) - 19):
            first.setdefault(tuple(w[i : i + 20]), (d, i))
    for d, t, *_ in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = {j for i in range(len(w) - 19) if d is not None and (d, i) > first[tuple(w[i : i + 20])] for j in range(i, i + 20)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def test_substring_of_shared_ids_and_hot_windows(spark, monkeypatch):
    rng = random.Random(2)
    hot = " ".join(f"h{i}" for i in range(25))
    data = [(i, f"{hot} " + " ".join(f"w{rng.randrange(30)}" for _ in range(40)), None, None, 0, 0, 0) for i in range(60)]
    want = plain_substring(data)
    for held in (substring.HELD_BYTES, 400):
        monkeypatch.setattr(substring, "HELD_BYTES", held)
        monkeypatch.setattr(substring, "GROUP", 8)
        assert sorted((tuple(r)[:4] for r in substring.remove_repeats(docs(spark, data)).collect()), key=str) == want
    twice = [(5, hot, None, None, 0, 0, 0), (5, hot, None, None, 0, 0, 0), (6, hot, None, None, 0, 0, 0), (None, hot, None, None, 0, 0, 0)]
    assert sorted(((r["doc_id"], r["n_removed"]) for r in substring.remove_repeats(docs(spark, twice)).collect()), key=str) == [(5, 0), (5, 0), (6, 25), (None, 0)]


@pytest.mark.parametrize("group", [4096, 2])
def test_substring(spark, monkeypatch, group):
    monkeypatch.setattr(substring, "GROUP", group)
    data = rows()
    got = substring.remove_repeats(docs(spark))
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == plain_substring(data)
    assert substring.remove_repeats(empty(spark)).count() == 0
