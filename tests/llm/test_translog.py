"""Transaction log reassembly against a record-by-record reading of the log."""

import random
import zlib

import numpy as np
import pytest
from lumenreel.llm import translog as tl

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, part long"


def brute(docs, labels):
    """The contract, one record after the other."""
    toxic = {d for d, t in labels if t == 1}
    store, epoch, commits, out = {}, 1, 0, []
    open_ = {}  # source -> list of ("change", doc, key, value) and "save"
    for doc, text, source in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        h = zlib.crc32(str(doc).encode())
        r, tx = h % 23, open_.setdefault(source, [])
        if r <= 1:
            for x in tx:
                if x != "save":
                    store.pop(x[1], None) if x[2] is None else store.update({x[1]: x[2]})
            open_[source] = []
            commits += 1
            if commits % 4 == 0:
                out.append(("state", epoch, len(store), sum(store.values())))
                epoch += 1
        elif r == 2:
            out += [("abort", x[0], doc, x[1]) for x in tx if x != "save"]
            open_[source] = []
        elif r <= 4:
            tx.append("save")
        elif r <= 6:
            while tx and (x := tx.pop()) != "save":
                out.append(("rollback", x[0], doc, x[1]))
        else:
            key = h // 100 % 300
            tx.append((doc, key, None if text is None or doc in toxic else zlib.crc32(f"{key}:{text}".encode())))
    if commits % 4:
        out.append(("state", epoch, len(store), sum(store.values())))
    for tx in open_.values():
        out += [("abort", x[0], None, x[1]) for x in tx if x != "save"]
    return sorted(out, key=str)


def made(n, seed, sources=("a", None, "b", "", "rare"), weights=(30, 5, 8, 2, 0.05)):
    rng = random.Random(seed)
    ids = rng.sample(range(-n, 40 * n), n)
    return [(i, rng.choice([None, "", "text é", f"t{i}"]), rng.choices(sources, weights)[0]) for i in ids], [(i, rng.randint(0, 1)) for i in rng.choices(ids, k=n // 5)]


def run(spark, docs, labels, parts=5, fan=1024):
    d = spark.createDataFrame([(i, t, "en", s, 1, 7, 8) for i, t, s in docs], SCHEMA).repartition(parts)
    lab = spark.createDataFrame(labels, "doc_id long, toxic long")
    return sorted(map(tuple, tl.reassemble(tl.records(d, lab), fan=fan).collect()), key=str)


@pytest.mark.parametrize("n, fan, shuffle", [(40, 1024, 4), (3000, 2, 13), (6000, 1024, 4)])
def test_against_brute_force(spark, n, fan, shuffle, monkeypatch):
    monkeypatch.setattr(tl, "BLOCK", 5)
    docs, labels = made(n, n)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffle)
    try:
        assert run(spark, docs, labels, fan=fan) == brute(docs, labels)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_long_transactions_and_one_source(spark, monkeypatch):
    """Ids that are no markers but at the very end, so a transaction spans batches and ranges."""
    ids = [i for i in range(60_000) if zlib.crc32(str(i).encode()) % 23 > 2][:4000]
    end = next(i for i in range(60_000, 99_999) if zlib.crc32(str(i).encode()) % 23 < 2)
    docs = [(i, f"t{i}", "one") for i in [*ids, end]]
    assert run(spark, docs, [(ids[3], 1)]) == brute(docs, [(ids[3], 1)])
    assert run(spark, docs[:-1], []) == brute(docs[:-1], [])


def test_small_pieces(monkeypatch):
    """_solve read in small batches gives what it gives at once."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    n = 500
    tat = np.sort(rng.integers(0, 60, n))
    cols = {"source": [["a", None, "b"][i % 3] for i in tat], "part": np.zeros(n, int), "at": np.arange(n), "id": np.arange(n), "kind": rng.choice(5, n, p=[0, 0, 0.2, 0.3, 0.5]).astype(np.int32), "key": rng.integers(0, 9, n).astype(np.int32), "value": rng.integers(0, 9, n), "tpart": np.zeros(n, int), "tat": tat, "nth": np.zeros(n, int)}
    ends = np.append(np.flatnonzero(np.diff(tat)), n - 1)
    cols["kind"][ends] = rng.choice([0, 1], len(ends))
    t = pa.table(cols, schema=tl._schema("source string, part long, at long, id long, kind int, key int, value long, tpart long, tat long, nth long"))
    whole = pa.Table.from_batches(list(tl._solve(iter(t.to_batches()))))
    for size, rows in ((7, 20), (1, 1), (100, 3)):
        monkeypatch.setattr(tl, "ROWS", rows)
        assert pa.Table.from_batches(list(tl._solve(iter(t.to_batches(max_chunksize=size))))).equals(whole)


def test_odd_rows(spark):
    assert run(spark, [], []) == []
    docs, labels = made(200, 9)
    assert run(spark, [*docs, (None, "x", "a"), (None, None, None)], [*labels, (None, 1), (docs[0][0], None)]) == brute(docs, labels)
    # rows that share an id are records each; equal rows give equal records
    twice = run(spark, docs + docs, labels)
    assert twice == run(spark, list(reversed(docs + docs)), labels)
    assert sum(r[0] != "state" for r in twice) >= sum(r[0] != "state" for r in brute(docs, labels))


def test_same_as_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    want = sorted(c.sql(f"select kind, id, n, value from ({tl.OP13_SQL})").fetchall(), key=str)
    got = sorted(map(tuple, tl.op13_transaction_log(spark, d).collect()), key=str)
    assert got == want
    docs, labels = c.sql("select doc_id, text, source from documents").fetchall(), c.sql("select doc_id, toxic from labels").fetchall()
    assert got == brute(docs, labels)
