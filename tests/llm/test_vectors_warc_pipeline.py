"""Exact top-k, the WARC source and the pipeline."""

import base64
import hashlib
import random
import re

import duckdb
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenreel.llm import queries, topk, warc
from lumenreel.llm.common import cut

from .fixtures import D

BAD = [(900, None), (901, []), (902, [1.0, None]), (903, [float("nan"), 1.0]), (904, [float("inf"), 0.0]), (None, [1.0] * 8)]


def plain_topk(data, k):
    import math

    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in data if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 5 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok if i != q and len(b) == len(a))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_topk(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = random.Random(1)
    data = [(i, [rng.uniform(-1, 1) * scale for _ in range(8)]) for i in range(70)] + [(i, [0.5] * 8) for i in range(100, 140)] + [(200, [1.0, 2.0, 3.0]), (205, [1.0, 0.0, 0.0])]
    emb = spark.createDataFrame(data + BAD, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(emb, F.col("vec_id") % 5 == 0, 7).collect())
    assert got == plain_topk(data + BAD, 7)
    assert topk.top_k(emb.where("false"), F.lit(True)).count() == 0
    assert topk.top_k(emb.where("vec_id >= 900"), F.lit(True)).count() == 0


def test_topk_of_shared_ids_and_clashing_columns(spark):
    data = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (3, [2.0, 0.5])]
    emb = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    for c in ("dim", "v", "block", "ids", "mat", "n", "top", "slot", "state", "row", "score", "rank"):
        emb = emb.withColumn(c, F.lit("clash"))
    got = topk.top_k(emb, F.col("vec_id") == 0, 10).collect()
    assert sorted(tuple(r) for r in got) == sorted([(0, 1, 3, 128 * 64), (0, 2, 1, 4096), (0, 3, 1, 4096), (0, 1, 1, 4096), (0, 2, 1, 4096), (0, 3, 3, 32 * 64)])


PAGES = [(1, "http://a", "<p>same</p>"), (2, "http://b", "<p>same</p>"), (3, None, None), (4, "http://d", ""), (5, "http://e\r\nx", "é" * 5000), (6, "u", "x" * 300_000), (None, "n", "<p>same</p>"), (None, "m", "only"), (2, "http://b", "<p>same</p>")]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("record_type", F.lit("clash")).repartition(2)


def test_warc_round_trip(spark, tmp_path):
    uri = f"file://{tmp_path}/w"
    warc.register(spark)
    warc.page_records(pages(spark)).write.format("warc").mode("append").save(uri)
    got = warc.read_warc(spark, uri, verify=True).collect()
    assert len(got) == len(PAGES)
    for r in got:
        if r["record_type"] == "response":
            assert base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() == r["payload_digest"] and len(r["payload"]) == r["payload_length"]
    kinds = sorted((r["record_type"], r["target_uri"], r["refers_to"], r["payload_length"]) for r in got if r["target_uri"] in ("http://a", "http://b", "n"))
    assert kinds == [("response", "http://b", None, 11)] * 2 + [("revisit", "http://a", "urn:x-page:2", 11), ("revisit", "n", "urn:x-page:2", 11)]
    assert {bytes(r["payload"]).decode() for r in got if r["target_uri"] == "u"} == {"x" * 300_000}
    narrow = warc.read_warc(spark, uri, "record_id string, record_type string, payload_length long").where("record_type = 'revisit'")
    assert narrow.count() == 3 and not re.search(r"\bFilter\b", narrow._jdf.queryExecution().executedPlan().toString())
    assert warc.read_warc(spark, uri).where(F.col("record_type").isin("response", "x") & F.col("target_uri").startswith("http")).count() == 4
    assert not [x for x in pafs.LocalFileSystem().get_file_info(pafs.FileSelector(f"{tmp_path}/w")) if x.base_name.endswith(".tmp")]


def test_warc_skips_payloads_and_reads_plain_members(tmp_path):
    import gzip
    import io

    raw = [warc.record("response", f"urn:x-page:{i}", "u", None, bytes([65 + i]) * 3_000_000) for i in range(3)]
    plain = gzip.compress(gzip.decompress(raw[1]))
    for data in (b"".join(raw), raw[0] + plain + raw[2]):
        calls = []

        class Counting(io.BytesIO):
            def read(self, n=-1):
                calls.append(n)
                return super().read(n)

        got = [(f["warc-record-id"], n, p) for f, n, p in warc.records(Counting(data), len(data), lambda f: True, False)]
        assert [x[0] for x in got] == [f"<urn:x-page:{i}>" for i in range(3)] and {x[1] for x in got} == {3_000_000} and {x[2] for x in got} == {None}
        assert [p for _, _, p in warc.records(io.BytesIO(data), len(data), lambda f: "2" in f["warc-record-id"], True)] == [b"C" * 3_000_000]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(raw[0][:-2000]), len(raw[0]) - 2000, lambda f: True, True))


def test_warc_appends_and_overwrites(spark, tmp_path):
    """An append keeps the archives that are there, an overwrite replaces them, targets keep their white space, and nothing temporary stays."""
    uri = f"file://{tmp_path}/w"
    warc.register(spark)
    some = lambda a, n: spark.range(a, a + n, 1, 2).selectExpr("'response' AS record_type", "concat('urn:x-page:', id) AS record_id", "concat('http://a b/', id) AS target_uri", "CAST(NULL AS STRING) AS refers_to", "encode(repeat('p', 9), 'UTF-8') AS payload")
    ids = lambda: sorted(int(r[0].rsplit(":", 1)[1]) for r in warc.read_warc(spark, uri, "record_id string").collect())
    some(0, 10).write.format("warc").mode("append").save(uri)
    some(10, 10).write.format("warc").mode("append").save(uri)
    assert ids() == list(range(20))
    assert {r[0] for r in warc.read_warc(spark, uri, "target_uri string").collect()} == {f"http://a%20b/{i}" for i in range(20)}
    some(40, 10).write.format("warc").mode("overwrite").save(uri)
    assert ids() == list(range(40, 50))
    left = [x.base_name for x in pafs.LocalFileSystem().get_file_info(pafs.FileSelector(f"{tmp_path}/w"))]
    assert len(left) == 2 and all(x.endswith(".warc.gz") for x in left)
    some(0, 0).write.format("warc").mode("overwrite").save(uri)
    assert ids() == []


def test_warc_tasks_that_run_twice_leave_one_file(tmp_path, monkeypatch):
    """A second attempt of a task, or one that died, leaves nothing beside the file of the attempt that won."""
    import pyarrow as pa

    monkeypatch.setattr(warc, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 3)}))}))
    w = warc.WarcWriter({"path": str(tmp_path)})
    batch = pa.RecordBatch.from_pylist([{"record_type": "response", "record_id": "a", "target_uri": "u", "refers_to": None, "payload": b"x"}], pa.schema({"record_type": pa.string(), "record_id": pa.string(), "target_uri": pa.string(), "refers_to": pa.string(), "payload": pa.binary()}))
    first, second = w.write(iter([batch])), w.write(iter([batch]))
    assert first.temporary != second.temporary
    w.commit([second])
    assert [x.name for x in tmp_path.iterdir()] == [second.final.rsplit("/", 1)[1]]
    other = warc.WarcWriter({"path": str(tmp_path)})
    other.write(iter([batch]))
    other.abort([None])
    assert [x.name for x in tmp_path.iterdir()] == [second.final.rsplit("/", 1)[1]]


def test_warc_of_nothing(spark, tmp_path):
    uri = f"file://{tmp_path}/w"
    warc.register(spark)
    warc.page_records(pages(spark).where("false")).write.format("warc").mode("append").save(uri)
    assert warc.read_warc(spark, uri).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        c.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    df = queries.queries()[name](spark, D)
    cols = sorted(df.columns)
    want = c.sql(f"select {', '.join(cols)} from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.select(*cols).collect())


def test_pipeline_stages(spark):
    """Each stage on all that its predecessor kept: what stays is a subset by id, and the columns stay."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "simhash near-dedup", "benchmark decontamination", "packing"]
    ids, columns = {r[0] for r in docs.select("doc_id").collect()}, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, D), "test-stage")
        now = {r[0] for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and now <= ids and len(now) > 0.6 * len(ids), name
        assert name != "line dedup" or now == ids
        ids = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, D)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == ids
    run = corpus_pipeline.run(spark, D)
    assert sorted(map(tuple, run.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, packed.select("doc_id", "start", "length", "ids_crc32").collect()))


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, shared ids and clashing names."""
    clash = ["key", "node", "fp", "cell", "root", "class", "component_id", "gone", "of", "_id", "marks", "n", "held_out", "score", "first", "lo", "norm", "_gone", "_gone_id", "_gone_id_", "_FP"]
    base = spark.read.parquet(f"{D}/documents.parquet")
    bench = spark.read.parquet(f"{D}/benchmark.parquet").first()["text"]
    some = base.limit(20).collect()
    line = "a very ordinary sentence that stands here once more "
    odd = [(None, line * 5, None, None, None), (None, None, None, None, None), (9001, None, "en", "s", 0), (9002, "", None, "s", None), (9003, " \n\t\n", None, None, 3), (9004, "x", None, None, 1), (9005, f"before {bench} after", "en", "s", 0), (9006, " ".join(f"w{i % 977}" for i in range(150_000)), "en", "s", 0)]
    odd += [(9007, line * 3, "en", "s", 0)] * 3 + [(9007, "another text under the same id, with words of its own", "en", "s", 0)]
    docs = spark.createDataFrame([tuple(r) for r in some] + odd, base.schema).repartition(3)
    for c in clash:
        docs = docs.withColumn(c, F.lit(1))
    columns, n = docs.columns, docs.count()
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, D), "test-odd")
        assert docs.columns == columns and docs.count() <= n, name
        n = docs.count()
        seen[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert {9001, 9002, 9004, 9005, 9006, 9007, None} <= seen["line dedup"] and 9005 not in seen["benchmark decontamination"]
    assert docs.where("doc_id = 9007").count() == 2  # three equal rows are one, and the text of its own stays
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, D)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_pipeline_of_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, D), "test-empty")
    assert docs.count() == 0
