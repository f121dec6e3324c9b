"""Exports joined in parts against lines joined at once."""

import random

from lumenreel.operators import timeline


def test_parts_join_as_one(spark):
    lines = spark.createDataFrame([(n, f"line {n}\n") for n in random.Random(1).sample(range(1, 101), 100)], "n long, line string").repartition(5)
    parts = timeline.text_parts(lines, 7)
    sizes = [r["text"].count("line") for r in parts.collect()]
    assert len(sizes) == 15 and max(sizes) == 7
    assert [r["text"] for r in timeline.one_text(parts).collect()] == ["\n".join(f"line {n}\n" for n in range(1, 101))]
    assert timeline.one_text(parts.where("part < 0")).count() == 0


def test_texts_in_parts(spark, monkeypatch):
    lay = spark.createDataFrame([(f"/a/C{i:02d}.mov", 1, 25, 100 * i, 100) for i in range(20)], "path string, num int, den int, offset_frames long, dur_frames long")
    markers = spark.createDataFrame([(f"/a/C{i:02d}.mov", t / 2, "x") for i in range(1, 20) for t in range(5)], "path string, t double, label string")
    starts = lay.selectExpr("path", "1.0D as start_sec")
    make = (lambda: timeline.edl(lay, markers)), (lambda: timeline.fcpxml(lay, markers, starts)), (lambda: timeline.marker_table(markers))
    whole = [f().first()["text"] for f in make]
    monkeypatch.setattr(timeline.text_parts, "__defaults__", (3,))
    assert [[r["text"] for r in f().collect()] for f in make] == [[t] for t in whole]
    edl, xml, lua = whole
    assert edl.startswith("TITLE: Markers\nFCM: NON-DROP FRAME\n\n001  ") and edl.count("|D:1\n") == 95 and edl.count("\n\n") == 95
    assert xml.count("<asset id=") == xml.count("<asset-clip ") == 20 and "\n\n" not in xml and xml.endswith("</fcpxml>\n")
    assert lua.startswith('local markers = {\n  ["C01.mov"]') and lua.endswith("},\n}\n") and lua.count("\n") == 21
