"""The marker exports without an SQL twin, against every named face counted in plain Python."""

import __spark_entry__ as entry
from lumenreel.plans import adapter as A

D = "/root/testdata/sf0.001"


def test_exports_hold_every_face(spark):
    path = {r["id"]: r["path"] for r in A.videos(spark, D).collect()}
    name = {r["cluster_id"]: r["name"] for r in A.people(spark, D).collect()}
    faces = [r for r in A.faces(spark, D).collect() if r["cluster_id"] in name and r["video_id"] in path]
    every = {(path[r["video_id"]], round(r["timestamp_sec"] / 90_000, 3), name[r["cluster_id"]]) for r in faces}
    text = {q: entry.queries()[q](spark, D).first()["text"] for q in ("edl_text", "fcpxml_text", "marker_table")}
    assert len(every) > 500
    assert [text[q].count(x) for q, x in (("edl_text", "|M:"), ("fcpxml_text", "<marker "), ("marker_table", "{t="))] == [len(every)] * 3
