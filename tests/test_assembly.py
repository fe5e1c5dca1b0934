"""Literal cases of sequence assembly and of what makes recordings drop out."""

import pytest

from kinetrail.functions import motion, pairs
from kinetrail.functions.sequences import features
from kinetrail.operators.assembly import Parameters, assemble, siblings

META = "lab_id string, video_id long, behaviors_labeled string, frames_per_second double, arena_width_cm double, arena_height_cm double, arena_shape string, pix_per_cm_approx double"
TRACK = "lab_id string, video_id long, video_frame int, mouse_id int, bodypart string, x double, y double"
NOTES = "lab_id string, video_id long, agent_id int, target_id int, action string, start_frame int, stop_frame int"
LIST = '["mouse1,self,Rear", "mouse1,self,dig", "mouse3,self,rear", "mouse1,mouse2,chase", "mouse2,mouse1,mount", "mouse2,mouse2,odd", "mouse8,self,rear"]'


@pytest.fixture(scope="module")
def tables(spark):
    meta = [("a", v, LIST if v != 4 else None, 25.0, 40.0, 30.0, "circular", 2.0) for v in (1, 2, 3, 4)] + [("a", 5, "not json", 25.0, 40.0, 30.0, "square", 2.0)]
    track = [("a", v, f, m, p, 10.0 * f, 4.0 * m) for v in (1, 2, 4, 5, 6) for f in range(6) for m in (1, 2) for p in ("nose", "ear_left", "odd")]
    notes = [("a", 1, 1, 1, "REAR", 1, 2), ("a", 1, 1, 1, "rear", 2, 3), ("a", 1, 1, 2, "chase", 0, 1), ("a", 1, 2, 1, "chase", 0, 5), ("a", 1, 1, 2, "unlisted", 0, 5), ("a", 1, 1, 1, "dig", None, 2), ("a", 2, 2, 1, "mount", 5, 9)]
    return spark.createDataFrame(meta, META), spark.createDataFrame(track, TRACK).repartition(3), spark.createDataFrame(notes, NOTES)


P = Parameters(parts=("nose", "ear_left"))


def test_labels_of_frames(tables):
    meta, track, notes = tables
    got = assemble(meta, track, P, notes)
    single = {(r["video"]["video_id"], r["agent"], r["frame"]): r for r in got.single.collect()}
    # mouse1 and, as the one before it, mouse3's neighbour mouse2 are tracked; mouse8 is not
    assert {k[:2] for k in single} == {("1", "mouse1"), ("1", "mouse3"), ("2", "mouse1"), ("2", "mouse3")} and len(single) == 24
    assert [single["1", "mouse1", f]["y"] for f in range(6)] == [{"dig": False, "rear": 1 <= f <= 3} for f in range(6)]
    assert single["1", "mouse3", 0]["y"] == {"rear": False} and single["1", "mouse1", 2]["nose_x"] == 10.0 and single["1", "mouse1", 2]["arena_shape"] == "circular"
    pair = {(r["video"]["video_id"], r["agent"], r["target"], r["frame"]): r for r in got.pair.collect()}
    assert {k[:3] for k in pair} == {(v, *t) for v in "12" for t in (("mouse1", "mouse2"), ("mouse2", "mouse1"))} and len(pair) == 24
    assert [pair["1", "mouse1", "mouse2", f]["y"]["chase"] for f in range(6)] == [True, True, False, False, False, False]
    assert pair["2", "mouse2", "mouse1", 5]["y"] == {"mount": True} and not any(pair["1", "mouse2", "mouse1", f]["y"]["mount"] for f in range(6))
    assert pair["2", "mouse2", "mouse1", 0]["B_nose_y"] == 2.0 and pair["2", "mouse2", "mouse1", 0]["fps"] == 25.0


def test_splits_and_denied_recordings(spark, tables):
    meta, track, notes = tables
    test = assemble(meta, track, Parameters(split="test", parts=P.parts))
    assert "y" not in test.single.columns and test.single.filter("agent = 'mouse1'").select("actions").first()[0] == ["dig", "rear"]
    none = assemble(meta, track, Parameters(parts=P.parts, deny=(("a", 1),)), notes)
    assert {r[0]["video_id"] for r in none.single.select("video").distinct().collect()} == {"2"}
    only = assemble(meta, track, P, notes, annotated=spark.createDataFrame([("a", "1"), ("zz", "2")], "lab_id string, video_id string"))
    assert {r[0]["video_id"] for r in only.pair.select("video").distinct().collect()} == {"1"}
    # an annotation without rows keeps a recording
    bare = assemble(meta, track, P, notes.limit(0), annotated=spark.createDataFrame([("a", "2")], "lab_id string, video_id string")).single.collect()
    assert len(bare) == 12 and not any(v for r in bare for v in r["y"].values())
    with pytest.raises(ValueError, match="annotations"):
        assemble(meta, track, P)
    empty = assemble(meta.limit(0), track.limit(0), P, notes.limit(0))
    assert empty.single.count() == empty.pair.count() == 0


def test_sequences_feed_the_families(tables):
    meta, track, notes = tables
    got = assemble(meta, track, P, notes)
    one, two = features(got.single, motion.jitter, motion.arena), features(got.pair, pairs.pair_motion)
    assert one.count() == 24 and two.count() == 24 and "arena_wall_dist" in one.columns and "nn" in two.columns and "ab_cd" not in two.columns


def test_siblings_are_listed_not_read(spark, tmp_path):
    for lab, video in (("a", "1"), ("b b", "2")):
        (tmp_path / "notes" / lab).mkdir(parents=True, exist_ok=True)
        (tmp_path / "notes" / lab / f"{video}.parquet").write_bytes(b"no parquet")
    (tmp_path / "notes" / "a" / "x.txt").write_text("")
    assert sorted(map(tuple, siblings(spark, str(tmp_path / "notes")).collect())) == [("a", "1"), ("b b", "2")]
    assert siblings(spark, str(tmp_path / "absent")).count() == 0
