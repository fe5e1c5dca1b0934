"""Literal cases of ingest, rates, resampling, labels, segments and models."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.functions.windows import by_rate
from kinetrail.operators import intervals, labels, models, sampling, scoring
from kinetrail.operators.pairing import directed, rolling_correlations
from kinetrail.plans.catalog import ORACLES, QUERIES
from kinetrail.sources import recordings as R

TRACK = "video_frame int, mouse_id int, bodypart string, x double, y double"


def test_scan_reads_listed_recordings_only(spark, tmp_path):
    for lab, video in (("a", 1), ("a", 2), ("b b", 3)):
        spark.createDataFrame([(0, 1, "nose", float(video), 2.0)], TRACK).coalesce(1).write.parquet(str(tmp_path / "tmp" / lab / str(video)))
        part = next((tmp_path / "tmp" / lab / str(video)).glob("*.parquet"))
        (tmp_path / "in" / lab).mkdir(parents=True, exist_ok=True)
        part.rename(tmp_path / "in" / lab / f"{video}.parquet")
    meta = spark.createDataFrame([("a", 1), ("b b", 3), ("a", 9)], "lab_id string, video_id long")
    got = R.scan(spark, str(tmp_path / "in"), meta, TRACK).collect()
    assert sorted((r.lab_id, r.video_id, r.x) for r in got) == [("a", "1", 1.0), ("b b", "3", 3.0)]
    assert R.root_of("valid", "t", "s") == "t" and R.root_of("test", "t", "s") == "s"
    with pytest.raises(ValueError):
        R.root_of("other", "t", "s")
    with pytest.raises(ValueError, match="z"):
        R.require(meta, ["lab_id", "z"])


def test_pivot(spark):
    rows = [(1, 1, 0, "nose", 10.0, 20.0), (1, 1, 0, "tail", float("nan"), 5.0), (1, 1, 1, "nose", None, 1.0), (1, 1, 1, "odd", 1.0, 1.0)]
    schema = "video_id int, mouse_id int, video_frame int, bodypart string, x double, y double"
    got = R.wide(spark.createDataFrame(rows, schema).withColumn("cm", F.lit(10.0)), ["nose", "tail"], ("video_id", "mouse_id", "video_frame", "cm"), "cm").orderBy("video_frame").drop("cm").collect()
    assert [tuple(r) for r in got] == [(1, 1, 0, 1.0, 2.0, None, 0.5), (1, 1, 1, None, 0.1, None, None)]
    with pytest.raises(Exception, match="two rows of nose"):
        R.wide(spark.createDataFrame([*rows, rows[0]], schema), ["nose", "tail"]).collect()
    many = [(v, p) for v, n in ((1, 6), (2, 5)) for p in "abcdef"[:n]]
    left = R.drop_parts(spark.createDataFrame(many, "video_id int, bodypart string"), ["a"]).collect()
    assert (1, "a") not in left and (2, "a") in left and len(left) == 10


def test_labels_are_three_valued(spark):
    f = spark.createDataFrame([(1, k) for k in range(3)] + [(2, 0)], "agent int, frame long")
    lab = spark.createDataFrame([(1, "rear")], "agent int, action string")
    marked = intervals.raster(f, spark.createDataFrame([(1, "rear", 1, 1), (1, "dig", 0, 2)], "agent int, action string, start long, stop long"), ["agent"])
    assert sorted(tuple(r) for r in R.labelled_frames(f, lab, marked, ["agent"]).select("agent", "frame", "action", "y").collect()) == [(1, 0, "rear", False), (1, 1, "rear", True), (1, 2, "rear", False)]


def test_rates(spark):
    df = spark.createDataFrame([(1, 33.3), (2, None), (3, 25.0)], "id int, fps double")
    make = lambda d, fps: d.select("id", F.lit(fps).alias("rate"))
    assert sorted(tuple(r) for r in by_rate(df, None, make).collect()) == [(1, 33.3), (2, 30.0), (3, 25.0)]
    assert sorted(tuple(r) for r in by_rate(df.filter("id > 1"), [25, 30], make).collect()) == [(2, 30.0), (3, 25.0)]
    with pytest.raises(Exception, match="not named"):
        by_rate(df, [25, 30], make).collect()


def test_resampling_of_one_class_and_null_groups(spark):
    rows = [("a", i, False) for i in range(50)] + [("b", 100 + i, True) for i in range(4)] + [(None, 200 + i, i == 0) for i in range(9)]
    df = spark.createDataFrame(rows, "g string, id long, y boolean")
    n = lambda d: {r["g"]: r["count"] for r in d.groupBy("g").count().collect()}
    assert n(sampling.downsample(df, "g", "id", 0.5)) == {"a": 50, "b": 4, None: 2}
    assert n(sampling.upsample(df, "g", "id", 0.5)) == {"a": 50, "b": 4, None: 16}
    held = sampling.hold_out(df, "id", 0.2).collect()
    assert len(held) == 63 and sum(r.held_out for r in held) == 12 and not any(r.held_out for r in sampling.hold_out(df, "id", 0).collect())
    assert sum(r.held_out for r in sampling.hold_out(df.limit(3), "id", 0.1).collect()) == 1 and sampling.hold_out(df.limit(0), "id").count() == 0


def test_upsampling_takes_its_share_as_a_decimal(spark):
    """As SQL does: ceil(0.3 * n / (1 - 0.3)); a double 0.3 is one off at these counts."""
    rows = [(n, i, i >= n) for n in (77, 119, 154, 189, 238) for i in range(n + 1)]
    df = spark.createDataFrame(rows, "g int, id long, y boolean")
    got = {r["g"]: r["count"] for r in sampling.upsample(df, "g", "id", 0.3).filter("y").groupBy("g").count().collect()}
    con = duckdb.connect()
    assert got == {n: int(con.sql(f"SELECT CEIL(0.3 * {n} / (1 - 0.3))").fetchall()[0][0]) for n in got} and len(got) == 5


@pytest.mark.parametrize("block", [7, 8, 1000])
def test_correlations_across_blocks(spark, block):
    """Sequences of different lengths, one constant, one with gaps in its values; windows reach over the edges of blocks."""
    rng, rows = np.random.default_rng(3), []
    for seq, n in enumerate((40, 33, 25, 40)):
        rows += [(seq, i, None if seq == 1 and i % 3 == 0 else 0.1 if seq == 2 else float(rng.normal())) for i in range(n)]
    s = {(q, i): np.nan if v is None else v for q, i, v in rows}
    df = spark.createDataFrame(rows, "seq long, frame long, s double").repartition(5)
    got = {(r.agent, r.target, r.frame): r.r for r in rolling_correlations(df, 7, 3, block).collect()}
    assert set(got) == {(a, b, i) for a, i in s for b in range(4) if b != a and (b, i) in s}
    for (a, b, i), r in got.items():
        x, y = (np.array([s[q, j] for j in range(max(0, i - 6), i + 1)]) for q in (a, b))
        ok = ~np.isnan(x) & ~np.isnan(y)
        want = np.corrcoef(x[ok], y[ok])[0, 1] if ok.sum() >= 3 and 2 not in (a, b) else None
        assert (r is None and want is None) or r == pytest.approx(want, abs=1e-9)


def test_pairs_share_one_exchange(spark):
    """No join of frames with frames and no window over pairs."""
    plan = QUERIES["pair_speed_correlation"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_odd_labels_and_ids(spark):
    df = spark.createDataFrame([(1, '["mouse1,self,Dig", "\'mouse2\',rear"]'), (2, None), (3, "no list")], "id int, j string")
    assert sorted((r.id, r.agent, r.target, r.action) for r in labels.listed(df, "j", "id").collect()) == [(1, "mouse1", "self", "dig"), (1, "mouse2", "rear", None)]
    wanted = spark.createDataFrame([(1, "m" + "9" * 21), (1, "mouse2")], "k int, raw string")
    known = spark.createDataFrame([(1, "1")], "k int, id string")
    assert sorted((r.raw, r.id) for r in labels.resolve(wanted, known, "k").collect()) == [("m" + "9" * 21, None), ("mouse2", "1")]
    rows = spark.createDataFrame([(None, 5), (2, 1), (None, 4)], "v long, s long")
    assert sorted((r.row_id, r.v, r.s) for r in labels.numbered(rows, "v", ["s"]).collect()) == [(0, None, 4), (1, None, 5), (2, 2, 1)]


def test_segments(spark):
    s = spark.createDataFrame([("k", "a", 0, 10), ("k", "b", 5, 8), ("k", "c", 10, 12), (None, "a", 1, 3), (None, "b", 2, 9), ("k", "d", None, 3)], "g string, action string, start long, stop long")
    assert sorted((str(r.g), r.action) for r in intervals.greedy(s, ["g"]).collect()) == [("None", "a"), ("k", "a"), ("k", "c")]
    one = spark.createDataFrame([("x", 30, 60, 100), ("y", 30, 60, 40)], "lab string, start long, stop long, limit long")
    assert sorted((r.lab, r.start, r.stop) for r in intervals.repair(one, where=F.col("lab") == "x").collect()) == [("x", 25, 50), ("y", 30, 40)]


def test_only_allowed_pairs(spark):
    f = spark.createDataFrame([(1, e, k, 30, float(e), 0.0) for e in (1, 2, 3) for k in range(2)], "video int, entity int, frame long, fps int, nose_x double, nose_y double")
    assert directed(f).count() == 12
    got = directed(f, spark.createDataFrame([(1, 3, 1), (2, 1, 2)], "video int, agent int, target int")).collect()
    assert sorted((r.agent, r.target, r.frame, r.A_nose_x) for r in got) == [(3, 1, 0, 3.0), (3, 1, 1, 3.0)]


def test_features_are_written_once_a_version(spark, tmp_path):
    a, b = spark.range(3), spark.range(5)
    assert R.write_features(a, str(tmp_path), "v1").count() == 3 and R.write_features(b, str(tmp_path), "v1").count() == 3 and R.write_features(b, str(tmp_path), "v2").count() == 5


def test_models(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 20).cast("double").alias("f 1"), (F.col("id") % 20 > 16).alias("y"), F.lit(None).cast("double").alias("g"))
    m = models.train(rows, ["f 1", "g"], trees=3, depth=2)
    models.save(m, str(tmp_path), 1, "single", "dig", ["f 1", "g"])
    models.save(m, str(tmp_path), 1, "pair", "dig", ["f 1", "g"])
    assert {(r.section, r.branch, r.action, tuple(r.features)) for r in models.manifest(spark, str(tmp_path)).collect()} == {(1, b, "dig", ("f 1", "g")) for b in ("single", "pair")}
    again = models.load(str(tmp_path), 1, "single", "dig")
    scored = models.score(rows, ["f 1", "g"], [m, again])
    assert scored.columns == ["f 1", "y", "g", "prob"] and models.area_under_pr(scored) > 0.99
    assert models.train(rows.filter("y"), ["f 1"]) is None and models.metric_for(0.0) == "logLoss" and models.metric_for(0.02) == "areaUnderPR"


def test_boosted_trees_query(spark):
    df = QUERIES["boosted_trees"](spark, "/root/testdata/sf0.001")
    assert "boosted_trees" not in ORACLES and df.filter("prob >= 0 and prob <= 1").count() == df.count() > 0


def test_sweep_counts_against_frames(spark):
    """Segments that overlap, touch, nest, repeat and are empty: the same counts as sets of frames."""
    rng = np.random.default_rng(6)
    draw = lambda n: [(int(rng.integers(0, 2)), int(rng.integers(0, 2)), 0, "ab"[rng.integers(0, 2)], a := int(rng.integers(0, 60)), a + int(rng.integers(-1, 15)), i) for i in range(n)]
    schema = "lab int, agent int, target int, action string, start long, stop long, row long"
    truth, found = draw(40), [*draw(40), (5, 0, 0, "a", 3, 9, 99), (0, 0, 0, "a", None, 4, 100)]
    sets = lambda rows: {(lab, a, t, x, f) for lab, a, t, x, s, e, _ in rows if s is not None for f in range(s, e)}
    want = {}
    one, two = sets(truth), sets(found)
    for lab, _, _, x, *_ in one | two:
        want[lab, x] = tuple(sum((k[0], k[3]) == (lab, x) for k in part) for part in (one & two, two - one, one - two))
    a, b = (spark.createDataFrame(rows, schema).repartition(3) for rows in (truth, found))
    assert {(r["lab"], r["action"]): (r["tp"], r["fp"], r["fn"]) for r in scoring.counts(a, b).collect()} == want
    assert {r["lab"] for r in scoring.within(b, a, "lab").collect()} == {0, 1} and scoring.counts(a.limit(0), b.limit(0)).count() == 0
    # a frame belongs to the first row that covers it
    first = {}
    for lab, ag, t, x, s, e, row in sorted(truth, key=lambda r: r[-1]):
        for f in range(s, e):
            first.setdefault((lab, ag, t, f), x)
    pieces = scoring.first_wins(a).collect()
    assert {(r["lab"], r["agent"], r["target"], f): r["action"] for r in pieces for f in range(r["start"], r["stop"])} == first
    assert sum(r["stop"] - r["start"] for r in pieces) == len(first)


def test_long_intervals_cost_buckets(spark):
    """An interval of a hundred million frames, and overlapping ones of an action, without a row for each frame."""
    frames = spark.createDataFrame([(1, f) for f in (0, 5, 10**8, 10**8 + 1, 7_777_777)] + [(2, 5), (None, 5)], "seq int, frame long")
    wide = spark.createDataFrame([(1, "a", 0, 10**8), (1, "a", 5, 6), (1, "b", 6, 4), (1, "b", 4, 5), (1, "b", 5, 5), (2, "a", None, 9)], "seq int, action string, start long, stop long")
    got = sorted(map(tuple, intervals.raster(frames, wide, ["seq"], width=1 << 20).collect()))
    assert got == [(1, 0, "a"), (1, 5, "a"), (1, 5, "b"), (1, 7_777_777, "a"), (1, 10**8, "a")]
    assert sorted(r["frame"] for r in intervals.raster(frames, wide, ["seq"], closed=False, width=1 << 20).filter("action = 'a'").collect()) == [0, 5, 7_777_777]


def test_cuts_by_hash_prefix(spark):
    """The same rows as a plain order of all hashes, at several prefix lengths; null groups and keys, repeated keys."""
    rows = [(g, None if i % 90 == 7 else i - i % 3, i % 5 == 0) for g in ("a", "b", None) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, id long, y boolean").repartition(3)
    order = lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i) if i is not None else ("", 0)
    for digits in (1, 2, 3):
        got = sampling.ranked(df, "g", "id", F.lit(100), digits).collect()
        for g in ("a", "b", None):
            want = sorted((order(i) for h, i, _ in rows if h == g))[:100]
            assert [order(r["id"]) for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["_rank"])] == want
