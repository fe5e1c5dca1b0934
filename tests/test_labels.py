"""Literal cases of labels, decay and the CSV sink."""

import pytest
from pyspark.sql import functions as F

from kinetrail.functions.decay import ewm
from kinetrail.operators.labels import fill, key_parts, numbered, read_csv, write_csv


def test_ewm(spark):
    df = spark.createDataFrame(list(enumerate([1.0, 2.0, None, 4.0, 8.0, 4.0])), "frame int, x double").withColumn("seq", F.lit(0))
    got = [r.v for r in ewm(df, "x", 3, "v").orderBy("frame").collect()]
    assert got == pytest.approx([1, 1.666667, 1.666667, 3.363636, 6.111111, 4.966102], abs=1e-6)


def test_ewm_after_a_long_gap(spark):
    values = [5.0] + [None] * 400 + [1.0, 2.0]
    df = spark.createDataFrame(list(enumerate(values)), "frame int, x double").withColumn("seq", F.lit(0))
    got = [r.v for r in ewm(df, "x", 3, "v").orderBy("frame").collect()]
    assert got[:401] == pytest.approx([5.0] * 401) and got[401:] == pytest.approx([1.0, (2 + 0.5) / 1.5])


def test_label_keys(spark):
    df = spark.createDataFrame([("mouse1,self,dig",), ("mouse1,mouse2,chase",), ("mouse1,dig",), ("mouse1,none,dig",)], "label string")
    assert [tuple(r) for r in df.select(*key_parts(F.col("label"))).collect()] == [("1", "1", "dig"), ("1", "2", "chase"), ("1", "1", "dig"), ("1", "1", "dig")]


def test_fill(spark):
    extents = spark.createDataFrame([(1, 10, 19), (2, 0, 5)], "video long, first long, last long")
    actions = spark.createDataFrame([(v, "1", "1", a) for v in (1, 2) for a in "abc"], "video long, agent string, target string, action string")
    got = fill(extents, actions, spark.createDataFrame([(2,)], "video long"), "video").orderBy("start").collect()
    assert [(r.action, r.start, r.stop) for r in got] == [("a", 10, 14), ("b", 14, 18), ("c", 18, 20)]


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(v, s) for v in (3, 1, 2) for s in (7, 5, 5)], "video long, start long")
    assert sorted(r.row_id for r in numbered(rows, "video", ["start"]).collect()) == list(range(9))
    write_csv(rows, str(tmp_path / "out"), "video", ["start"])
    got = read_csv(spark, str(tmp_path / "out"), "row_id long, video long, start long").orderBy("row_id").collect()
    assert [(r.video, r.start) for r in got] == sorted((v, s) for v in (1, 2, 3) for s in (7, 5, 5))


def test_fill_skips_some_recordings(spark):
    from pyspark.sql import functions as F

    extents = spark.createDataFrame([(1, 0, 9, "open_a"), (2, 0, 9, "lab"), (3, 0, 9, None)], "video long, first long, last long, lab string")
    actions = spark.createDataFrame([(v, "1", "2", "chase") for v in (1, 2, 3)], "video long, agent string, target string, action string")
    got = fill(extents, actions, spark.createDataFrame([], "video long"), "video", F.col("lab").startswith("open"))
    assert sorted(r["video"] for r in got.collect()) == [2, 3]
