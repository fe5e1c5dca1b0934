"""Families over sequences cut into blocks and whole, on the part sets that recordings have, and their plans."""

import io
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from kinetrail.functions import motion, pairs
from kinetrail.functions.sequences import Frames, features

REAR = ("ear_left", "ear_right", "tail_base")
SIDES = ("lateral_left", "lateral_right")
HIPS = ("hip_left", "hip_right")
#: Parts beside ears and tail base, and how many columns one entity and a pair have.
SECTIONS = [
    (("body_center", *SIDES, "neck", "nose", "tail_tip"), 351, 410), (("body_center", *HIPS, *SIDES, "nose", "tail_tip"), 360, 441), (("body_center", *SIDES, "nose", "tail_tip"), 343, 393),
    (("body_center", *SIDES, "nose"), 336, 378), (("body_center", "nose"), 325, 354), (("head",), 237, 34), ((*HIPS, "neck", "nose"), 333, 320), (("nose", "tail_tip"), 320, 284),
]
#: Columns of ours beside those: a variant of the speed asymmetry and path efficiency.
MORE = {"spd_asym_median_1s", "path_eff_30", "path_eff_90"}


@pytest.mark.parametrize("parts, single, pair", SECTIONS)
def test_columns_of_every_part_set(parts, single, pair):
    rng = np.random.default_rng(0)
    draw = lambda side="": {f"{side}{p}_{c}": rng.normal(size=40) for p in (*REAR, *parts) for c in "xy"}
    s = Frames(draw() | {"arena_width": np.full(40, 40.0), "arena_height": np.full(40, 30.0)}, 25.0, 40, {"arena_shape": "circular"})
    two = Frames(draw("A_") | draw("B_"), 50.0, 40)
    with np.errstate(all="ignore"):
        one = set().union(*(f(s) for f in motion.FAMILIES.values()))
        assert MORE <= one and len(one - MORE) == single
        assert len(set().union(*(f(two) for f in pairs.FAMILIES.values()))) == pair


@pytest.fixture(scope="module")
def rows(spark):
    """Sequences at three rates and without one, with gaps between frames, a null frame, missing parts; a short one."""
    rng, out = np.random.default_rng(3), []
    for seq, fps, n in ((1, 25.0, 900), (2, 50.0, 1500), (3, None, 700), (None, 30.0, 400), (4, 30.0, 1)):
        at = np.sort(rng.choice(3 * n, n, replace=False)) + (200 if seq == 2 else 0)
        at[n // 2 :] += 5000 if seq == 1 else 0
        for i, f in enumerate(at):
            xy = [None if rng.random() < 0.1 or 300 < i < 500 and seq == 3 else float(v) for v in rng.normal(size=20).cumsum() + 20]
            out.append((seq, None if i == 0 and seq == 1 else int(f), fps, 40.0, 30.0, "Circular" if seq == 2 else "square", *xy))
    parts = (*REAR, *SIDES, *HIPS, "nose", "body_center", "neck")
    schema = "seq int, frame long, fps double, arena_width double, arena_height double, arena_shape string, " + ", ".join(f"{p}_{c} double" for p in parts for c in "xy")
    return spark.createDataFrame(out, schema).repartition(5).cache()


def table(df):
    return {(r["seq"], r["frame"]): r.asDict() for r in df.collect()}


@pytest.mark.parametrize("block", [100, 1000])
def test_blocks_equal_whole_sequences(rows, block):
    families = list(motion.FAMILIES.values())
    whole, cut = table(features(rows, *families, block=None)), table(features(rows, *families, block=block))
    assert len(whole) == len(cut) == rows.count() and len(next(iter(whole.values()))) > 360
    for key, want in whole.items():
        got = cut[key]
        for name, x in want.items():
            y = got[name]
            assert (x is None) == (y is None) and (x is None or abs(x - y) <= 1e-9 * max(1.0, abs(x))), (key, name, x, y)


def test_pairs_in_blocks(spark, rows):
    side = lambda s: [F.col(c).alias(f"{s}{c}") for c in rows.columns if c.endswith(("_x", "_y"))]
    two = rows.filter("seq is not null").select(F.struct("seq", F.lit(1).alias("other")).alias("seq"), F.lit(1).alias("agent"), F.lit(2).alias("target"), "frame", "fps", *side("A_"), *side("B_"))
    whole, cut = ({(r["seq"], r["frame"]): r for r in features(two, *pairs.FAMILIES.values(), block=b).collect()} for b in (None, 300))
    assert whole.keys() == cut.keys() and all(
        (x is None) == (y is None) and (x is None or isinstance(x, (tuple, int)) or abs(x - y) <= 1e-9 * max(1.0, abs(x))) for k, r in whole.items() for x, y in zip(r, cut[k])
    )


def test_one_long_sequence_runs_in_many_tasks(spark):
    """A million frames of one sequence: as many groups as blocks, equal to the sequence as a whole."""
    one = spark.range(1_000_000, numPartitions=8).select(
        F.lit(1).alias("seq"), F.col("id").alias("frame"), F.lit(30).alias("fps"), *((F.rand(k) * 40).alias(f"body_center_{c}") for k, c in enumerate("xy")), F.spark_partition_id().alias("task")
    )
    cut = features(one, motion.long_range, motion.speed_scales)
    whole = features(one, motion.long_range, motion.speed_scales, block=None)
    assert cut.withColumn("task", F.spark_partition_id()).groupBy("task").count().count() > 1
    names = [c for c in cut.columns if c not in ("seq", "frame")]
    total = lambda df: df.agg(F.count("*"), *(F.sum(c).alias(c) for c in names), *(F.sum(F.col(c) * (F.col("frame") % 97)).alias(f"{c}_") for c in names)).first()
    a, b = total(cut), total(whole)
    assert a[0] == b[0] == 1_000_000 and np.allclose(np.array(a[1:], float), np.array(b[1:], float), rtol=1e-9)


def test_odd_input(spark, rows):
    assert features(rows.limit(0), motion.kinematics).count() == 0
    only = features(rows.withColumn("label", F.lit("x")).withColumn("extra", F.lit(1)), motion.ears)
    assert only.columns == ["seq", "frame", *motion.ears(Frames({f"{p}_{c}": np.zeros(1) for p in REAR for c in "xy"}, 30.0, 1))]
    mixed = rows.filter("seq = 1").withColumn("fps", F.when(F.col("frame") % 2 == 0, 25.0).otherwise(50.0))
    assert features(mixed, motion.ears).count() == mixed.count()


def test_plans_read_once(spark, tmp_path):
    """A family reads only the columns it needs, once, and sends the frames through one exchange."""
    frames = spark.range(1000).select(F.lit(1).alias("seq"), F.col("id").alias("frame"), F.lit(25).alias("fps"), *(F.rand(1).alias(f"{p}_{c}") for p in (*REAR, "nose", "body_center") for c in "xy"))
    frames.write.parquet(f"{tmp_path}/frames")
    said = io.StringIO()
    with redirect_stdout(said):
        features(spark.read.parquet(f"{tmp_path}/frames"), motion.ears, motion.part_motion).explain("formatted")
        features(spark.read.parquet(f"{tmp_path}/frames"), motion.long_range).explain("formatted")
    both, wide = said.getvalue().split("== Physical Plan ==")[1:]
    for plan in (both, wide):
        tree = plan.split("\n\n")[0]
        assert tree.count("Scan parquet") == 1 and tree.count("Exchange") == 1 and "Window" not in tree
    assert "nose_x" in both and "body_center_x" not in both and "nose_x" not in wide


def test_registered_families_plan_small(spark):
    for name in ("single_long_range", "single_kinematics", "all_pair_sniff"):
        said = io.StringIO()
        with redirect_stdout(said):
            __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").explain("formatted")
        tree = said.getvalue().split("\n\n")[0]
        assert tree.count("Scan parquet") <= 2 and tree.count("Exchange") <= 5, (name, tree)
