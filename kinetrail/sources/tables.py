"""Sources: tracks, segments, poses and metadata as views of the driver's tables, with explicit projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RATES = [25, 30, 50]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, action, k, seq, frame, x, y, fps): eight sequences of events; x is null for every 17th id."""
    e = table(spark, sf_dir, "events")
    seq = F.col("user_id") % 8
    k = F.get_json_object("props", "$.k").cast("long")
    frame = F.row_number().over(Window.partitionBy("seq").orderBy("ts", "event_id")).cast("long") - 1
    rows = e.select("event_id", "user_id", F.col("event_type").alias("action"), "ts", k.alias("k"), seq.alias("seq"), F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("x"), k.cast("double").alias("y"))
    fps = F.element_at(F.array(*map(F.lit, RATES)), (F.col("seq") % 3 + 1).cast("int")).cast("long")
    return rows.withColumn("frame", frame).withColumn("fps", fps).drop("ts")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, agent, target, action, start, stop): half-open intervals."""
    t = tracks(spark, sf_dir)
    return t.select("event_id", F.col("seq").alias("agent"), (F.col("user_id") % 3).alias("target"), "action", F.col("frame").alias("start"), (F.col("frame") + 1 + F.col("k") % 20).alias("stop"))


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, frame, ax, ay, bx, by): two points of each entity and frame."""
    e = table(spark, sf_dir, "embeddings")
    frame = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("long") - 1
    point = [(F.col("embedding")[i].cast("double") * 10).alias(n) for i, n in enumerate(("ax", "ay", "bx", "by"))]
    return e.select(F.col("label").alias("entity"), frame.alias("frame"), *point)


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lab, video, width): metadata; width is null where it was negative."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    width = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("lab"), F.col("c_custkey").alias("video"), width.alias("width"))

#: Body parts of frames(): fixed values, names of tracked parts.
PARTS = ("nose", "ear_left", "ear_right", "neck", "body_center", "hip_left", "hip_right", "tail_base", "lateral_left", "lateral_right")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, entity, seq, frame, fps, arena_width, arena_height, arena_shape, `<part>_x`, `<part>_y`): two entities of a
    recording of 250 vectors, so recordings grow in number with the table; every 17th coordinate pair is missing."""
    e = table(spark, sf_dir, "embeddings")
    base = e.select("vec_id", "embedding", F.floor(F.col("vec_id") / 250).cast("long").alias("video"), (F.col("label") % 2).cast("long").alias("entity"))
    frame = (F.row_number().over(Window.partitionBy("video", "entity").orderBy("vec_id")) - 1).cast("long")
    fps = F.element_at(F.array(*map(F.lit, RATES)), (F.col("video") % 3 + 1).cast("int")).cast("long")
    place = lambda i, k: F.when((F.col("vec_id") + i) % 17 != 0, F.col("embedding")[2 * i + k].cast("double") * 10 + (20, 15)[k])
    coords = [place(i, k).alias(f"{p}_{'xy'[k]}") for i, p in enumerate(PARTS) for k in (0, 1)]
    shape = F.when(F.col("video") % 2 == 0, "Circular").otherwise("square").alias("arena_shape")
    return base.select("video", "entity", (F.col("video") * 2 + F.col("entity")).alias("seq"), frame.alias("frame"), fps.alias("fps"), F.lit(40.0).alias("arena_width"), F.lit(30.0).alias("arena_height"), shape, *coords)
