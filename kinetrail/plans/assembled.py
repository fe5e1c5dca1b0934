"""Registered queries of assembled sequences: metadata, long tracking rows and annotations made of the table of vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrail.operators.assembly import Parameters, assemble
from kinetrail.plans.catalog import register
from kinetrail.plans.families import FRAMES_SQL
from kinetrail.sources.tables import PARTS, frames, table

USED = PARTS[:3]
#: Every fifth recording lists nothing, every fourth is not annotated.
_LISTED = ("mouse1,self,Rear", "'mouse2,self,groom'", "mouse2,self,rear", "mouse1,mouse2,chase", "mouse2,mouse1,Mount", "mouse9,self,dig", "mouse1,mouse7,chase")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a recording."""
    v = frames(spark, sf_dir).select("video").distinct()
    lab = F.concat(F.lit("lab"), (F.col("video") % 3).cast("string")).alias("lab_id")
    told = F.when(F.col("video") % 5 != 4, F.to_json(F.array(*map(F.lit, _LISTED)))).alias("behaviors_labeled")
    return v.select(lab, F.col("video").alias("video_id"), told, F.lit(30.0).alias("frames_per_second"), F.lit(40.0).alias("arena_width_cm"), F.lit(30.0).alias("arena_height_cm"), F.lit("square").alias("arena_shape"), F.lit(2.0).alias("pix_per_cm_approx"))


def tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a part and frame, in pixels."""
    f = frames(spark, sf_dir)
    one = lambda p: f.select("video", "entity", "frame", F.lit(p).alias("bodypart"), (F.col(f"{p}_x") * 2).alias("x"), (F.col(f"{p}_y") * 2).alias("y"))
    rows = reduce(DataFrame.union, map(one, USED))
    return rows.select(F.concat(F.lit("lab"), (F.col("video") % 3).cast("string")).alias("lab_id"), F.col("video").alias("video_id"), (F.col("entity") + 1).alias("mouse_id"), F.col("frame").alias("video_frame"), "bodypart", "x", "y")


def annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interval for every seventh vector: of the entity itself or towards the other."""
    v = table(spark, sf_dir, "embeddings").filter("vec_id % 7 = 0").select("vec_id", F.floor(F.col("vec_id") / 250).cast("long").alias("video"), (F.col("label") % 2).cast("long").alias("entity")).filter("video % 4 <> 3")
    actions = F.array(*(F.lit(a) for a in ("rear", "groom", "chase", "Mount")))
    own, start = F.col("vec_id") % 2 == 0, F.col("vec_id") % 250
    target = F.when(own, F.col("entity") + 1).otherwise(2 - F.col("entity"))
    return v.select(F.concat(F.lit("lab"), (F.col("video") % 3).cast("string")).alias("lab_id"), F.col("video").alias("video_id"), (F.col("entity") + 1).alias("agent_id"), target.alias("target_id"),
        F.element_at(actions, (F.when(own, 0).otherwise(2) + F.col("vec_id") % 3 % 2 + 1).cast("int")).alias("action"), (F.floor(start / 2)).alias("start_frame"), (F.floor(start / 2) + F.col("vec_id") % 9).alias("stop_frame"))


_NOTED = f"""WITH {FRAMES_SQL}, an AS (SELECT vec_id // 250 AS video, CAST(label % 2 AS BIGINT) AS entity, vec_id % 2 = 0 AS own, vec_id % 250 // 2 AS start, vec_id % 250 // 2 + vec_id % 9 AS stop,
    CASE WHEN vec_id % 2 = 0 THEN CASE vec_id % 3 % 2 WHEN 0 THEN 'rear' ELSE 'groom' END ELSE CASE vec_id % 3 % 2 WHEN 0 THEN 'chase' ELSE 'mount' END END AS action FROM embeddings WHERE vec_id % 7 = 0 AND vec_id // 250 % 4 <> 3),
  ok AS (SELECT DISTINCT video FROM an WHERE video % 5 <> 4)"""
_SINGLE = """SELECT video, 'mouse' || (entity + 1) AS agent, frame, nose_x, action, EXISTS (SELECT 1 FROM an WHERE own AND an.video = q.video AND an.entity = q.entity AND an.action = q.action AND q.frame BETWEEN an.start AND an.stop) AS y
  FROM (SELECT fr.*, l.action FROM fr JOIN ok USING (video) JOIN (VALUES (0, 'rear'), (1, 'groom'), (1, 'rear')) l(e, action) ON l.e = fr.entity) q"""
_PAIR = """SELECT video, 'mouse' || (entity + 1) AS agent, frame, A_nose_x, B_nose_x, action, EXISTS (SELECT 1 FROM an WHERE NOT own AND an.video = q.video AND an.entity = q.entity AND an.action = q.action AND q.frame BETWEEN an.start AND an.stop) AS y
  FROM (SELECT a.video, a.entity, a.frame, a.nose_x AS A_nose_x, b.nose_x AS B_nose_x, l.action FROM fr a JOIN fr b ON a.video = b.video AND a.frame = b.frame AND a.entity <> b.entity JOIN ok ON a.video = ok.video JOIN (VALUES (0, 'chase'), (1, 'mount')) l(e, action) ON l.e = a.entity) q"""


def _assembled(spark: SparkSession, sf_dir: str):
    return assemble(metadata(spark, sf_dir), tracking(spark, sf_dir), Parameters(parts=USED), annotation(spark, sf_dir))


def _told(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(F.col("video.video_id").cast("long").alias("video"), "agent", "frame", *columns, F.explode("y").alias("action", "y"))


@register("assembled_single", f"{_NOTED} {_SINGLE}")
def assembled_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(_assembled(spark, sf_dir).single, "nose_x")


@register("assembled_pair", f"{_NOTED} {_PAIR}")
def assembled_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(_assembled(spark, sf_dir).pair, "A_nose_x", "B_nose_x")
