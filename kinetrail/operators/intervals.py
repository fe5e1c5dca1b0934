"""Intervals and segments: raster, run lengths, argmax with thresholds, greedy overlap removal."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetrail.functions.windows import changed


def merged(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, action, start, last): intervals of the same keys and action that overlap or touch, as one; last is included.
    Intervals that end before they start, or lack an end, go."""
    along = Window.partitionBy(*keys, "action").orderBy("start")
    before = F.max("last").over(along.rowsBetween(Window.unboundedPreceding, -1))
    rows = intervals.filter("start <= last").withColumn("_new", F.when(before.isNull() | (before + 1 < F.col("start")), 1).otherwise(0))
    rows = rows.withColumn("_island", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "action", "_island").agg(F.min("start").alias("start"), F.max("last").alias("last")).drop("_island")


def raster(frames: DataFrame, intervals: DataFrame, keys: list[str], closed: bool = True, width: int = 1024) -> DataFrame:
    """frames (keys, frame) that lie in an interval (keys, action, start, stop), once for each action. Overlapping intervals
    of an action are one; intervals and frames meet in buckets of `width` frames and are compared there, so an interval
    costs the buckets it touches, not its frames. Null keys, frames and ends lie in nothing."""
    last = F.col("stop") if closed else F.col("stop") - 1
    whole = merged(intervals.select(*keys, "action", "start", last.alias("last")), keys)
    at = lambda c: F.floor(F.col(c) / width)
    marked = whole.withColumn("_bucket", F.explode(F.sequence(at("start"), at("last"))))
    met = frames.withColumn("_bucket", at("frame")).join(marked, [*keys, "_bucket"])
    return met.filter((F.col("frame") >= F.col("start")) & (F.col("frame") <= F.col("last"))).select(*frames.columns, "action")


def best_state(scores: DataFrame, keys: list[str], threshold: float = 0.27) -> DataFrame:
    """(keys, frame, state): the action (ordinal) of largest prob, the lowest one of equals; -1 below the threshold."""
    top = scores.groupBy(*keys, "frame").agg(F.max(F.struct("prob", (-F.col("ordinal")).alias("o"))).alias("top"))
    return top.select(*keys, "frame", F.when(F.col("top.prob") >= threshold, -F.col("top.o")).otherwise(-1).alias("state"))


def run_lengths(states: DataFrame, seq: str = "seq", least: int = 3) -> DataFrame:
    """(seq, state, start, stop): half-open runs of one state; runs of -1, the open last run and runs shorter than least
    frames go. A run stops at the frame of the next change."""
    edges = states.withColumn("_c", changed(F.col("state"), seq)).filter("_c = 1")
    stop = F.lead("frame").over(Window.partitionBy(seq).orderBy("frame"))
    runs = edges.select(seq, "state", F.col("frame").alias("start"), stop.alias("stop"))
    return runs.filter(F.col("stop").isNotNull() & (F.col("state") != -1) & (F.col("stop") - F.col("start") >= least))


def greedy(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments of each key in order of start (then stop, action) that start no earlier than the last kept one stopped,
    at first 0. Rows stream past in order, with one number of state, so a key may have any number of segments. Rows whose
    start or stop is null go."""
    rows = segments.filter("start is not null and stop is not null").select(*keys, "action", "start", "stop")
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "start", "stop", "action")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, 0
        for batch in batches:
            kept = []
            starts, stops = batch.column("start").to_pylist(), batch.column("stop").to_pylist()
            for i, k in enumerate(zip(*(batch.column(c).to_pylist() for c in keys))):
                if k != key:
                    key, last = k, 0
                if starts[i] >= last:
                    kept.append(i)
                    last = stops[i]
            yield batch.take(pa.array(kept, pa.int64()))

    return ordered.mapInArrow(walk, rows.schema)


def best_actions(scores: DataFrame, keys: list[str], thresholds: DataFrame | None = None, default: float = 0.27) -> DataFrame:
    """(keys, frame, action): the action of largest prob, the one of lowest ordinal of equals; null where prob is below
    the action's threshold (thresholds: action, threshold; `default` for others)."""
    top = scores.groupBy(*keys, "frame").agg(F.max(F.struct("prob", (-F.col("ordinal")).alias("o"), "action")).alias("top"))
    rows = top.select(*keys, "frame", "top.prob", "top.action")
    if thresholds is not None:
        rows = rows.join(thresholds.select("action", "threshold"), "action", "left")
        bound = F.coalesce("threshold", F.lit(default))
    else:
        bound = F.lit(default)
    return rows.select(*keys, "frame", F.when(F.col("prob") >= bound, F.col("action")).alias("action"))


def repair(intervals: DataFrame, rate: float = 25.0, where: Column | None = None) -> DataFrame:
    """Intervals drawn at 30 frames a second on a timeline of `rate`: scaled with halves to even, clipped to 0..limit, and
    turned where start passes stop. Columns start, stop, limit. where: the rows that need scaling (null: no), all if not
    given; the others are clipped and turned only."""
    scaled = lambda c: F.bround(F.col(c) * rate / 30.0) if where is None else F.when(where, F.bround(F.col(c) * rate / 30.0)).otherwise(F.col(c))
    moved = lambda c: F.least(F.greatest(scaled(c).cast("long"), F.lit(0).cast("long")), F.col("limit"))
    a, b = moved("start"), moved("stop")
    return intervals.withColumns({"start": F.least(a, b), "stop": F.greatest(a, b)})
