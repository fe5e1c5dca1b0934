"""Frame-level F-beta of predicted segments, macro-averaged over actions and labs."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["agent", "target", "action"]


def within(found: DataFrame, truth: DataFrame, *by: str) -> DataFrame:
    """Rows of found whose `by` (a recording, a lab) truth has, nulls like other values."""
    listed = truth.select(*(F.col(c).alias(f"_{c}") for c in by)).distinct()
    return found.join(listed, reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by)), "left_semi")


def first_wins(segments: DataFrame) -> DataFrame:
    """(lab, keys, start, stop): disjoint pieces of half-open segments, a frame of (agent, target) belonging to the first row
    (smallest `row`) that covers it. Segments stream past in order of their start, and a heap holds those that reach
    the place of the sweep, so state grows with what overlaps and nothing with the length of a segment."""
    rows = segments.filter("start < stop").select("lab", *KEYS, F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.col("row").cast("long").alias("row"))
    of = ["lab", "agent", "target"]
    ordered = rows.repartition(*of).sortWithinPartitions(*of, "start", "row")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, heap, out = None, 0, [], []

        def sweep(upto: int | None) -> None:
            nonlocal at
            while heap and (upto is None or at < upto):
                _, stop, action = heap[0]
                if stop <= at:
                    heapq.heappop(heap)
                    continue
                end = stop if upto is None else min(stop, upto)
                out.append((*key, action, at, end))
                at = end

        def told(schema: pa.Schema) -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * 6
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[i], schema.field(n).type) for i, n in enumerate([*of, "action", "start", "stop"])], names=[*of, "action", "start", "stop"])

        schema = None
        for batch in batches:
            schema = batch.schema
            columns = [batch.column(c).to_pylist() for c in (*of, "action", "start", "stop", "row")]
            for lab, agent, target, action, start, stop, row in zip(*columns):
                if (lab, agent, target) != key:
                    sweep(None)
                    key, at = (lab, agent, target), start
                sweep(start)
                at = max(at, start)
                heapq.heappush(heap, (row if row is not None else -(2**63), stop, action))
            yield told(schema)
        if schema is not None:
            sweep(None)
            yield told(schema)

    return ordered.mapInArrow(walk, rows.select(*of, "action", "start", "stop").schema)


def counts(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(lab, action, tp, fp, fn) of two sets of half-open segments (lab, keys, start, stop), in frames; a frame counts once
    for a key however many segments cover it. Segments become two edges each, and a sweep over the edges of a key adds up
    the stretches that both, one or the other cover: what is shuffled grows with the segments, not with their frames.
    Segments that are empty, or have no start or stop, cover nothing."""

    def edges(segments: DataFrame, side: str) -> DataFrame:
        end = lambda c, by: F.struct(F.col(c).cast("long").alias("at"), F.lit(by).alias("by"))
        both = segments.filter("start < stop").select("lab", *KEYS, F.explode(F.array(end("start", 1), end("stop", -1))).alias("e"))
        return both.select("lab", *KEYS, "e.at", *(F.when(F.lit(s == side), F.col("e.by")).otherwise(0).alias(s) for s in ("t", "p")))

    key = ["lab", *KEYS]
    steps = edges(truth, "t").union(edges(found, "p")).groupBy(*key, "at").agg(F.sum("t").alias("t"), F.sum("p").alias("p"))
    along = Window.partitionBy(*key).orderBy("at")
    inside = lambda c: F.sum(c).over(along) > 0
    pieces = steps.select("lab", "action", inside("t").alias("t"), inside("p").alias("p"), (F.lead("at").over(along) - F.col("at")).alias("n")).filter("n is not null")
    one = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    t, p = F.col("t"), F.col("p")
    return pieces.groupBy("lab", "action").agg(one(t & p).alias("tp"), one(~t & p).alias("fp"), one(t & ~p).alias("fn"))


def f_beta(counted: DataFrame, beta: float = 1.0) -> DataFrame:
    """counted with f: (1 + b2) tp / ((1 + b2) tp + b2 fn + fp), 0 for a zero denominator."""
    b2 = beta * beta
    top = (1 + b2) * F.col("tp")
    return counted.withColumn("f", F.coalesce(F.try_divide(top, top + b2 * F.col("fn") + F.col("fp")), F.lit(0.0)))


def macro(scored: DataFrame) -> DataFrame:
    """One row: the mean over labs of the mean over actions; 0 without labs. Labs that only predictions name are to be left
    out before counting: see within()."""
    labs = scored.groupBy("lab").agg(F.avg("f").alias("f"))
    return labs.agg(F.coalesce(F.avg("f"), F.lit(0.0)).alias("score"), F.count("*").cast("long").alias("labs"))


def dense(segments: DataFrame) -> DataFrame:
    """segments with `row`, their order within a lab, agent and target by start, stop and action."""
    return segments.withColumn("row", F.row_number().over(Window.partitionBy("lab", "agent", "target").orderBy("start", "stop", "action")))


def report(counted: DataFrame) -> DataFrame:
    """f_beta() with prec, recall (0 for a zero denominator) and support, the number of true frames."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0))
    return f_beta(counted).withColumns({"prec": share("tp", "fp"), "recall": share("tp", "fn"), "support": F.col("tp") + F.col("fn")})


def categories(truth: DataFrame, listed_single: list[str]) -> DataFrame:
    """(action, switch): `single` where the action's first row (smallest `row`) is on its agent itself or it is listed, else
    `pair`."""
    first = truth.groupBy("action").agg(F.min_by(F.col("agent") == F.col("target"), "row").alias("own"))
    return first.select("action", F.when(F.coalesce("own", F.lit(False)) | F.col("action").isin(listed_single), "single").otherwise("pair").alias("switch"))


def granular(counted: DataFrame, kinds: DataFrame) -> DataFrame:
    """report() of each action (summed over labs) with switch (`unknown` where kinds has none), in order of switch and f,
    descending."""
    whole = counted.groupBy("action").agg(*(F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")))
    return report(whole).join(kinds, "action", "left").withColumn("switch", F.coalesce("switch", F.lit("unknown"))).orderBy(F.desc("switch"), F.desc("f"), "action")
