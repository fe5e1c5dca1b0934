"""Exponentially weighted means as a scan over blocks of rows."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Weights under exp(-NEGLIGIBLE) of the newest one are lost in double precision.
NEGLIGIBLE = 41.5


def ewm(df: DataFrame, value: str | list[str], span: float, to: str | list[str], seq: str = "seq", frame: str = "frame") -> DataFrame:
    """df with `to`: the mean of the values so far, each weighted (1 - 2 / (span + 1)) to the power of its age in rows; a
    null keeps the mean before it. Running sums within a block, and as many earlier blocks' totals as can matter, give
    each row its mean, so no window is wider than a block. Several columns share one pass; rows whose seq is null are one
    sequence."""
    values, names = ([value], [to]) if isinstance(value, str) else (value, to)
    d = 1 - 2 / (span + 1)
    size = max(1, min(1024, int(30 / -math.log(d)))) if d > 0 else 1
    reach = math.ceil(NEGLIGIBLE / -math.log(d) / size) + 1 if d > 0 else 0
    rows = df.withColumn("_n", F.row_number().over(Window.partitionBy(seq).orderBy(frame)) - 1)
    rows = rows.withColumn("_b", F.floor(F.col("_n") / size)).withColumn("_i", F.col("_n") % size)
    up = F.pow(F.lit(1 / d), F.col("_i")) if d > 0 else F.lit(1.0)
    parts = {}
    for i, v in enumerate(values):
        parts |= {f"_num{i}": F.coalesce(F.col(v) * up, F.lit(0.0)), f"_den{i}": F.coalesce(F.when(F.col(v).isNotNull(), 1.0) * up, F.lit(0.0))}

    blocks = rows.groupBy(seq, "_b").agg(*(F.sum(v).alias(k) for k, v in parts.items()))
    earlier = Window.partitionBy(seq).orderBy("_b")
    carry = lambda c: reduce(lambda a, b: a + b, (F.coalesce(F.lag(c, j).over(earlier), F.lit(0.0)) * d ** (j * size) for j in range(1, reach + 1)), F.lit(0.0))
    carried = blocks.select(F.col(seq).alias("_seq"), F.col("_b").alias("_block"), *(carry(k).alias(f"_c{k}") for k in parts))

    within = Window.partitionBy(seq, "_b").orderBy("_n")
    rows = rows.withColumns({k: F.sum(v).over(within) for k, v in parts.items()})
    rows = rows.join(carried, F.col(seq).eqNullSafe(F.col("_seq")) & (F.col("_b") == F.col("_block")))
    whole = Window.partitionBy(seq).orderBy("_n")
    means = {}
    for i, (v, name) in enumerate(zip(values, names)):
        mean = F.when(F.col(v).isNotNull(), (F.col(f"_num{i}") + F.col(f"_c_num{i}")) / (F.col(f"_den{i}") + F.col(f"_c_den{i}")))
        means[name] = F.last(mean, ignorenulls=True).over(whole)
    return rows.withColumns(means).drop("_n", "_b", "_i", "_seq", "_block", *parts, *(f"_c{k}" for k in parts))
