"""Deterministic resampling and splitting by hash order, class weights."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_weights(labels: DataFrame, by: str) -> DataFrame:
    """(by, pos, neg, weight): counts of y and neg / pos, each at least 1."""
    pos, neg = F.sum(F.when(F.col("y"), 1).otherwise(0)), F.sum(F.when(~F.col("y"), 1).otherwise(0))
    counted = labels.groupBy(by).agg(pos.cast("long").alias("pos"), neg.cast("long").alias("neg"))
    return counted.withColumn("weight", F.greatest("neg", F.lit(1)) / F.greatest("pos", F.lit(1)))


def ranked(rows: DataFrame, by: str, key: str, most: Column, digits: int = 3) -> DataFrame:
    """rows with `_rank`, their place in the order of the md5 of key among those of one `by`, as far as `most` (a column)
    reaches; the others go. Rows are counted by the first digits of their md5, and each prefix is ranked by itself with
    the count of those before it, so no task orders a whole group; prefixes beyond the cut are not ordered at all. Rows that
    share a key share a prefix. Rows whose `by` is null are one group."""
    hashed = rows.withColumn("_md5", F.coalesce(F.md5(F.col(key).cast("string")), F.lit(""))).withColumn("_prefix", F.substring("_md5", 1, digits))
    counts = hashed.groupBy(F.col(by).alias("_of"), F.col("_prefix").alias("_p")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_of").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 16 ** digits rows a group at most
    placed = hashed.join(counts.select("_of", "_p", before.alias("_before")), F.col(by).eqNullSafe(F.col("_of")) & (F.col("_prefix") == F.col("_p"))).filter(F.col("_before") < most)
    rank = F.row_number().over(Window.partitionBy(by, "_prefix").orderBy("_md5", key)) + F.col("_before")
    return placed.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_md5", "_prefix", "_of", "_p", "_before")


def downsample(labels: DataFrame, by: str, key: str, ratio: float) -> DataFrame:
    """labels (by, key, y) with as many rows of y = false as bring the share of y = true to ratio (all, where it is
    there already, and where a group has only one class), those with the smallest md5 of key. Rows whose `by` is null are
    one group; rows without a y go."""
    counted = class_weights(labels, by).select(F.col(by).alias("_by"), "pos", "neg")
    want = F.floor(F.col("pos") * (1 - ratio) / ratio)
    whole = (F.col("pos") == 0) | (F.col("neg") == 0) | (F.col("pos") / (F.col("pos") + F.col("neg")) >= ratio)
    keep = F.when(whole, F.col("neg")).otherwise(F.least(F.greatest(want, F.lit(1)), F.col("neg")))
    negatives = labels.filter(~F.col("y")).join(counted.select("_by", keep.alias("_most")), F.col(by).eqNullSafe(F.col("_by")))
    return labels.filter("y").union(ranked(negatives, by, key, F.col("_most")).select(*labels.columns))


def hold_out(rows: DataFrame, group: str, share: float = 0.1, digits: int = 2) -> DataFrame:
    """(group, held_out): max(1, int(groups * share)) groups with the smallest md5 are held out. Groups are counted by the
    first digits of their md5, and only those of the prefix in which the cut falls are ranked."""
    groups = rows.select(group).distinct().withColumn("_m", F.md5(F.col(group).cast("string")))
    if share <= 0:
        return groups.select(group, F.lit(False).alias("held_out"))
    prefix = F.substring(F.coalesce("_m", F.lit("")), 1, digits)
    counts = groups.groupBy(prefix.alias("_p")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 16 ** digits rows at most
    total = F.sum("_n").over(Window.partitionBy())
    bases = counts.select("_p", before.alias("_before"), F.greatest(F.lit(1), F.floor(total * share)).alias("_cut"))
    placed = groups.withColumn("_p", prefix).join(F.broadcast(bases), "_p")
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("_m", group))
    return placed.select(group, (F.col("_before") + rank <= F.col("_cut")).alias("held_out"))


def split_rows(rows: DataFrame, key: str, share: float = 0.1, seed: int = 0) -> DataFrame:
    """rows with held_out: each with probability `share`, fixed by the md5 of key and seed; no shuffle."""
    part = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / 2.0**32
    return rows.withColumn("held_out", part < share)


def cap_rows(rows: DataFrame, key: str, most: int, seed: int = 0) -> DataFrame:
    """At most `most` rows, those with the smallest md5 of key and seed."""
    return rows.withColumn("_m", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))).orderBy("_m", key).limit(most).drop("_m")


def upsample(labels: DataFrame, by: str, key: str, ratio: float) -> DataFrame:
    """labels (by, key, y) with rows of y = true repeated until their share is ratio (as they are, where it is there
    already): each equally often, those with the smallest md5 of key once more. Rows without a y stay as they are. ratio
    is taken as the decimal number it is written as: a share of 0.3 of 77 rows is 23.1, not a double short of it."""
    counted = class_weights(labels, by).select(F.col(by).alias("_by"), "pos", "neg")
    share_of = Decimal(str(ratio))
    want = F.ceil((F.lit(share_of) * F.col("neg")).cast("double") / F.lit(float(1 - share_of)))
    pos = F.nullif(F.col("pos"), F.lit(0))
    grows = want > F.col("pos")
    share = counted.select("_by", F.when(grows, F.floor(want / pos)).otherwise(1).alias("_each"), F.when(grows, want % pos).otherwise(0).alias("_more"))
    positives = labels.filter("y").join(share, F.col(by).eqNullSafe(F.col("_by")))
    every = positives.withColumn("_c", F.explode(F.array_repeat(F.lit(1), F.col("_each").cast("int"))))
    return labels.filter(~F.coalesce("y", F.lit(False))).union(every.select(*labels.columns)).union(ranked(positives, by, key, F.col("_more")).select(*labels.columns))
