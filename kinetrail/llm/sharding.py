"""Minimax contiguous partition of documents into shards of near-equal bytes.

Atomic groups are equal texts. Groups stand in the order of their SHA-256 digest (a fixed shuffle), so a shard is a
range of digests and a row finds its shard from its own text. A group above the mean of what is left gets a shard of
its own, the largest first: no partition could do better. Over the other groups in order, the smallest feasible
capacity is found by binary search with a greedy check, and the cuts are the greedy ones at that capacity.

The driver never sees the groups. It sees sums over blocks of neighbouring groups (at most BLOCKS at once): a block that
a cut may fall into gives bounds of the greedy walk, below as if the walk stopped before the block, above as if it could
stop anywhere in it. Where the bounds don't decide, only the blocks in doubt are split by more digest digits.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetrail.llm.common import parallelism, stored

#: Most blocks whose sums the driver holds at once.
BLOCKS = 65_536


def greedy(sums: list[int], whole: list[bool], capacity: int, shards: int, above: bool) -> tuple[int, list[int]]:
    """Walks blocks with prefix sums `sums` (starting at 0); returns how far `shards` shards reach and each stop.
    above: a stop within a divisible block counts there, else before the block."""
    at, stops = 0, []
    for _ in range(shards):
        k = bisect_right(sums, at + capacity) - 1  # blocks that fit
        if above and k < len(whole) and not whole[k]:
            at = max(at, min(at + capacity, sums[-1]))
        else:
            at = max(at, sums[k])
        stops.append(at)
        if at >= sums[-1]:
            break
    return at, stops


def cuts(groups: DataFrame, shards: int, blocks: int = BLOCKS) -> tuple[int, list[str]]:
    """(capacity, digests that start shards 1..) of the minimax contiguous partition of groups (digest hex, bytes) in
    the order of digest; rows of one digest are one group. No groups: capacity 0 and no cuts."""
    digits = max(1, (blocks // 16).bit_length() // 4)
    wide = 64
    known: list[tuple[str, int, str, bool]] = []  # first digest, bytes, last digest, one group
    doubt: list[tuple[str, str]] | None = None
    while True:
        part = groups
        if doubt is not None:
            part = groups.filter(F.array_contains(F.transform(F.array([F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in doubt]), lambda x: (F.col("digest") >= x["a"]) & (F.col("digest") <= x["b"])), True))
        rows = part.groupBy(F.substring("digest", 1, min(digits, wide)).alias("p")).agg(F.sum("bytes").alias("b"), F.min("digest").alias("a"), F.max("digest").alias("z")).collect()
        new = sorted((r["a"], int(r["b"]), r["z"], r["a"] == r["z"]) for r in rows)
        known = sorted([k for k in known if doubt is None or not any(a <= k[0] <= b for a, b in doubt)] + new)
        if not known:
            return 0, []
        sums = [0]
        for k in known:
            sums.append(sums[-1] + k[1])
        whole = [k[3] for k in known]
        total = sums[-1]
        # the largest capacity surely too small, the smallest surely enough
        low, high = -(-total // shards) - 1, total
        a, b = low, high
        while b - a > 1:
            m = (a + b) // 2
            if greedy(sums, whole, m, shards, above=True)[0] < total:
                a = m
            else:
                b = m
        low = a
        a, b = low, high
        while b - a > 1:
            m = (a + b) // 2
            if greedy(sums, whole, m, shards, above=False)[0] >= total:
                b = m
            else:
                a = m
        high = b
        below = greedy(sums, whole, low + 1, shards, above=False)[1]
        upper = greedy(sums, whole, high, shards, above=True)[1]
        doubtful: set[int] = set()
        for k in range(shards):
            x = below[k] if k < len(below) else total
            y = upper[k] if k < len(upper) else total
            i, j = bisect_right(sums, x) - 1, bisect_right(sums, y)
            doubtful.update(n for n in range(max(0, i), min(j, len(known))) if not whole[n])
        if high == low + 1 and not doubtful:
            stops = greedy(sums, whole, high, shards, above=False)[1]
            return high, [known[bisect_right(sums, s) - 1][0] for s in stops if s < total]
        if not doubtful:  # bounds meet nowhere else: all blocks in question are single groups
            doubtful = {n for n in range(len(known)) if not whole[n]}
            if not doubtful:
                raise AssertionError("single groups leave the capacity undecided")
        # split as many of the doubtful blocks as the bound allows, by as many more digits as it allows
        runs: list[list[str]] = []
        for n in sorted(doubtful):
            if runs and known[n - 1][2] == runs[-1][1]:
                runs[-1][1] = known[n][2]
            else:
                runs.append([known[n][0], known[n][2]])
        doubt = [(a, b) for a, b in runs]
        more = 1
        while len(doubtful) * 16 ** (more + 1) <= blocks and digits + more < wide:
            more += 1
        digits = min(wide, digits + more)


def shard(docs: DataFrame, shards: int = 40, law: str = "bytes") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row of docs.

    size is the text's UTF-8 bytes plus 16; equal texts share a shard; slot numbers the rows of a shard from 0 without
    gaps. Null text: no bytes, a group of its own kind (with empty texts, which are equal bytes but not null, apart), crc
    of nothing. Null doc_id: kept. Rows that repeat: each gets a slot. Fewer groups than shards: some shards stay empty.
    Empty table: no rows. Other columns are left out.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.when(F.col("text").isNull(), F.sha2(F.lit("null text"), 256)).otherwise(F.sha2(text, 256))
    slim = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), digest.alias("digest")), "sizes")
    groups = slim.groupBy("digest").agg(F.sum("size").alias("bytes"))

    # groups above the mean of what is left: fewer than shards of them can exist
    total = slim.agg(F.sum("size")).first()[0] or 0
    largest = [(r["digest"], r["bytes"]) for r in groups.filter(F.col("bytes") * shards > total).orderBy(F.desc("bytes"), "digest").limit(shards).collect()]
    alone: list[str] = []
    left = total
    for key, size in largest:
        if len(alone) < shards - 1 and size * (shards - len(alone)) > left:
            alone.append(key)
            left -= size
    rest = slim.select("digest", F.col("size").alias("bytes"))
    if alone:
        rest = rest.filter(~F.col("digest").isin(alone))
    _, starts = cuts(rest, shards - len(alone))
    base = len(alone)
    number: Column = F.lit(base) + F.size(F.filter(F.array(*[F.lit(s) for s in starts]).cast("array<string>"), lambda s: s <= F.col("digest")))
    for k, key in reversed(list(enumerate(alone))):
        number = F.when(F.col("digest") == key, F.lit(k)).otherwise(number)

    # slots: rows are dealt to buckets by a hash; a bucket's rows of a shard follow those of the buckets before it
    n = max(4 * parallelism(spark), 64)
    rows = slim.withColumn("shard", number.cast("int")).withColumn("_b", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(n)).cast("int"))
    counts = rows.groupBy("shard", "_b").agg(F.count("*").alias("n"))
    before = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy("_b", "shard").orderBy("doc_id", "digest")) - 1
    return rows.withColumn("_w", within).join(before, ["shard", "_b"]).select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("base") + F.col("_w")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
