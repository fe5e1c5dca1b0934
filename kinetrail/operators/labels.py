"""Label keys, lists of labels, entity ids, active labels and fills for recordings without predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_parts(label: Column) -> tuple[Column, Column, Column]:
    """(agent, target, action) of `agent,target,action` or `agent,action`: the prefix `mouse` goes, and a target that is
    missing, empty, `self` or `none` is the agent."""
    parts = F.transform(F.split(F.trim(label), ","), lambda p: F.trim(p))
    name = lambda c: F.regexp_replace(c, "^mouse", "")
    agent = name(parts[0])
    middle = F.when(F.size(parts) > 2, parts[1])
    target = F.when(middle.isNull() | middle.isin("", "self", "none"), agent).otherwise(name(middle))
    return agent, target, F.element_at(parts, -1)


def listed(rows: DataFrame, column: str, *keep: str) -> DataFrame:
    """(keep, agent, target, action) of each distinct label of a JSON list, quotes gone, the action in lower case; no
    rows for null or malformed lists; a label with fewer than three parts has nulls for those it lacks."""
    found = F.from_json(column, "array<string>")
    each = F.array_distinct(F.transform(found, lambda v: F.regexp_replace(v, "'", "")))
    parts = F.split("label", ",")
    return rows.select(*keep, F.explode(each).alias("label")).select(*keep, F.get(parts, 0).alias("agent"), F.get(parts, 1).alias("target"), F.lower(F.get(parts, 2)).alias("action"))


def resolve(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, raw, id): the first of n, n - 1, `n`, `mouse n` and the raw name itself that is a known id (key, id; strings)
    of the same key, n being the digits that end raw; null if none is. Digits beyond 64 bits have no n - 1."""
    n = F.nullif(F.regexp_extract("raw", r"(\d+)$", 1), F.lit(""))
    tries = F.array(n, (n.try_cast("long") - 1).cast("string"), F.concat(F.lit("mouse"), n), F.col("raw"))
    asked = wanted.select(key, "raw", F.posexplode(tries).alias("turn", "id"))
    found = asked.join(known.select(key, "id").distinct(), [key, "id"]).groupBy(key, "raw").agg(F.min_by("id", "turn").alias("id"))
    return wanted.select(key, "raw").distinct().join(found, [key, "raw"], "left")


def active(predictions: DataFrame, solution: DataFrame, key: str, labels: list[str]) -> DataFrame:
    """Predictions whose labels are listed (labels_of) by the first row (smallest `row`) of their key's solution."""
    first = solution.groupBy(key).agg(F.min_by("labels_of", "row").alias("labels_of"))
    allowed = first.select(key, F.explode(F.split("labels_of", ",")).alias(labels[0])).distinct()
    return predictions.join(allowed, [key, *labels], "left_semi")


def active_triples(predictions: DataFrame, solution: DataFrame, key: str) -> DataFrame:
    """predictions (key, agent, target, action, ...) whose normalised label is in the JSON list `labels_of` of the first
    row (smallest `row`) of their key's solution."""
    first = solution.groupBy(key).agg(F.min_by("labels_of", "row").alias("labels_of"))
    each = first.select(key, F.explode(F.array_distinct(F.from_json("labels_of", "array<string>"))).alias("label"))
    a, t, c = key_parts(F.regexp_replace("label", "'", ""))
    allowed = each.select(F.col(key).alias("_key"), a.alias("_a"), t.alias("_t"), c.alias("_c")).distinct()
    mine = key_parts(F.concat_ws(",", "agent", F.coalesce("target", F.lit("")), "action"))
    on = (F.col(key) == F.col("_key")) & (mine[0] == F.col("_a")) & (mine[1] == F.col("_t")) & (mine[2] == F.col("_c"))
    return predictions.join(allowed, on, "left_semi")


def single_targets(rows: DataFrame, listed_single: list[str]) -> DataFrame:
    """rows (row, agent, target, action, ...) whose target is the agent where the action is done alone: its first row
    (smallest `row`) is on itself, or it is listed."""
    first = rows.groupBy("action").agg(F.min_by(F.col("agent") == F.col("target"), "row").alias("_alone")).select(F.col("action").alias("_action"), "_alone")
    alone = F.coalesce("_alone", F.lit(False)) | F.col("action").isin(listed_single)
    return rows.join(first, F.col("action") == F.col("_action"), "left").withColumn("target", F.when(alone, F.col("agent")).otherwise(F.col("target"))).drop("_action", "_alone")


def fill(extents: DataFrame, actions: DataFrame, predicted: DataFrame, key: str, skip: Column | None = None) -> DataFrame:
    """(key, agent, target, action, start, stop) for keys without a prediction: each (agent, target)'s actions, in order,
    share the frames first..last in equal parts, the last one ending with them. skip: extents that are not filled, such as
    those of labs whose name starts a certain way; where it is null they are filled."""
    if skip is not None:
        extents = extents.filter(~F.coalesce(skip, F.lit(False)))
    bare = extents.join(predicted.select(key).distinct(), key, "left_anti")
    turns = actions.groupBy(key, "agent", "target").agg(F.array_sort(F.collect_set("action")).alias("all"))
    each = bare.join(turns, key).select(key, "agent", "target", "first", "last", F.size("all").alias("n"), F.posexplode("all").alias("i", "action"))
    part = F.ceil((F.col("last") + 1 - F.col("first")) / F.col("n"))
    start = F.col("first") + F.col("i") * part
    rows = each.select(key, "agent", "target", "action", start.alias("start"), F.least(start + part, F.col("last") + 1).alias("stop"))
    return rows.filter("start < stop")


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with row_id, gapless from 0 in order of key (nulls first), then order: places within a key plus the counts of
    the keys before; only the counts pass one task."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_c"))
    before = counts.select(F.col(key).alias("_key"), (F.sum("_c").over(Window.orderBy(key)) - F.col("_c")).alias("_before"))
    at = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_at", at).join(before, F.col(key).eqNullSafe(F.col("_key"))).withColumn("row_id", F.col("_before") + F.col("_at") - 1).drop("_at", "_before", "_key")


def write_csv(rows: DataFrame, path: str, key: str, order: list[str]) -> None:
    """numbered() rows as CSV with a header, row_id first; the files, in name order, hold the rows in order."""
    out = numbered(rows, key, order)
    out.select("row_id", *rows.columns).repartitionByRange("row_id").sortWithinPartitions("row_id").write.csv(path, header=True, mode="overwrite")


def read_csv(spark, path: str, schema: str) -> DataFrame:
    """CSV with a header and a stated schema, so no pass over the data infers one."""
    return spark.read.schema(schema).csv(path, header=True)
