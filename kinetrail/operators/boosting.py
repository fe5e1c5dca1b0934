"""Boosted trees for every (section, branch, action) at once: each model's rows are resampled, binned and counted by Spark, the
counts dealt by model, and fitted on histograms, a missing value going to the side that a split learned for it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrail.operators import sampling

Array = np.ndarray


@dataclass(frozen=True)
class Settings:
    """trees, depth and step of a model; bins of a feature; penalty on leaf weights; least sum of curvature of a leaf; share
    of positives that resampling brings about; most rows a model is fitted on (those of smallest md5 of their key; None: all)."""

    trees: int = 20
    depth: int = 4
    step: float = 0.1
    bins: int = 64
    penalty: float = 1.0
    least: float = 1.0
    ratio: float | None = 0.3
    most: int | None = None


@dataclass
class Nodes:
    """A tree's nodes in heap order: feature (-1: a leaf), threshold (up to it goes left), side of missing values, value."""

    feature: Array
    threshold: Array
    missing_left: Array
    value: Array

    def leaves(self, x: Array) -> Array:
        """The value of the leaf that each row reaches."""
        at = np.zeros(len(x), np.int64)
        while True:
            f = self.feature[at]
            go = np.flatnonzero(f >= 0)
            if not len(go):
                return self.value[at]
            v = x[go, f[go]]
            left = np.where(np.isnan(v), self.missing_left[at[go]], v <= self.threshold[at[go]])
            at[go] = 2 * at[go] + np.where(left, 1, 2)


def _edges(x: Array, bins: int) -> Array:
    """Values at which a feature may be split: its quantiles; the largest parts what is known from what is missing."""
    known = np.sort(x[~np.isnan(x)])
    return np.unique(known[np.linspace(0, len(known) - 1, min(bins, len(known))).astype(np.int64)]) if len(known) else known


def _grow(codes: Array, edges: list[Array], gradient: Array, curvature: Array, s: Settings) -> Nodes:
    """One tree on binned features; the bin after the last is that of missing values."""
    size, wide = 2 ** (s.depth + 1) - 1, max((len(e) for e in edges), default=0) + 2
    tree = Nodes(np.full(size, -1, np.int64), np.zeros(size), np.zeros(size, bool), np.zeros(size))
    node = np.zeros(len(gradient), np.int64)
    for level in range(s.depth + 1):
        first, n = 2**level - 1, 2**level
        here = np.flatnonzero(node >= first)
        if not len(here):
            break
        at = node[here] - first
        total = [np.bincount(at, w[here], n) for w in (gradient, curvature)]
        tree.value[first : first + n] = -total[0] / (total[1] + s.penalty) * s.step
        if level == s.depth:
            break
        score = lambda g, h: g * g / (h + s.penalty)
        best, pick = np.full(n, 1e-12), np.full((n, 3), -1, np.int64)
        for f, cut in enumerate(edges):
            if not len(cut):
                continue
            g, h = (np.bincount(at * wide + codes[here, f], w[here], n * wide).reshape(n, wide) for w in (gradient, curvature))
            gone = len(cut) + 1
            for side in (1, 0):  # missing values left, then right
                gl, hl = (np.cumsum(t[:, : len(cut)], axis=1) + side * t[:, gone : gone + 1] for t in (g, h))
                gr, hr = total[0][:, None] - gl, total[1][:, None] - hl
                gain = np.where((hl >= s.least) & (hr >= s.least), score(gl, hl) + score(gr, hr) - score(*total)[:, None], -np.inf)
                b = gain.argmax(axis=1)
                won = gain[np.arange(n), b] > best + 1e-12
                best = np.where(won, gain[np.arange(n), b], best)
                pick[won] = np.stack([np.full(n, f), b, np.full(n, side)], axis=1)[won]
        split = np.flatnonzero(pick[:, 0] >= 0)
        if not len(split):
            break
        tree.feature[first + split], tree.missing_left[first + split] = pick[split, 0], pick[split, 2] == 1
        tree.threshold[first + split] = [edges[f][b] for f, b in pick[split, :2]]
        f, b, side = pick[at].T
        go = f >= 0
        code = codes[here, np.maximum(f, 0)]
        missing = code == np.array([len(e) + 1 for e in edges])[np.maximum(f, 0)]
        left = np.where(missing, side == 1, code <= b)
        node[here] = np.where(go, 2 * node[here] + np.where(left, 1, 2), -1)
    return tree


def _codes(x: Array, edges: list[Array]) -> Array:
    """The bin of each value: the first edge it doesn't exceed; the bin after the last is that of missing values."""
    return np.stack([np.where(np.isnan(x[:, f]), len(e) + 1, np.searchsorted(e, x[:, f], side="left")) for f, e in enumerate(edges)], axis=1)


def fit(x: Array, y: Array, s: Settings) -> list[Nodes]:
    """Trees of log loss on rows x (NaN: missing) with labels y; positives weigh as much as negatives together."""
    edges = [_edges(x[:, f], s.bins) for f in range(x.shape[1])]
    return fit_cells(_codes(x, edges), edges, y, np.ones(len(y)), s)


def fit_cells(codes: Array, edges: list[Array], y: Array, count: Array, s: Settings) -> list[Nodes]:
    """fit() on rows that are given once for each of their bins and labels, with how many there are: trees tell no more
    of a row than its bins."""
    pos = float(count[y].sum())
    weight = count * np.where(y, max(1.0, float(count.sum()) - pos) / max(1.0, pos), 1.0)
    # a value of each bin
    x = np.stack([np.concatenate([e, [np.inf, np.nan]])[codes[:, f]] for f, e in enumerate(edges)], axis=1)
    margin, out = np.zeros(len(y)), []
    for _ in range(s.trees):
        p = 1 / (1 + np.exp(-margin))
        out.append(_grow(codes, edges, weight * (p - y), weight * p * (1 - p), s))
        margin += out[-1].leaves(x)
    return out


def probability(trees: list[Nodes], x: Array) -> Array:
    return 1 / (1 + np.exp(-sum((t.leaves(x) for t in trees), np.zeros(len(x)))))


NODE = T.StructType([T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()), T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()), T.StructField("missing_left", T.BooleanType()), T.StructField("value", T.DoubleType())])


def _matrix(table: pa.Table | pa.RecordBatch, features: list[str]) -> Array:
    return np.stack([table.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(f).cast(pa.float64()).to_numpy() for f in features], axis=1)


def _all_edges(held: DataFrame, features: list[str], bins: int) -> dict[int, list[Array]]:
    """The edges of each feature of each model (_id) of held, as _edges() has them: the values at `bins` ranks, exactly.
    Equal values are counted, then ranked within parts between rough quantiles, so no task orders a whole model."""
    long = held.select("_id", F.posexplode(F.array(*(F.col(f"`{f}`") for f in features))).alias("f", "v")).filter("v is not null and not isnan(v)")
    values = long.groupBy("_id", "f", "v").agg(F.count("*").alias("n")).persist(StorageLevel.DISK_ONLY)
    cuts = values.groupBy("_id", "f").agg(F.percentile_approx("v", [k / 16 for k in range(1, 16)], 1000).alias("cuts"), F.sum("n").alias("all"))
    steps = F.least("all", F.lit(bins)) - 1
    ranks = F.transform(F.sequence(F.lit(0).cast("long"), steps), lambda i: F.when(i == steps, F.when(steps == 0, 0).otherwise(F.col("all") - 1)).otherwise(F.floor(i * ((F.col("all") - 1) / F.nullif(steps, F.lit(0))))))
    parts = values.join(F.broadcast(cuts.select("_id", "f", "cuts", ranks.alias("ranks"))), ["_id", "f"]).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("v"))))
    sizes = parts.groupBy("_id", "f", "part").agg(F.sum("n").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("_id", "f").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 16 rows
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("_id", "f", "part").orderBy("v"))
    placed = parts.join(F.broadcast(sizes.select("_id", "f", "part", before.alias("before"))), ["_id", "f", "part"]).withColumn("upto", upto)
    met = placed.filter(F.exists("ranks", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n"))))
    out: dict[int, list[Array]] = {}
    for r in met.groupBy("_id", "f").agg(F.sort_array(F.collect_list("v")).alias("edges")).collect():
        out.setdefault(r["_id"], [np.zeros(0)] * len(features))[r["f"]] = np.unique(np.array(r["edges"]))
    values.unpersist()
    return out


def fit_all(rows: DataFrame, keys: list[str], features: list[str], key: str, s: Settings = Settings()) -> DataFrame:
    """(keys, pos, neg, used_pos, used_neg, nodes): a model for each keys of rows (keys, key, y, features) that have both
    classes. Negatives are cut to s.ratio's share (those of smallest md5 of `key` stay), then, if s.most says so, each model
    keeps at most so many rows in the same order; weights are taken after that. Missing values are null or NaN; rows without y
    don't count. Rows are counted by their bins and labels, and models fitted on these cells side by side, one a task: the
    same trees, and as long as bins repeat few rows a model. The edges of bins (features * s.bins numbers a model) pass the
    driver, no rows do."""
    typed = rows.filter("y is not null").select(*keys, F.struct(*keys).alias("_model"), F.col(key).alias("_key"), "y", *(F.col(f"`{f}`").cast("double").alias(f) for f in features))
    counted = typed.groupBy("_model").agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg")).filter("pos > 0 and neg > 0")
    less = sampling.downsample(typed, "_model", "_key", s.ratio) if s.ratio else typed
    less = sampling.ranked(less, "_model", "_key", F.lit(s.most)).drop("_rank") if s.most else less
    named = F.xxhash64(*keys).alias("_id")
    held = less.join(counted.select("_model"), "_model").select(*keys, named, "y", *(F.col(f"`{f}`") for f in features)).persist(StorageLevel.DISK_ONLY)
    edges, none = _all_edges(held, features, s.bins), [np.zeros(0)] * len(features)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, y, x = batch.column("_id").to_numpy(), batch.column("y").to_numpy(zero_copy_only=False), _matrix(batch, features)
            for i in np.unique(ids):
                at = np.flatnonzero(ids == i)
                cells, n = np.unique(np.column_stack([y[at], _codes(x[at], edges.get(int(i), none))]).astype("<i4"), axis=0, return_counts=True)
                told = [pa.array(np.full(len(n), i)), pa.array(cells[:, 0] == 1), pa.array([c.tobytes() for c in cells[:, 1:]], pa.binary()), pa.array(n)]
                yield pa.RecordBatch.from_arrays(told, names=["_id", "y", "_cell", "_n"])

    slim = held.select("_id", "y", *(F.col(f"`{f}`") for f in features))
    cells = slim.mapInArrow(binned, "_id long, y boolean, _cell binary, _n long").groupBy("_id", "y", "_cell").agg(F.sum("_n").alias("_n")).persist(StorageLevel.DISK_ONLY)
    cells.count()
    held.unpersist()
    models = counted.select("_model.*", "pos", "neg").withColumn("_id", named)

    def one(table: pa.Table) -> pa.Table:
        y, n = table.column("y").to_numpy().astype(bool), table.column("_n").to_numpy()
        codes = np.stack([np.frombuffer(c, "<i4") for c in table.column("_cell").to_pylist()]).astype(np.int64)
        # an order of the cells' own, so that sums don't depend on how they arrived
        order = np.lexsort((*codes.T, y))
        trees = fit_cells(codes[order], edges.get(table.column("_id")[0].as_py(), none), y[order], n[order].astype(np.float64), s)
        told = [
            {"tree": t, "node": k, "feature": int(n.feature[k]), "threshold": float(n.threshold[k]), "missing_left": bool(n.missing_left[k]), "value": float(n.value[k])}
            for t, n in enumerate(trees) for k in range(len(n.feature)) if k == 0 or n.feature[(k - 1) // 2] >= 0
        ]
        out = table.select([*keys, "pos", "neg"]).slice(0, 1)
        out = out.append_column("used_pos", pa.array([int(n[y].sum())])).append_column("used_neg", pa.array([int(n[~y].sum())]))
        return out.append_column("nodes", pa.array([told], pa.list_(pa.struct([("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("threshold", pa.float64()), ("missing_left", pa.bool_()), ("value", pa.float64())]))))

    schema = T.StructType([*rows.select(*keys).schema.fields, *[T.StructField(c, T.LongType()) for c in ("pos", "neg", "used_pos", "used_neg")], T.StructField("nodes", T.ArrayType(NODE))])
    return cells.join(models, "_id").groupBy(*keys).applyInArrow(one, schema)


def trees_of(nodes: list) -> list[Nodes]:
    """The trees of a model's nodes."""
    out: dict[int, Nodes] = {}
    most = max((n["node"] for n in nodes), default=0) + 1
    for n in nodes:
        t = out.setdefault(n["tree"], Nodes(np.full(most, -1, np.int64), np.zeros(most), np.zeros(most, bool), np.zeros(most)))
        t.feature[n["node"]], t.threshold[n["node"]], t.missing_left[n["node"]], t.value[n["node"]] = n["feature"], n["threshold"], n["missing_left"], n["value"]
    return [out[k] for k in sorted(out)]


def score_all(rows: DataFrame, models: DataFrame, shared: list[str], keys: list[str], features: list[str], most: int = 5_000_000) -> DataFrame:
    """rows with the other keys (those that rows lack) and prob: each row scored by every model of its `shared` keys. The
    models go to every task; more than `most` nodes in all are an error (a node takes some 40 bytes)."""
    own = [k for k in keys if k not in shared]
    size = models.agg(F.sum(F.size("nodes"))).first()[0] or 0
    if size > most:
        raise ValueError(f"{size} nodes of models; at most {most} are sent to every task")
    by: dict[tuple, list] = {}
    for m in models.select(*keys, "nodes").collect():
        by.setdefault(tuple(m[k] for k in shared), []).append((tuple(m[k] for k in own), trees_of(m["nodes"])))
    kinds = models.select(*own).schema.fields
    schema = T.StructType([*rows.schema.fields, *kinds, T.StructField("prob", T.DoubleType())])

    def score(batches):
        for batch in batches:
            x = _matrix(batch, features)
            told = list(zip(*(batch.column(k).to_pylist() for k in shared)))
            for group in dict.fromkeys(told):
                at = np.array([i for i, t in enumerate(told) if t == group])
                for names, trees in by.get(group, ()):
                    part = batch.take(pa.array(at))
                    extra = [pa.array([n] * len(at)) for n in names]
                    yield pa.RecordBatch.from_arrays([*part.columns, *extra, pa.array(probability(trees, x[at]))], names=[*part.schema.names, *own, "prob"])

    return rows.mapInArrow(score, schema)
