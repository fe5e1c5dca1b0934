"""Approximate nearest neighbours by largest inner product: one robust-pruned directed graph for each shard of vectors.

Vectors are dealt to shards of about SHARD by their length (within a factor of 2) and a hash of their id, so that a few very
long ones don't squeeze the others together. A shard's graph is built in one task: in batches, a
greedy beam search on the graph so far proposes neighbours, and robust pruning keeps a near one and drops those that are
clearly closer to it than to the node (the relaxation factor ALPHA leaves some long edges). Equal vectors of a shard are
one node. Queries go in blocks to each shard, a beam search finds candidates there, and their products are recomputed in
double precision on the original vectors. For inner products, a further coordinate gives all vectors one length, which
turns the largest product into the smallest distance.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetrail.llm.common import parallelism, stored

#: Vectors in a shard, about; edges of a node; beam widths of building and searching; relaxation of pruning.
SHARD, DEGREE, BUILD_BEAM, BEAM, ALPHA = 4096, 24, 40, 96, 1.2
#: Queries in a block, about.
BLOCK = 1024


class Graph:
    """Nodes x (n, d), out-edges (n, DEGREE; -1: none), entry node."""

    def __init__(self, x: np.ndarray, seed: int = 0, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA):
        self.x = x.astype(np.float32)
        self.norm = (self.x * self.x).sum(axis=1)
        self.degree = degree
        n = len(x)
        rng = np.random.default_rng(seed)
        self.entry = int(((self.x - self.x.mean(axis=0)) ** 2).sum(axis=1).argmin()) if n else 0
        self.out = np.full((n, degree), -1, np.int32)
        if n > 1:  # a random start keeps the graph connected while it is built
            k = min(degree // 2, n - 1)
            self.out[:, :k] = (np.arange(n)[:, None] + rng.integers(1, n, (n, k))) % n
        order = rng.permutation(n)
        for a in range(0, n, 256):
            self._insert(order[a : a + 256], beam, alpha)

    def _insert(self, nodes: np.ndarray, beam: int, alpha: float) -> None:
        found, _, _ = self.search(self.x[nodes], beam)
        found = np.hstack([found, self.out[nodes]])
        self.out[nodes] = self._prune(nodes, found, alpha)
        back: dict[int, list[int]] = {}
        for p, row in zip(nodes.tolist(), self.out[nodes].tolist()):
            for q in row:
                if q >= 0:
                    back.setdefault(q, []).append(p)
        full = []
        for q, ps in back.items():
            row = self.out[q]
            new = [p for p in ps if p not in row.tolist()]
            free = np.flatnonzero(row < 0)
            if len(new) <= len(free):
                row[free[: len(new)]] = new
            else:
                full.append((q, row.tolist() + new))
        if full:
            wide = max(len(c) for _, c in full)
            cand = np.array([c + [-1] * (wide - len(c)) for _, c in full], np.int32)
            ids = np.array([q for q, _ in full])
            self.out[ids] = self._prune(ids, cand, alpha)

    def _prune(self, nodes: np.ndarray, cand: np.ndarray, alpha: float) -> np.ndarray:
        """The kept neighbours of each node, nearest first."""
        cand = np.where(cand == nodes[:, None], -1, cand)
        order = np.argsort(cand, axis=1, kind="stable")
        cand = np.take_along_axis(cand, order, axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        v = self.x[cand]
        far = self.norm[cand] - 2 * np.einsum("bcd,bd->bc", v, self.x[nodes]) + self.norm[nodes][:, None]
        far = np.where(cand < 0, np.inf, np.maximum(far, 0))
        left = far.copy()
        kept = np.full((len(nodes), self.degree), -1, np.int32)
        rows = np.arange(len(nodes))
        for k in range(self.degree):
            best = left.argmin(axis=1)
            ok = np.isfinite(left[rows, best])
            if not ok.any():
                break
            kept[ok, k] = cand[rows, best][ok]
            chosen = v[rows, best]
            between = self.norm[cand] - 2 * np.einsum("bcd,bd->bc", v, chosen) + self.norm[cand[rows, best]][:, None]
            left = np.where(alpha * alpha * np.maximum(between, 0) <= far, np.inf, left)
            left[rows, best] = np.inf
        return kept

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(nodes, squared distances, steps): the `beam` nearest nodes the walk of each query found; -1 where fewer."""
        q = q.astype(np.float32)
        m, n = len(q), len(self.x)
        qn = (q * q).sum(axis=1)
        ids = np.full((m, beam), -1, np.int32)
        dist = np.full((m, beam), np.inf, np.float32)
        done = np.ones((m, beam), bool)
        seen = np.zeros((m, n), bool)
        ids[:, 0] = self.entry
        dist[:, 0] = self.norm[self.entry] - 2 * (q @ self.x[self.entry]) + qn
        done[:, 0] = False
        seen[:, self.entry] = True
        steps = 0
        live = np.arange(m)
        while len(live):
            steps += 1
            open_ = np.where(done[live], np.inf, dist[live])
            at = open_.argmin(axis=1)
            going = np.isfinite(open_[np.arange(len(live)), at])
            live, at = live[going], at[going]
            if not len(live):
                break
            done[live, at] = True
            new = self.out[ids[live, at]]
            fresh = (new >= 0) & ~seen[live[:, None], np.maximum(new, 0)]
            r, c = np.nonzero(fresh)
            seen[live[r], new[r, c]] = True
            d = np.full(new.shape, np.inf, np.float32)
            d[r, c] = self.norm[new[r, c]] - 2 * np.einsum("ij,ij->i", self.x[new[r, c]], q[live[r]]) + qn[live[r]]
            d2 = np.hstack([dist[live], d])
            top = np.argpartition(d2, beam - 1, axis=1)[:, :beam]
            dist[live] = np.take_along_axis(d2, top, axis=1)
            ids[live] = np.take_along_axis(np.hstack([ids[live], np.where(fresh, new, -1)]), top, axis=1)
            done[live] = np.take_along_axis(np.hstack([done[live], ~fresh]), top, axis=1)
        return ids, dist, steps


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>): rows with an id and a vector without null or non-finite components and not all zero."""
    v = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(good).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def unit_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows divided by their largest component, and the lengths of those; neither overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x, np.sqrt((x * x).sum(axis=1))


def build(vectors: DataFrame, shard: int = SHARD) -> DataFrame:
    """(dim, band, shard, graph): the pickled graph, vectors and ids of each shard of usable vectors (vec_id, v)."""

    def make(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids)
        x = np.array(table.column("v").combine_chunks().values.to_numpy()).reshape(len(ids), -1)[order]
        ids = ids[order]
        nodes, first, which = np.unique(x, axis=0, return_index=True, return_inverse=True)
        members = np.split(ids[np.argsort(which.ravel(), kind="stable")], np.cumsum(np.bincount(which.ravel()))[:-1])
        # scaled so that float32 holds it, and lifted to one length
        part = nodes / np.abs(nodes).max()
        size = (part * part).sum(axis=1)
        top = np.sqrt(size.max())
        lifted = np.hstack([part / top, np.sqrt(np.maximum(0, 1 - size / top**2))[:, None]])
        blob = pickle.dumps((Graph(lifted), nodes, members))
        return pa.table({**{c: table.column(c).slice(0, 1) for c in ("dim", "band", "shard")}, "graph": pa.array([blob], pa.binary())})

    most = F.array_max(F.transform("v", F.abs))
    length = F.log2(most) + F.log2(F.aggregate("v", F.lit(0.0), lambda total, x: total + (x / most) * (x / most))) / 2
    banded = vectors.select("vec_id", "v", F.size("v").alias("dim"), F.floor(length).cast("int").alias("band"))
    counts = banded.groupBy("dim", "band").agg(F.ceil(F.count("*") / shard).alias("n"))
    keyed = banded.join(counts, ["dim", "band"]).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("n")).cast("int")).drop("n")
    return stored(keyed.groupBy("dim", "band", "shard").applyInArrow(make, "dim int, band int, shard int, graph binary"), "graphs")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, beam: int = BEAM, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries (vec_id, embedding), which are rows of vectors, the k nearest
    found of vectors, its own row left out, by largest inner product in double precision, ties to the smaller vec_id.

    Vectors that are null, all zero, or hold a null or non-finite component, and rows without an id take no part, as
    query or candidate; fewer candidates than k: all; vectors with another count of components than the query's are no
    candidates. Rows that share an id are each a query and each other's candidates, repeated rows too. Products beyond a
    double are infinite, and undefined ones (infinities of both signs) come last. Empty tables: no rows. Other columns are
    left out. Memory of a task: a shard's graph and a block of queries.
    """
    base = stored(usable(vectors), "vectors")
    graphs = build(base, shard)
    asked = usable(queries).withColumn("copy", F.row_number().over(Window.partitionBy("vec_id", "v").orderBy("vec_id")))
    asked = stored(asked.select(F.xxhash64("vec_id", "v", "copy").alias("q"), "vec_id", "v"), "asked")
    blocks = max(1, -(-asked.count() // BLOCK))
    packed = asked.withColumn("block", F.pmod(F.xxhash64("q", F.lit(5)), F.lit(blocks)).cast("int")).withColumn("dim", F.size("v"))
    packed = packed.groupBy("dim", "block").agg(F.collect_list(F.struct("q", "vec_id", "v")).alias("ask"))  # about BLOCK rows
    # each block of queries goes to each shard of its length
    shards = graphs.groupBy("dim").agg(F.collect_set(F.struct("band", "shard")).alias("shards"))
    sent = packed.join(shards, "dim").select("dim", F.explode("shards").alias("s"), "ask").select("dim", "s.*", "ask")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, ask in zip(batch.column("graph"), batch.column("ask")):
                graph, nodes, members = pickle.loads(blob.as_py())
                flat = ask.values
                ids, names = flat.field("vec_id").to_numpy(), flat.field("q").to_numpy()
                q = np.array(flat.field("v").flatten().to_numpy()).reshape(len(ids), -1)
                for a in range(0, len(ids), 256):
                    own, part = ids[a : a + 256], q[a : a + 256]
                    unit, size = unit_rows(part)
                    unit = unit / size[:, None]
                    got, dist, _ = graph.search(np.hstack([unit, np.zeros((len(part), 1))]), max(beam, 2 * k))
                    rows: tuple[list, ...] = ([], [], [], [])
                    for i in range(len(own)):
                        near = got[i][got[i] >= 0]
                        with np.errstate(over="ignore", invalid="ignore"):
                            score = (nodes[near] * part[i]).sum(axis=1)
                        score = np.where(np.isnan(score), -np.inf, score)
                        best = np.lexsort((np.array([members[x][0] for x in near]), -score))
                        pairs = []
                        for j in best.tolist():
                            # of equal vectors only the smallest ids can be among the k nearest
                            held = members[near[j]][: k + 1].tolist()
                            if own[i] in held and (nodes[near[j]] == part[i]).all():
                                held.remove(own[i])
                            pairs += [(-score[j], v) for v in held]
                            if len(pairs) > 4 * k and -pairs[k - 1][0] > score[j]:
                                break
                        for s, v in sorted(pairs)[:k]:
                            rows[0].append(int(own[i]))
                            rows[1].append(v)
                            rows[2].append(-s)
                            rows[3].append(int(names[a + i]))
                    yield pa.RecordBatch.from_arrays([*(pa.array(rows[c], pa.int64()) for c in (0, 1)), pa.array(rows[2], pa.float64()), pa.array(rows[3], pa.int64())], ["query_id", "vec_id", "score", "q"])

    # one graph at a time in a task: a batch is a few rows
    pairs = sent.join(graphs, ["dim", "band", "shard"]).select("graph", "ask").repartition(max(parallelism(base.sparkSession), 12))
    found = pairs.mapInArrow(find, "query_id long, vec_id long, score double, q long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
