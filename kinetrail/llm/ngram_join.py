"""Jaccard self-join of word n-gram sets with a prefix tree, and the groups its links make.

Sets are sorted by a global order (the hash of the n-gram). Two sets with Jaccard similarity of at least t share at
least l of the first n - ceil(t n) + l n-grams of each, so a set whose first n-grams (its signature) are shared with too
few other sets has no partner. For the rest, the shared n-grams of a signature are reordered, rarest first, and the
first of those tie candidates together into blocks; frequent passages don't, as they come last. Within a block the whole
sets stand in a prefix tree: a set walks the branches that lead to its candidates, those that share
enough of their signatures with it for what remains to reach the bound, sharing the overlap with common beginnings, and
leaves a subtree as soon as what remains of the two can't reach it. Candidates that links have already put in the set's own group are passed over.

A block too large for one tree is cut first: similar sets share percent of the n-grams of each, so a set that shares fewer with
all others of large blocks has no partner, and the rest are tied anew by the rarest of their whole sets. What is still too large
is compared by chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrail.llm.common import NO_ID, discard, fresh, frugal, keyed, parallelism, stored
from kinetrail.llm.groups import Forest, components, contracted
from kinetrail.llm.words import SPACED, Words, mix, ranges, words

#: Bytes of sets that one prefix tree holds; a larger block is compared chunk by chunk.
CHUNK = 48 << 20
#: Sets that one prefix tree holds, likewise: what is compared one by one grows with their square.
MOST = 400
#: Names a task remembers; what it forgets costs only shuffling.
REMEMBERED = 1_000_000
#: Columns that a signature's keys are dealt to, by their last bits: as many slices at most, so this is a power of 2.
LANES = 8
#: Keys of a slice, about: what is shuffled at a time.
SLICE = 32_000_000
#: Rows of names that are sent to every task.
SENT = 100_000
#: Bytes of sets that meet in the chunks of large blocks at a time, or four times those blocks, if that is more.
MET = 1 << 28
#: Up to this size a fourth of a set must be shared within signatures, so that a line many documents share ties no short ones.
SHORT = 160


def hashed_sets(w: Words, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each document; of the whole text if it has fewer words."""
    _, h = w.windows(n)
    counts = w.counts
    at = np.concatenate([[0], np.cumsum(np.maximum(counts - n + 1, 0))])
    short = np.flatnonzero((counts > 0) & (counts < n))
    whole = dict(zip(short.tolist(), ranges(w.hash, w.first[short], w.first[short + 1]))) if len(short) else {}
    return [np.array([whole[d]], np.uint64) if d in whole else np.unique(h[at[d] : at[d + 1]]) for d in range(len(counts))]


def set_id(s: np.ndarray) -> int:
    """A 64-bit name of a set (as signed)."""
    with np.errstate(over="ignore"):
        total = (mix(s + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64) + np.uint64(len(s))
        return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


class Node:
    __slots__ = ("part", "depth", "children", "low", "high", "ends", "above", "mark")

    def __init__(self, part: np.ndarray, depth: int, above: Node | None):
        self.part, self.depth, self.above = part, depth, above  # n-grams from the node above to here; how many end here
        self.children: dict[int, Node] = {}
        self.low, self.high = 1 << 62, 0  # sizes of the sets below
        self.ends: list[int] = []
        self.mark = -1  # the walk that has candidates below


def level(k: int) -> int:
    """How many n-grams of the signatures of two sets, of k n-grams or more, are shared if the sets are similar."""
    return 1 + max(min(k, SHORT) // 4, k // 20)


def alpha(k: int, percent: int) -> int:
    """How many n-grams a set of k shares with a similar one, at least."""
    return -(-percent * k // 100)


def left_out(k: int, percent: int) -> int:
    """How many n-grams of a set of k its signature leaves out."""
    return max(0, alpha(k, percent) - level(k))


class Block:
    """Sets that are added one by one, each joined with those before it. percent: Jaccard bound. Subclasses say which
    sets are candidates, compare them and remember them."""

    def __init__(self, percent: int):
        self.percent = percent
        self.sets: list[np.ndarray] = []
        self.sizes = np.zeros(64, np.int64)
        self.up: list[int] = []
        self.by_key: dict[int, list] = {}  # key -> [sets, how many]
        self.links: list[int] = []  # how often a set was linked to
        self.hub: dict[int, int] = {}  # group -> the set most often linked to

    def find(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            one, two = self.hub.pop(a, a), self.hub.pop(b, b)
            self.up[max(a, b)] = min(a, b)
            self.hub[min(a, b)] = one if self.links[one] >= self.links[two] else two

    def add(self, s: np.ndarray, keys: list[int], like: int = -1, compare: bool = True, keep: bool = True) -> int:
        """Adds a set and links it with the earlier ones; keys: the shared keys of its signature; like: a set known to
        be in its group. compare: whether it is linked; keep: whether later ones are linked with it, and if not, none of
        those is kept."""
        me, size = len(self.sets), len(s)
        near = self._candidates(size, keys) if compare else []
        self.sets.append(s)
        if me == len(self.sizes):
            self.sizes = np.resize(self.sizes, 2 * me)
        self.sizes[me] = size
        self.up.append(me)
        self.links.append(0 if keep else -1)  # so that a kept set stands for the group
        self._remember(me)
        if like >= 0:
            self.union(me, like)
        if near:
            # first the set of each group that most others were linked to: of a group, one link is enough
            self._walk(me, {self.hub.get(g, g): None for g in map(self.find, near) if g != self.find(me)})
            mine = self.find(me)
            if left := {x: None for x in near if self.find(x) != mine}:
                self._walk(me, left)
        if not keep:
            return me
        self._insert(me)
        for k in keys:
            held = self.by_key.get(k)
            if held is None:
                held = self.by_key[k] = [np.zeros(4, np.int32), 0]
            elif held[1] == len(held[0]):
                held[0] = np.resize(held[0], 2 * held[1])
            held[0][held[1]] = me
            held[1] += 1
        return me

    def _shared(self, keys: list[int]) -> np.ndarray | None:
        """How many keys each set has in common with these; None: none of them any."""
        held = [h[0][: h[1]] for k in keys if (h := self.by_key.get(k)) is not None]
        return np.bincount(np.concatenate(held), minlength=len(self.sets)) if held else None

    def _candidates(self, size: int, keys: list[int]) -> list[int]:
        raise NotImplementedError

    def _remember(self, me: int) -> None:
        """Called before set `me` is compared."""

    def _walk(self, me: int, wanted: dict[int, None]) -> None:
        """Links set `me` with those of wanted that are similar enough."""
        raise NotImplementedError

    def _insert(self, me: int) -> None:
        """Called once it was compared."""


class Tree(Block):
    """Prefix tree of sorted sets; keys are the shared n-grams of signatures."""

    def __init__(self, percent: int):
        super().__init__(percent)
        self.rests = np.zeros(64, np.int64)  # sizes less signatures
        self.at: list[Node] = []
        self.root = Node(np.zeros(0, np.uint64), 0, None)
        self.walks = 0

    def _remember(self, me: int) -> None:
        if me == len(self.rests):
            self.rests = np.resize(self.rests, 2 * me)
        self.rests[me] = left_out(len(self.sets[me]), self.percent)

    def _candidates(self, size: int, keys: list[int]) -> list[int]:
        if (shared := self._shared(keys)) is None:
            return []
        n, p = len(self.sets), self.percent
        sizes = self.sizes[:n]
        # what two sets share beyond both signatures lies beyond the one that ends first
        ok = (shared + np.maximum(self.rests[:n], left_out(size, p))) * (100 + p) >= p * (size + sizes)
        ok &= (shared > 0) & (100 * size >= p * sizes) & (100 * sizes >= p * size)
        return np.flatnonzero(ok).tolist()

    def _walk(self, me: int, wanted: dict[int, None]) -> None:
        self.walks += 1
        mark = self.walks
        for y in wanted:
            node = self.at[y]
            while node is not None and node.mark != mark:
                node.mark = mark
                node = node.above
        x, p = self.sets[me], self.percent
        n = len(x)
        front, shared = [self.root], np.zeros(1, np.int64)
        while front:  # a level of the tree at a time: its n-grams are looked up in x at once
            kids, above = [], []
            for i, node in enumerate(front):
                for c in node.children.values():
                    if c.mark == mark:
                        kids.append(c)
                        above.append(i)
            if not kids:
                break
            parts = np.concatenate([c.part for c in kids])
            ends = np.cumsum([len(c.part) for c in kids])
            hit = x[np.minimum(np.searchsorted(x, parts), n - 1)] == parts
            total = shared[above] + np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], ends[:-1]]))
            past = np.searchsorted(x, parts[ends - 1], side="right")
            # even if all that is left matched: shared >= p / (100 + p) * (n + size) is needed
            most = total + np.minimum(n - past, np.array([c.high - c.depth for c in kids]))
            kept = np.flatnonzero(most * (100 + p) >= p * (n + np.array([c.low for c in kids])))
            front, shared = [kids[k] for k in kept], total[kept]
            for node, have in zip(front, shared.tolist()):
                for y in node.ends:
                    if y in wanted and 100 * have >= p * (n + len(self.sets[y]) - have):
                        self.links[y] += 1
                        self.union(me, y)

    def _insert(self, me: int) -> None:
        s = self.sets[me]
        n = len(s)
        node, at = self.root, 0
        while True:
            node.low, node.high = min(node.low, n), max(node.high, n)
            if at == n:
                break
            child = node.children.get(int(s[at]))
            if child is None:
                child = node.children[int(s[at])] = Node(s[at:], n, node)
            else:
                k = min(len(child.part), n - at)
                differ = np.flatnonzero(child.part[:k] != s[at : at + k])
                k = int(differ[0]) if len(differ) else k
                if k < len(child.part):  # split
                    upper = Node(child.part[:k], child.depth - len(child.part) + k, node)
                    upper.low, upper.high = child.low, child.high
                    child.part, child.above = child.part[k:], upper
                    upper.children[int(child.part[0])] = child
                    node.children[int(upper.part[0])] = upper
                    child = upper
            node, at = child, at + len(child.part)
        node.ends.append(me)
        self.at.append(node)


def dealt(keys: np.ndarray) -> list[bytes]:
    """The keys of each lane."""
    lane = (keys & np.uint64(LANES - 1)).astype(np.int64)
    order = np.argsort(lane, kind="stable")
    at = np.concatenate([[0], np.cumsum(np.bincount(lane, minlength=LANES))]).tolist()
    keys = keys[order]
    return [keys[a:b].tobytes() for a, b in zip(at, at[1:])]


class Prefixes:
    """Keys of a set: the n-grams of its signature; sets are compared in a prefix tree."""

    def __init__(self, percent: int):
        self.percent = percent

    def keys(self, s: np.ndarray) -> np.ndarray:
        return s[: len(s) - left_out(len(s), self.percent)]

    def least(self, n: Column) -> Column:
        """How many keys a set of n n-grams shares with a similar one."""
        smallest = F.ceil(n * self.percent / 100)  # a partner's set
        return (1 + F.greatest(F.floor(F.least(smallest, F.lit(SHORT)) / 4), F.floor(smallest / 20))).cast("int")

    def block(self) -> Block:
        return Tree(self.percent)


def _pivots(table: pa.Table) -> pa.Table:
    """(pivot, root) of the pivots of a block, tied by pairs (b, p): at most the square of some 64."""
    forest = Forest()
    for a, b in zip(table.column("b").to_pylist(), table.column("p").to_pylist()):
        forest.union(a, b)
    return pa.table([pa.array(c, pa.int64()) for c in forest.edges()], names=["p", "root"])


def meetings(rest: DataFrame, turns: int, k: int) -> DataFrame:
    """What meets in turn k of `turns`: each query chunk (sets outside the main group, `asks`) of a block, numbered `ask`, and
    every chunk `to` of the block. rest: sets (block, sid, label, items, keys, weight) with their chunk q of c, the block's main
    label and its number r of query chunks. A query chunk and the block it meets belong to one turn."""
    wide = ["block", "ask", "to", "sid", "label", "asks", "items", "keys", "weight"]
    first = F.pmod(F.pmod(F.xxhash64("block"), F.lit(turns)) + k, F.lit(turns))  # of the block's query chunks in this turn
    asks = rest.filter("label <> main").withColumn("ask", F.pmod(F.xxhash64("sid", F.lit(11)), F.col("r"))).filter(F.pmod("ask", F.lit(turns)) == first)
    told = rest.withColumn("ask", F.explode(F.when(first < F.col("r"), F.sequence(first, F.col("r") - 1, F.lit(turns).cast("long")))))
    return asks.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("c") - 1))).withColumn("asks", F.lit(True)).select(*wide).union(told.withColumn("to", F.col("q")).withColumn("asks", F.lit(False)).select(*wide))


def linked(
    docs: DataFrame, n: int = 5, percent: int = 80, chunk: int = CHUNK, most: int = MOST, method: Prefixes | None = None, slice_keys: int = SLICE, sent: int = SENT, met: int = MET
) -> DataFrame:
    """(_id, _th, n_shingles, component) of each row of docs (doc_id, text): the size of its set of word n-grams (A-Z
    lower-cased, words `[^\\x20\\x09-\\x0D]+`; fewer words: the whole sequence as one) and the smallest _id that links
    lead to. Two sets are linked if 100 * intersection >= percent * union. _id is doc_id, null as the smallest long, which
    names a component only where all its ids are null; _th is a hash of the text. method: how sets are keyed and compared.
    slice_keys: keys that are shuffled at a time, as far as LANES slices reach; sent: rows of names sent to every task at a time;
    met: bytes of sets that meet in the chunks of large blocks at a time.

    Null text or no words: empty set, linked with nothing. Rows that repeat or share a doc_id: one row each; equal sets
    are one set. Empty table: no rows. Very long texts: one set at a time is held. Other columns are left out.
    """
    spark = docs.sparkSession
    method = method or Prefixes(percent)
    slim = keyed(docs).select("_id", "_th", "text")
    lanes = [f"part{k}" for k in range(LANES)]

    @frugal
    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal sets of a task give one signature
        for batch in batches:
            ids, ths = batch.column("_id"), batch.column("_th")
            if len(seen) > REMEMBERED:
                seen.clear()
            for a, b, w in words(batch.column("text"), SPACED, lower=True):
                size, sids, count, parts = [], [], [], []
                for s in hashed_sets(w, n):
                    sid = set_id(s) if len(s) else None
                    size.append(len(s))
                    sids.append(sid)
                    new = sid is not None and sid not in seen
                    seen.add(sid)
                    keys = method.keys(s) if new else None
                    count.append(len(keys) if new else None)
                    parts.append(dealt(keys) if new else [None] * LANES)
                cols = [ids.slice(a, b - a), ths.slice(a, b - a), pa.array(size, pa.int32()), pa.array(sids, pa.int64()), pa.array(count, pa.int32())]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(c, pa.binary()) for c in zip(*parts))], ["_id", "_th", "n", "sid", "n_keys", *lanes])

    @frugal
    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                parts = some.column("part").to_pylist()
                sizes = [len(x) // 8 for x in parts]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.frombuffer(b"".join(parts), np.int64)), pa.array(np.repeat(some.column("sid").to_numpy(), sizes)), pa.array(np.repeat(some.column("n").to_numpy(), sizes))
                ], ["key", "sid", "n"])

    parted = stored(slim.mapInArrow(names, "_id long, _th long, n int, sid long, n_keys int, " + ", ".join(f"{c} binary" for c in lanes)), "parts")
    named = stored(parted.select("_id", "_th", "n", "sid"), "sets")

    def slices(total: int) -> int:
        """How many slices keys are shuffled in, one after the other, so that the disk holds the shuffles of one."""
        out = 1
        while out < LANES and total > out * slice_keys:
            out *= 2
        return out

    def listed(signed: DataFrame) -> DataFrame:
        """(sid, n, keys) of (key, sid, n): the keys that other sets have too, with how many have them."""
        shared = stored(signed.groupBy("key").agg(F.min("sid").alias("a"), F.max("sid").alias("b"), F.count("*").alias("df")).filter("a <> b").select("key", "df"), "keys")
        out = stored(signed.join(shared, "key").groupBy("sid").agg(F.first("n").alias("n"), F.collect_set(F.struct("df", "key")).alias("keys")), "lists")
        discard(shared)
        return out

    def rarest(lists: list[DataFrame], least: Column) -> DataFrame:
        """(sid, keys, ties, weight) of the sets that share at least `least` keys: the keys, rarest first, those of them that
        tie, and how often all occur."""
        whole_lists = reduce(DataFrame.union, lists).groupBy("sid").agg(F.first("n").alias("n"), F.sort_array(F.flatten(F.collect_list("keys"))).alias("keys"))
        rare = whole_lists.filter(F.size("keys") >= least).select("sid", F.expr("transform(keys, x -> x.key)").alias("keys"), least.alias("least"), F.expr("aggregate(keys, 0L, (total, x) -> total + x.df)").alias("weight"))
        rare = stored(rare.select("sid", "keys", F.slice("keys", F.lit(1), F.size("keys") - F.col("least") + 1).alias("ties"), "weight"), "candidates")
        discard(*lists)
        return rare

    lists, turns = [], slices(parted.agg(F.sum("n_keys")).first()[0] or 0)
    for k in range(turns):
        lists.append(listed(parted.filter("n_keys is not null").select(F.concat(*lanes[k::turns]).alias("part"), "sid", "n").mapInArrow(opened, "key long, sid long, n int")))
    discard(parted)
    rare = rarest(lists, method.least(F.col("n")))

    @frugal
    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets of a task that share a key: edges (a, b) to one of each group, and (key, that one), so that a key sends
        few rows however many sets have it."""
        forest, of = Forest(), {}

        def told() -> Iterator[pa.RecordBatch]:
            a, b = forest.edges()
            none = [None] * len(a)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (none, a, b)], ["key", "a", "b"])
            held = [forest.find(x) for x in of.values()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(of), held, held)], ["key", "a", "b"])

        for batch in batches:
            for sid, keys in zip(batch.column("sid").to_pylist(), batch.column("ties").to_pylist()):
                for k in keys:
                    if (other := of.setdefault(k, sid)) != sid:
                        forest.union(sid, other)
            if len(of) > REMEMBERED:
                yield from told()
                forest, of = Forest(), {}
        yield from told()

    def tied(rare: DataFrame) -> DataFrame:
        """(sid, block) of the sets that share a tying key with another one."""
        ties = stored(rare.select("sid", "ties").mapInArrow(tie, "key long, a long, b long"), "ties")
        by_key = ties.filter("key is not null").select("key", F.col("a").alias("x")).distinct()
        centres = by_key.groupBy("key").agg(F.min("x").alias("m"), F.max("x").alias("z")).filter("m <> z").select("key", "m")
        across = by_key.join(centres, "key").filter("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b"))
        found = components(ties.filter("key is null").select("a", "b").union(across))
        found = stored(found.select(F.col("node").alias("sid"), F.col("label").alias("block")), "blocks")
        discard(ties)
        return found

    blocks = tied(rare)

    # the whole sets of candidates, from one document of each
    one = stored(named.filter("sid is not null").groupBy("sid").agg(F.min(F.struct("_id", "_th")).alias("row")).select("sid", "row.*").join(blocks, "sid"), "ones")

    @frugal
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids, blocks = batch.column("sid").to_pylist(), batch.column("block")
            for a, b, w in words(batch.column("text"), SPACED, lower=True):
                sets = hashed_sets(w, n)
                ok = [d for d, s in enumerate(sets) if len(s) and set_id(s) == sids[a + d]]
                cols = [blocks.take(pa.array([a + d for d in ok], pa.int64())), pa.array([sids[a + d] for d in ok], pa.int64()), pa.array([sets[d].tobytes() for d in ok], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["block", "sid", "items"])

    # the texts stay where they are as long as a slice of the names can be sent to them; else they are shuffled slice by slice
    rows = one.count()
    turns = max(1, min(LANES, -(-rows // sent)))
    turn = F.pmod(F.xxhash64("_id", "_th", F.lit(5)), F.lit(turns))
    picked = []
    for k in range(turns):
        mine = one.filter(turn == k)
        found = slim.filter(turn == k).join(F.broadcast(mine) if rows <= sent * turns else mine, ["_id", "_th"]).select("text", "sid", "block")
        picked.append(stored(found.mapInArrow(whole, "block long, sid long, items binary").dropDuplicates(["sid"]).join(rare.drop("ties"), "sid"), "whole"))
    sets = reduce(DataFrame.union, picked)
    discard(rare, blocks, one)

    @frugal
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets in the order of their group, those that share most first; one tree a group. Yields each set and the one
        that stands for those it is linked to; of sets with a label, only the pairs of labels that links joined. Those that
        ask (pivot) come after those of a chunk, which have met before."""

        def settle(group: int, block: int, tree: Block, sids: list[int], labels: list, pivots: list[bool]) -> pa.RecordBatch:
            roots = [tree.find(i) for i in range(len(sids))]
            if labels[0] is None:
                rows = [(sid, sids[r], p) for sid, r, p in zip(sids, roots, pivots)]
            else:
                rows = sorted({(a, labels[r], False) for a, r in zip(labels, roots) if a != labels[r]})
            b, a, p = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array([group] * len(b), pa.int64()), pa.array([block] * len(b), pa.int64()), pa.array(b, pa.int64()), pa.array(a, pa.int64()), pa.array(p, pa.bool_())], ["g", "block", "b", "a", "pivot"])

        group, tree, sids, labels, pivots, first = None, method.block(), [], [], [], {}
        for batch in batches:
            for g, in_block, sid, label, pivot, items, keys in zip(*(batch.column(c).to_pylist() for c in ("g", "block", "sid", "label", "pivot", "items", "keys"))):
                if g != group:
                    if sids:
                        yield settle(group, block, tree, sids, labels, pivots)
                    group, block, tree, sids, labels, pivots, first = g, in_block, method.block(), [], [], [], {}
                me = tree.add(np.frombuffer(items, np.uint64), keys, first.get(label, -1) if label is not None else -1, label is None or pivot, label is None or not pivot)
                sids.append(sid)
                labels.append(label)
                pivots.append(pivot)
                if label is not None:
                    first.setdefault(label, me)
        if sids:
            yield settle(group, block, tree, sids, labels, pivots)

    def joined(rows: DataFrame) -> DataFrame:
        parts = parallelism(spark)
        return rows.repartition(parts, "g").sortWithinPartitions("g", F.col("label").isNotNull() & F.col("pivot"), F.desc("weight"), "sid").select("g", "block", "sid", "label", "pivot", "items", "keys").mapInArrow(join, "g long, block long, b long, a long, pivot boolean")

    def oversized(sets: DataFrame) -> DataFrame:
        """(block, size, bytes) of the blocks that one tree doesn't hold: few, as each has many sets or many bytes."""
        sizes = sets.groupBy("block").agg(F.count("*").alias("size"), F.sum(F.length("items")).alias("bytes"))
        return stored(sizes.filter((F.col("bytes") > chunk) | (F.col("size") > most)), "over")

    def by_block(sets: DataFrame) -> DataFrame:
        return stored(joined(sets.select(F.xxhash64("block").alias("g"), "block", "sid", none, no, "items", "keys", "weight")), "links")

    none, no = F.lit(None).cast("long").alias("label"), F.lit(False).alias("pivot")
    over = oversized(sets)
    small = [by_block(sets.join(F.broadcast(over), "block", "left_anti"))]

    if large_bytes := over.agg(F.sum("bytes")).first()[0]:
        # Large blocks, as common passages make them: tied anew by the n-grams of whole sets, of which similar ones share most.
        wide = sets.join(F.broadcast(over.select("block")), "block")
        lists, turns = [], slices(large_bytes // 8)
        for k in range(turns):
            items = wide.select(F.col("items").alias("part"), "sid", (F.length("items") / 8).cast("int").alias("n")).mapInArrow(opened, "key long, sid long, n int")
            lists.append(listed(items.filter(F.pmod("key", F.lit(turns)) == k)))
        rarer = rarest(lists, F.ceil(F.col("n") * percent / 100).cast("int"))
        parts = tied(rarer)
        cut = stored(wide.join(parts.withColumnRenamed("block", "part"), "sid").withColumn("block", F.xxhash64("block", "part")).drop("part"), "cut")
        discard(rarer, parts, over, *picked)
        over, picked = oversized(cut), [cut]
        small.append(by_block(cut.join(F.broadcast(over), "block", "left_anti")))
    labels = reduce(DataFrame.union, small).select(F.col("b").alias("sid"), F.col("a").alias("label"))

    if over.limit(1).count():
        # Blocks that are still large: chunks by hash, each with the same few pivots, which tie the groups of the chunks together; then
        # the sets outside the largest group so far against all chunks, so that no pair of sets in different groups is left out.
        large = stored(cut.join(F.broadcast(over), "block").withColumn("c", F.ceil(2 * F.greatest(F.col("bytes") / chunk, F.col("size") / most)).cast("int")).withColumn("h", F.xxhash64("sid", F.lit(7))).withColumn("q", F.pmod("h", "c").cast("int")), "large")
        pivot = F.floor(F.pmod(F.col("h"), F.lit(2**40)) * F.col("size") / 2**40) < 64  # about 64 of a block
        spread = large.withColumn("pivot", pivot).withColumn("q", F.explode(F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("c") - 1)).otherwise(F.array("q"))))
        first = stored(joined(spread.select(F.xxhash64("block", "q").alias("g"), "block", "sid", none, "pivot", "items", "keys", "weight")), "links")
        held = first.filter("pivot").groupBy("block", "g", "a").agg(F.min("b").alias("p"))
        pairs = first.filter("pivot").join(held, ["block", "g", "a"]).filter("b <> p").select("block", "b", "p").distinct()
        roots = pairs.groupBy("block").applyInArrow(_pivots, "p long, root long")
        heads = stored(held.join(roots, "p", "left").select("g", "a", F.coalesce("root", "p").alias("head")), "heads")
        groups = first.join(heads, ["g", "a"], "left").groupBy(F.col("b").alias("sid")).agg(F.min(F.coalesce("head", "a")).alias("label"))
        marked = stored(large.join(groups, "sid"), "marked")
        discard(large, first, heads)
        count = marked.groupBy("block", "label").agg(F.count("*").alias("k"))
        main = stored(count.groupBy("block").agg(F.max(F.struct("k", "label")).alias("top")).select("block", F.col("top.label").alias("main"), F.col("top.k").alias("main_size")), "main")
        rest = marked.join(F.broadcast(main), "block").withColumn("r", F.ceil(F.col("c") * (F.col("size") - F.col("main_size")) / F.col("size"))).filter("r > 0")
        # each set of the main group meets r query chunks, the others c chunks besides: turn by turn, so that the disk holds the shuffle of one
        width = F.length("items") + 8 * F.size("keys")
        all_met, once = rest.agg(F.sum(width * (F.col("r") + F.when(F.col("label") != F.col("main"), F.col("c")).otherwise(0))), F.sum(width)).first()
        turns = -(-(all_met or 0) // max(met, 4 * (once or 0)))
        second = [stored(contracted(joined(meetings(rest, turns, k).select(F.xxhash64("block", "ask", "to").alias("g"), "block", "sid", "label", F.col("asks").alias("pivot"), "items", "keys", "weight")).select("a", "b")), "met") for k in range(turns)]
        found = marked.select("sid", "label")
        if second:
            final = stored(components(reduce(DataFrame.union, second)).select(F.col("node").alias("label"), F.col("label").alias("final")), "final")
            found = found.join(final, "label", "left").select("sid", F.coalesce("final", "label"))
            discard(*second)
        labels = labels.union(found)

    group = F.coalesce("label", "sid")
    rows = stored(named.join(labels, "sid", "left").withColumn("group", group).select("_id", "_th", "n", "group"), "grouped")
    known = F.when(F.col("_id") != F.lit(NO_ID), F.col("_id"))
    least = stored(rows.filter("group is not null").groupBy("group").agg(F.min(known).alias("least")), "least")
    discard(named, over, *small, *picked)
    return rows.join(least, "group", "left").select("_id", "_th", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "_id").alias("component"))


def with_ids(found: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of what linked() found, with doc_id as it came."""
    back = lambda c: F.when(F.col(c) == F.lit(NO_ID), F.lit(None).cast("long")).otherwise(F.col(c))
    return found.select(back("_id").alias("doc_id"), "n_shingles", back("component").alias("component_id"))


def ngram_groups(docs: DataFrame, n: int = 5, percent: int = 80, chunk: int = CHUNK, most: int = MOST) -> DataFrame:
    """(doc_id, n_shingles, component_id): linked() with doc_id as it came. component_id is null only where no row of the
    component has a doc_id."""
    return with_ids(linked(docs, n, percent, chunk, most))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with the columns it came with, only the rows whose doc_id is the smallest of its group; rows of a group that
    share that doc_id stay together, and so do those of a group without any doc_id."""
    found = linked(docs, n, percent).filter("_id <> component").select("_id", "_th").distinct()
    a, b = fresh(docs, "other_id", "other_text")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    others = stored(found.select(F.col("_id").alias(a), F.col("_th").alias(b)), "others")
    # those that go are few as a rule: sent to the texts, they leave them where they are
    return docs.join(F.broadcast(others) if others.count() <= SENT else others, (key == F.col(a)) & (F.xxhash64("text") == F.col(b)), "left_anti")
