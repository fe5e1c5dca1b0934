"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

Words are lower-cased (A-Z) runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. Training words stream through the automaton,
which tracks the longest match that ends at each word; a match of at least `window` words lies in an item's windows,
and its words are hit. The automaton is built for blocks of items of bounded size, so what is sent to tasks is bounded.
Where there are more blocks than one, a first pass over the documents keeps the stretches of words whose neighbours are
neighbours in some item (by a bit table of fixed size, so a few others too), and each block's automaton streams only
those; what a block found is written before the next begins.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrail.llm.common import bounded, fresh, frugal, scratch, stored
from kinetrail.llm.words import ALNUM, Words, mix, words

#: Most words of items in one automaton.
BLOCK = 200_000
#: Bits (a power of two) of the table that says which words, or pairs of them, some item may hold.
BITS = 1 << 27


def runs_within(w: Words, ok: np.ndarray, extra: int, least: int) -> list[tuple[int, int, int]]:
    """(document, from, to) of runs of ok within documents, `extra` words longer than the run, of at least `least` words."""
    begins = np.zeros(len(w.hash) + 1, bool)
    begins[w.first] = True  # no run goes on into the next document
    begins = begins[: len(ok) + 1]
    at, before = np.append(ok, False), np.append(False, ok)
    edge = np.stack([np.flatnonzero(at & (~before | begins)), np.flatnonzero(before & (~at | begins))], axis=1)
    edge = edge[edge[:, 1] - edge[:, 0] + extra >= least]
    return [(int(w.doc[a]), int(a), int(b) + extra) for a, b in edge]


class Automaton:
    """Suffix automaton of several word sequences, given as (item, hashes of its words)."""

    def __init__(self, items: list[tuple[str | None, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.len = [0]
        for _, ws in items:
            last = 0
            for c in ws:
                last = self._extend(last, c)
        # the items whose window (or whole short item) ends at a state, by the window's length
        self.owners: dict[int, dict[int, set]] = {}
        self.short: set[int] = set()
        pairs: set[tuple[int, int]] = set()
        for item, ws in items:
            k = min(window, len(ws))
            pairs.update(zip(ws, ws[1:]))
            if k < window:
                self.short.add(k)
            state = length = 0
            for n, c in enumerate(ws):
                state, length = self.next[state][c], length + 1
                if n + 1 >= k:
                    self.owners.setdefault(self._of(state, k), {}).setdefault(k, set()).add(item)
        self.least = min([window, *self.short])
        self.words = np.array(sorted({c for _, ws in items for c in ws}), np.uint64)
        self.pairs = np.unique(self._pair(np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.uint64)))

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a * np.uint64(0x9E3779B97F4A7C15) ^ b

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def _of(self, state: int, k: int) -> int:
        """The state of the last k words of what leads to state."""
        while self.len[self.link[state]] >= k:
            state = self.link[state]
        return state

    def stretches(self, w: Words) -> list[tuple[int, int, int]]:
        """(document, from, to) of stretches of words of w all of whose neighbours are neighbours in some item, at least
        as long as the shortest window; no other word can be hit."""
        h = w.hash
        if len(h) < self.least or not len(self.words):
            return []
        if self.least == 1:
            start = np.flatnonzero(np.isin(h, self.words))
            return [(int(w.doc[i]), int(i), int(i) + 1) for i in start] if not len(self.pairs) else runs_within(w, np.isin(h, self.words), 0, self.least)
        p = self._pair(h[:-1], h[1:])
        at = np.minimum(np.searchsorted(self.pairs, p), len(self.pairs) - 1)
        return runs_within(w, (self.pairs[at] == p) & (w.doc[:-1] == w.doc[1:]), 1, self.least)

    def stream(self, ws: list[int], breaks: np.ndarray | None = None) -> tuple[list[tuple[int, int]], set]:
        """Hit intervals [from, to) of word numbers, and the items whose windows occur."""
        nxt, link, length, window, owners = self.next, self.link, self.len, self.window, self.owners
        state = run = 0
        hits, items = [], set()
        for n, c in enumerate(ws):
            while state and c not in nxt[state]:
                state = link[state]
                run = length[state]
            if c in nxt[state]:
                state, run = nxt[state][c], run + 1
            else:
                state = run = 0
                continue
            if run >= window:
                hits.append((n + 1 - run, n + 1))
                items |= owners[self._of(state, window)][window]
            for k in self.short:
                if run >= k and (mine := owners.get(self._of(state, k), {}).get(k)):
                    hits.append((n + 1 - k, n + 1))
                    items |= mine
        return hits, items


def item_words(texts: pa.Array) -> list[list[int]]:
    out = []
    for _, _, w in words(texts, ALNUM, lower=True):
        out += [w.hash[w.first[d] : w.first[d + 1]].tolist() for d in range(len(w.first) - 1)]
    return out


def item_blocks(benchmark: DataFrame, window: int, block: int) -> Iterator[list[tuple[str | None, list[int]]]]:
    """Items (item_id as string, hashes of words) in blocks of at most block words; a longer item is cut into parts
    that overlap by window - 1 words, which keeps all its windows."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, ws in zip(batch.column("item").to_pylist(), item_words(batch.column("text"))):
                step = block - window + 1
                for a in range(0, max(1, len(ws) - window + 1), step):
                    if part := ws[a : a + block]:
                        rows.append((item, np.array(part, np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["item", "words"])

    parts = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).mapInArrow(run, "item string, words array<long>")
    have, size = [], 0
    for r in parts.toLocalIterator():  # at most a block is held here at once
        if size + len(r["words"]) > block and have:
            yield have
            have, size = [], 0
        have.append((r["item"], [x & 0xFFFFFFFFFFFFFFFF for x in r["words"]]))
        size += len(r["words"])
    if have:
        yield have


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, block: int = BLOCK, cut: bool = False, names: tuple[str, str, str] = ("_n_words", "_spans", "_items")) -> DataFrame:
    """docs' columns and, as `names`, (_n_words long, _spans array<struct<start, stop>>, _items array<string>): the number of
    words, the maximal hit intervals of word numbers, and the sorted ids of items with occurring windows. A window is
    `window` consecutive words of an item; an item of fewer words, but not none, is one window.

    Null or wordless text: 0 words, no hits. Null item_id: its words hit, it is not listed. Null or empty benchmark:
    no hits. cut: the hit spans are left out of `text`. Equal items are all listed. Rows of docs that repeat fare alike, null
    ids like others. Columns of docs keep their names and values; one named like an added column is an error.
    Benchmarks of one block: no shuffle, one pass over the documents. More blocks: the documents are read once and written
    with their stretches, every block reads the stretches alone, and what they found is joined to the rows.
    """
    if clash := [n for n in names if n.lower() in {c.lower() for c in docs.columns}]:
        raise ValueError(f"docs has columns named like added ones: {', '.join(clash)}")
    n_words, spans_of, items_of = names
    (stretches,) = fresh(docs, "_stretches")
    have = bounded(docs)
    blocks = item_blocks(benchmark, window, block)
    items, after = next(blocks, []), next(blocks, None)
    added = have.withColumns({n_words: F.lit(-1).cast("long"), spans_of: F.array().cast("array<struct<start: int, stop: int>>"), items_of: F.array().cast("array<string>")})
    schema = added.schema

    def finished(batch: pa.RecordBatch, n: np.ndarray, hit: dict[int, list], items: dict[int, set]) -> pa.RecordBatch:
        spans = [_merge(hit[i]) if i in hit else [] for i in range(batch.num_rows)]
        held = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
        if cut and any(spans):
            held["text"] = pa.array([_without(t, x) if x else t for t, x in zip(held["text"].to_pylist(), spans)], pa.string())
        held[n_words] = pa.array(n, pa.int64())
        held[spans_of] = pa.array([[{"start": x, "stop": y} for x, y in s] for s in spans], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
        held[items_of] = pa.array([sorted(items.get(i, set()) - {None}) for i in range(batch.num_rows)], pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([held[c] for c in schema.names], names=schema.names)

    if after is None:
        sent = docs.sparkSession.sparkContext.broadcast(Automaton(items, window))  # at most `block` words: bounded

        @frugal
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = sent.value
            for batch in batches:
                n, hit, items = np.zeros(batch.num_rows, np.int64), {}, {}
                for a, b, w in words(batch.column("text"), ALNUM, lower=True):
                    n[a:b] = w.counts
                    for d, x, y in m.stretches(w):
                        hits, found = m.stream(w.hash[x:y].tolist())
                        if hits:
                            off = x - int(w.first[d])
                            hit.setdefault(a + d, []).extend((p + off, q + off) for p, q in hits)
                            items.setdefault(a + d, set()).update(found)
                yield finished(batch, n, hit, items)

        return have.mapInArrow(run, schema)

    kept, row = _kept(have, benchmark, window, block, n_words, stretches)
    found, k = f"{scratch(docs.sparkSession)}/found-{uuid.uuid4().hex}", 0
    asked = kept.filter(F.size(stretches) > 0).select(row, stretches)
    while items is not None:
        _stream_block(asked, items, window, row, stretches).write.mode("append").parquet(found)
        items, after = after, next(blocks, None)
    hits = docs.sparkSession.read.schema(HITS.format(row)).parquet(found).groupBy(row).agg(F.flatten(F.collect_list("spans")).alias("_all_spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("_all_items"))
    joined = kept.drop(stretches).join(hits, row, "left").select(*[F.col(f"`{c}`") for c in docs.columns], n_words, F.col("_all_spans").alias(spans_of), F.col("_all_items").alias(items_of))

    @frugal
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index
            hit = {i: [(x["start"], x["stop"]) for x in v] for i, v in enumerate(batch.column(at(spans_of)).to_pylist()) if v}
            items = {i: set(v) for i, v in enumerate(batch.column(at(items_of)).to_pylist()) if v}
            yield finished(batch, batch.column(at(n_words)).to_numpy(), hit, items)

    return joined.mapInArrow(finish, schema)


#: What a block's automaton found in a row of the documents.
HITS = "{} long, spans array<struct<start: int, stop: int>>, items array<string>"


def _bits(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether table has the bit of each hash."""
    k = mix(h) & np.uint64(BITS - 1)
    return (table[(k >> np.uint64(3)).astype(np.int64)] >> (k & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _kept(docs: DataFrame, benchmark: DataFrame, window: int, block: int, n_words: str, stretches: str) -> tuple[DataFrame, str]:
    """docs, written, with a row number, the number of words, and the stretches (from, words) that some item may hold; the
    row number's name."""
    table, least = np.zeros(BITS // 8, np.uint8), window
    for items in item_blocks(benchmark, window, block):
        least = min([least, *(len(ws) for _, ws in items)])
    single = least == 1  # then words count by themselves, else neighbours
    for items in item_blocks(benchmark, window, block):
        held = [np.array(ws, np.uint64) for _, ws in items]
        h = np.concatenate(held if single else [Automaton._pair(w[:-1], w[1:]) for w in held])
        k = mix(h) & np.uint64(BITS - 1)
        np.bitwise_or.at(table, (k >> np.uint64(3)).astype(np.int64), np.uint8(1) << (k & np.uint64(7)).astype(np.uint8))
    sent = docs.sparkSession.sparkContext.broadcast(table)  # BITS / 8 bytes
    (row,) = fresh(docs, "_row")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            n, out = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
            for a, b, w in words(batch.column(batch.schema.names.index("text")), ALNUM, lower=True):
                n[a:b] = w.counts
                h = w.hash
                if len(h) < least:
                    continue
                ok = _bits(h, bits) if single else _bits(Automaton._pair(h[:-1], h[1:]), bits) & (w.doc[:-1] == w.doc[1:])
                for d, x, y in runs_within(w, ok, 0 if single else 1, least):
                    out[a + d].append({"at": x - int(w.first[d]), "words": h[x:y].view(np.int64)})
            kind = pa.list_(pa.struct([("at", pa.int32()), ("words", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(out, kind)], names=[*batch.schema.names, n_words, stretches])

    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    part = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("words", T.ArrayType(T.LongType()))])
    schema = T.StructType([*numbered.schema.fields, T.StructField(n_words, T.LongType()), T.StructField(stretches, T.ArrayType(part))])
    return stored(numbered.mapInArrow(run, schema), "stretches"), row


def _stream_block(asked: DataFrame, items: list[tuple[str | None, list[int]]], window: int, row: str, stretches: str) -> DataFrame:
    """(row, spans, items) of the rows in whose stretches windows of items occur."""
    sent = asked.sparkSession.sparkContext.broadcast(Automaton(items, window))  # at most a block of words: bounded

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            for i, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans, found = [], set()
                for p in parts:
                    hits, its = m.stream([x & 0xFFFFFFFFFFFFFFFF for x in p["words"]])
                    spans += [{"start": a + p["at"], "stop": b + p["at"]} for a, b in hits]
                    found |= its
                if spans:
                    for c, v in zip(out, (i, spans, sorted(found - {None}))):
                        c.append(v)
            kinds = (pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[row, "spans", "items"])

    return asked.mapInArrow(run, HITS.format(row))


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    raw = np.frombuffer(text.encode(), np.uint8)
    w = Words(raw, np.array([0, len(raw)]), ALNUM, True)
    parts, at = [], 0
    for x, y in spans:
        parts.append(raw[at : w.start[x]].tobytes())
        at = int(w.end[y - 1])
    return b"".join([*parts, raw[at:].tobytes()]).decode()


def _merge(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def judged(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated): contaminated if words are hit and they are at least
    one in `share`."""
    found = contamination(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), benchmark, window)
    n_hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda acc, x: acc + (x["stop"] - x["start"]))
    rows = found.select("doc_id", F.col("_n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"))
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """docs with the columns it came with: a document at or above the share goes; from another the hit spans are cut
    out of the text, at the bytes between words, and the rest stays as it was. Cases as in contamination()."""
    names = tuple(fresh(docs, "_n_words", "_spans", "_items"))
    found = contamination(docs, benchmark, window, cut=True, names=names)
    n_hit = F.aggregate(names[1], F.lit(0).cast("long"), lambda acc, x: acc + (x["stop"] - x["start"]))
    return found.filter((n_hit == 0) | (n_hit * share < F.col(names[0]))).select(*[F.col(f"`{c}`") for c in docs.columns])
