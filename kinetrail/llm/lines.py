"""Line dedup by a deletion-neighbourhood join over words.

A line is removed if a line that starts earlier (smaller doc_id, or same document and earlier) is the same, or within one
word edit (a word added, dropped or replaced) and both have at least `fuzzy` words. The variants of a line are the line
itself and the line without its i-th word. Two lines are within one edit exactly if they share a variant without the same
i (a replaced word), or one's variant is the other line (an added word); so variants are keyed by hash and i, and the
earliest line of a key settles all others of it, without pairs.

Two such lines also agree on their first or on their last half. Halves are counted first, and only lines that share a
half with another line emit variants, those within the other half.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetrail.llm.common import fresh, frugal, keyed, stored
from kinetrail.llm.words import BASE, INVERSE, SPACED, Words, mix, powers, texts

NEWLINE = 10
#: Variants a task remembers; what it forgets costs only shuffling.
REMEMBERED = 300_000


class Lines:
    """The lines of some documents: first (word number at which each starts, and the total), doc, number (of the line in
    its document), over words w."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        breaks = np.flatnonzero(data == NEWLINE)
        starts = np.union1d(offsets[:-1], breaks + 1)
        starts = starts[starts < len(data)] if len(data) else starts[:0]
        # a document that is empty has no line; one that ends in a line break has none after it
        self.w = Words(data, np.unique(np.concatenate([starts, [len(data)]])) if len(data) else np.array([0]), SPACED, False)
        self.doc = np.searchsorted(offsets, starts, side="right") - 1
        self.number = np.arange(len(starts)) - np.searchsorted(self.doc, self.doc)
        self.first = self.w.first

    def sums(self) -> np.ndarray:
        h = self.w.hash
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * powers(INVERSE, len(h)), out=total[1:])
        return total


def grouped(column: pa.Array, size: int = 1 << 18) -> Iterator[tuple[int, int, Lines]]:
    data, offsets = texts(column)
    a, n = 0, len(column)
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, b, Lines(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        a = b


def part(total: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unmixed hash of words a..b: sum of word[i] * BASE**(b - i)."""
    return (total[b] - total[a]) * powers(BASE, len(total))[b]


def half_keys(total: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """For each line of words a..b four keys: first and last half as a line of its own length, and as one of one word
    less. The length and the half are part of the key."""
    n = b - a
    out = []
    for length in (n, n - 1):
        h = length // 2
        mark = (length * 2).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        out.append(mix(part(total, a, a + h) + mark))
        out.append(mix(part(total, b - (length - h), b) + mark + np.uint64(0x165667B19E3779F9)))
    return out


def whole_keys(total: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(part(total, a, b) + np.uint64(1))


def variants(total: np.ndarray, a: int, b: int, lo: int, hi: int) -> np.ndarray:
    """Whole keys of words a..b without word i, for lo <= i < hi."""
    i = np.arange(lo, hi)
    front = (total[i] - total[a]) * powers(BASE, len(total))[b - 1]  # words before i lie one place nearer to the end
    back = (total[b] - total[i + 1]) * powers(BASE, len(total))[b]
    return mix(front + back + np.uint64(1))


def duplicate_lines(docs: DataFrame, least: int = 5, fuzzy: int = 8) -> DataFrame:
    """(_id, _th, line, first_id, first_line) of every line that goes, with the earlier line it repeats or nearly repeats.
    Lines with fewer than `least` words never go; see dedup_lines() for the cases."""
    base = keyed(docs)
    slim = base.select("_id", "_th", "text")

    def keys(li: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(line number among li, key, whole key, is it the whole key) of what is counted."""
        total = li.sums()
        a, b = li.first[:-1], li.first[1:]
        ok = np.flatnonzero(b - a >= least)
        e = whole_keys(total, a[ok], b[ok])
        far = np.flatnonzero((b - a)[ok] >= fuzzy)
        halves = half_keys(total, a[ok][far], b[ok][far])
        rows = np.concatenate([ok, *[ok[far]] * 4])
        return rows, np.concatenate([e, *halves]), np.concatenate([e, *[e[far]] * 4]), np.arange(len(rows)) < len(ok)

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, li in grouped(batch.column("text")):
                if len(li.doc):
                    _, k, e, whole = keys(li)
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(e.view(np.int64)), pa.array(whole)], ["key", "e", "whole"])

    @frugal
    def where(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = batch.column("_id").to_numpy(), batch.column("_th").to_numpy()
            for a, b, li in grouped(batch.column("text")):
                if len(li.doc):
                    rows, k, _, _ = keys(li)
                    of = li.doc[rows]
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(ids[a:b][of]), pa.array(ths[a:b][of])], ["key", "_id", "_th"])

    counted = slim.mapInArrow(count, "key long, e long, whole boolean").groupBy("key").agg(F.min("e").alias("a"), F.max("e").alias("b"), F.count("*").alias("n"), F.first("whole").alias("whole"))
    shared = stored(counted.filter("a <> b or (whole and n > 1)").select("key"), "halves")
    lists = slim.mapInArrow(where, "key long, _id long, _th long").join(shared, "key", "left_semi").groupBy("_id", "_th").agg(F.collect_set("key").alias("keys"))

    def apart(place: tuple) -> int:
        return ((place[0] ^ place[1] ^ place[2] * 0x9E3779B97F4A7C15) + 2**63 & 2**64 - 1) - 2**63

    @frugal
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (v, p, place, of): variant, its i (-1: the line itself, -2: a line too short for edits, -3: settled by the
        earlier line `of` of this task)."""
        seen: dict[tuple[int, int], tuple] = {}  # of this task's rows so far, which come in order
        for batch in batches:
            ids, ths = batch.column("_id").to_pylist(), batch.column("_th").to_pylist()
            if len(seen) > REMEMBERED:
                seen.clear()
            listed = batch.column("keys")
            marks, values = np.asarray(listed.offsets), listed.values.to_numpy().view(np.uint64)
            for x, y, li in grouped(batch.column("text")):
                total = li.sums()
                first = li.first
                out: tuple[list, ...] = ([], [], [], [], [], [], [], [])

                def put(v: int, p: int, place: tuple, of: tuple | None) -> None:
                    for c, value in zip(out, (v, p, *place, *(of or (None, None, None)))):
                        c.append(value)

                rows, k, _, whole = keys(li) if len(li.doc) else (np.zeros(0, int),) * 4
                doc = li.doc[rows]
                hit = np.zeros(len(rows), bool)
                order = np.argsort(doc, kind="stable")
                cut = np.searchsorted(doc[order], np.arange(y - x + 1))
                for d in range(y - x):
                    mine = order[cut[d] : cut[d + 1]]
                    hit[mine] = np.isin(k[mine], values[marks[x + d] : marks[x + d + 1]])
                n_ok = int(whole.sum()) if len(rows) else 0
                far = (len(rows) - n_ok) // 4
                flags: dict[int, list[bool]] = {}
                for j in np.flatnonzero(hit).tolist():
                    flags.setdefault(int(rows[j]), [False] * 5)[0 if j < n_ok else 1 + (j - n_ok) // far] = True
                for r in sorted(flags):
                    exact, front, back, front_less, back_less = flags[r]
                    a, b = int(first[r]), int(first[r + 1])
                    n = b - a
                    d = int(li.doc[r])
                    place = (ids[x + d], ths[x + d], int(li.number[r]))
                    e = int(whole_keys(total, np.array([a]), np.array([b])).view(np.int64)[0])
                    own = -1 if n >= fuzzy else -2
                    if (e, own) in seen:  # the same line, earlier; keyed by its place, not by what many lines share
                        if seen[e, own] != place:  # not the same row once more
                            put(apart(place), -3, place, seen[e, own])
                        continue
                    seen[e, own] = place
                    put(e, own, place, None)
                    spans = []
                    if front:
                        spans.append((n // 2, n))
                    if back:
                        spans.append((0, n // 2))
                    if front_less:
                        spans.append(((n - 1) // 2, n))
                    if back_less:
                        spans.append((0, (n - 1) // 2 + 1))
                    if spans:
                        lo, hi = min(s[0] for s in spans), max(s[1] for s in spans)
                        late = None
                        new = []
                        for p, v in zip(range(lo, hi), variants(total, a, b, a + lo, a + hi).view(np.int64).tolist()):
                            if (of := seen.setdefault((v, p), place)) != place:
                                late = late or of
                            else:
                                new.append((v, p))
                        if late:  # settled; its own variants still settle later lines
                            put(apart(place), -3, place, late)
                        for v, p in new:
                            put(v, p, place, None)
                if out[0]:
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["v", "p", "_id", "_th", "line", "of_id", "of_th", "of_line"])

    rows = base.join(lists, ["_id", "_th"]).sortWithinPartitions("_id", "_th").select("_id", "_th", "text", "keys")
    found = rows.mapInArrow(emit, "v long, p int, _id long, _th long, line int, of_id long, of_th long, of_line int")
    place = F.struct("_id", "_th", "line")
    by_v, by_vp = Window.partitionBy("v"), Window.partitionBy("v", "p")
    of = F.when(F.col("p") == -3, F.struct(F.col("of_id").alias("_id"), F.col("of_th").alias("_th"), F.col("of_line").alias("line")))
    judged = found.withColumn("place", place).withColumn("same", F.min("place").over(by_vp))
    judged = judged.withColumn("whole", F.min(F.when(F.col("p") == -1, F.col("place"))).over(by_v)).withColumn("less", F.min(F.when(F.col("p") >= 0, F.col("place"))).over(by_v))
    other = F.when(F.col("p") == -1, F.least("same", F.coalesce("less", "same"))).when(F.col("p") >= 0, F.least("same", F.coalesce("whole", "same"))).when(F.col("p") == -2, F.col("same"))
    late = judged.withColumn("of", F.coalesce(of, other)).filter("of < place or p = -3")
    return late.groupBy("_id", "_th", "line").agg(F.min("of").alias("of")).select("_id", "_th", "line", F.col("of._id").alias("first_id"), F.col("of.line").alias("first_line"))


def dedup_lines(docs: DataFrame, least: int = 5, fuzzy: int = 8) -> DataFrame:
    """docs with the columns it came with, `text` without the lines that go, and (_n_lines, _removed array<int>): the
    number of lines and the removed line numbers, from 0. Lines end at a line feed; the others stay as they are.

    Null text: null, no lines. Empty text: no lines. Lines of fewer than `least` words (`[^\\x20\\x09-\\x0D]+`) stay; at
    least = 1, as the query and the pipeline have it, these are blank lines only. White
    space within a line doesn't count in comparisons. Null doc_id: before all others. Rows that share a doc_id: ordered
    by a hash of the text; rows that repeat in full fare alike, as one document. Empty table: no rows. Columns of docs
    named like the two added ones are replaced; all others are kept, whatever their names.
    """
    slim = docs.select("doc_id", "text")
    gone = duplicate_lines(slim, least, fuzzy).groupBy("_id", "_th").agg(F.collect_list("line").alias("_gone"))
    kind = docs.schema["doc_id"].dataType
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "_n_lines", "_removed")]
    # the other columns travel as one, so their names meet no others
    other = [F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_rest")] if rest else []
    have = keyed(docs, *other).join(gone, ["_id", "_th"], "left")
    doc_id = F.when(F.col("_id") != F.lit(-(2**63)), F.col("_id")).cast(kind).alias("doc_id")
    order = [doc_id if c == "doc_id" else F.col("text") if c == "text" else F.col("_rest").getField(c).alias(c) for c in docs.columns if c in rest or c in ("doc_id", "text")]
    kept = have.select(*order)
    (of,) = fresh(kept, "_gone")
    slim = have.select(*order, F.lit(0).alias("_n_lines"), F.array().cast("array<int>").alias("_removed"), F.col("_gone").alias(of))
    schema = slim.drop(of).schema
    schema = type(schema)([type(f)(f.name, f.dataType, True) for f in schema])
    names = schema.names

    @frugal
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, total, removed = [], [], []
            for t, gone in zip(*(batch.column(c).to_pylist() for c in ("text", of))):
                lines = t.split("\n") if t else []
                count = len(lines) - (bool(t) and t.endswith("\n"))
                mine = sorted(set(gone)) if gone else []
                if mine:
                    drop = set(mine)
                    t = "\n".join(x for i, x in enumerate(lines) if i not in drop)
                new.append(t)
                total.append(count)
                removed.append(mine)
            given = {"text": pa.array(new, pa.string()), "_n_lines": pa.array(total, pa.int32()), "_removed": pa.array(removed, pa.list_(pa.int32()))}
            yield pa.RecordBatch.from_arrays([given.get(c, batch.column(batch.schema.names.index(c))) for c in names], names=names)

    return slim.mapInArrow(cut, schema)
