"""Exact substring dedup: Rabin-Karp hashes of every fixed-length token window, counted in Spark.

A window is removed if the same words also start earlier. To count windows without shuffling all of them, each window
is tied to its anchor, the smallest hash among the shorter grams inside it: equal windows have equal anchors, so a
window whose anchor occurs once in the corpus is unique, and only the others' hashes are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetrail.llm.common import keyed, stored
from kinetrail.llm.words import Words, words

#: Words of the grams among which a window's anchor is chosen.
GRAM = 8
#: Windows a task remembers; what it forgets costs only shuffling.
REMEMBERED = 2_000_000


def sliding(x: np.ndarray, span: int, best: np.ufunc) -> np.ndarray:
    """best over x[i : i + span] for each i."""
    have = 1
    while have < span:
        step = min(have, span - have)
        x = best(x[: len(x) - step], x[step:])
        have += step
    return x


def anchors(w: Words, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word and anchor of each window of size words; document and hash of each gram that is a window's anchor."""
    at, h = w.windows(gram)
    span = size - gram + 1
    if len(at) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = sliding(h, span, np.minimum)
    ok = w.doc[at[: len(least)]] == w.doc[at[span - 1 :]]
    # a gram is an anchor if the largest of the minima of the windows around it is the gram itself
    around = np.zeros(len(h) + span - 1, np.uint64)
    around[span - 1 : span - 1 + len(least)] = np.where(ok, least, 0)
    chosen = (sliding(around, span, np.maximum) == h) & (h > 0)
    return at[: len(least)][ok], least[ok], w.doc[at[chosen]], h[chosen]


def spans(mask: np.ndarray) -> np.ndarray:
    """[from, to) of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge.reshape(-1, 2)


def dedup_substrings(docs: DataFrame, size: int = 20, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept) of each row of docs: words are `[^\\x20\\x09-\\x0D]+`; a word covered by a
    window of size words that also starts earlier (smaller doc_id, or same document and earlier) is removed; spans
    are the maximal removed intervals [start, stop) of word numbers, kept the other words joined by one space.

    Null or empty text: 0 words, kept ''. Fewer words than size: nothing removed. Null doc_id: before all others.
    Rows that share a doc_id: ordered by a hash of the text; rows that repeat in full fare alike, as one document.
    Empty table: no rows. Other columns are left out.

    A window that starts earlier in the same task is settled there, so a key reaches the global comparison at most
    once a task, however often a passage occurs.
    """
    gram = min(gram, size)
    base = keyed(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, w in words(batch.column("text")):
                values, n = np.unique(anchors(w, size, gram)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], ["anchor", "n"])

    def where(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = batch.column("_id").to_numpy(), batch.column("_th").to_numpy()
            for a, b, w in words(batch.column("text")):
                _, _, doc, values = anchors(w, size, gram)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(ids[a:b][doc]), pa.array(ths[a:b][doc])], ["anchor", "_id", "_th"])

    texts = base.select("_id", "_th", "text")
    repeated = stored(texts.mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor"), "anchors")
    lists = texts.mapInArrow(where, "anchor long, _id long, _th long").join(repeated, "anchor", "left_semi").groupBy("_id", "_th").agg(F.collect_set("anchor").alias("anchors"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # windows of this task's rows so far, which come in order
        row = None  # the row before: one that repeats it in full is the same document
        for batch in batches:
            if len(seen) > REMEMBERED:
                seen.clear()
            ids, hashes, listed = batch.column("_id").to_numpy(), batch.column("_th").to_numpy(), batch.column("anchors")
            marks, values = np.asarray(listed.offsets), listed.values.to_numpy().view(np.uint64)
            for a, b, w in words(batch.column("text")):
                at, anchor, _, _ = anchors(w, size, gram)
                h = w.windows(size)[1].view(np.int64)  # one for each anchor, in the same order
                cut = np.searchsorted(w.doc[at], np.arange(b - a + 1)) if len(at) else np.zeros(b - a + 1, int)
                out: tuple[list, ...] = ([], [], [], [], [])
                for d in range(b - a):
                    lo, hi = cut[d], cut[d + 1]
                    again, row = row == (ids[a + d], hashes[a + d]), (ids[a + d], hashes[a + d])
                    if lo == hi or again:
                        continue
                    mine = np.flatnonzero(np.isin(anchor[lo:hi], values[marks[a + d] : marks[a + d + 1]]))
                    if not len(mine):
                        continue
                    keys = h[lo + mine].tolist()
                    new = np.fromiter((not (k in seen or seen.add(k)) for k in keys), bool, len(keys))
                    pos = (at[lo + mine] - w.first[d]).astype(np.int32)
                    n = int(new.sum())
                    more = pos[~new]
                    extra = int(len(more) > 0)
                    out[0].append(np.concatenate([h[lo + mine][new], np.full(extra, ids[a + d] ^ hashes[a + d])]))
                    out[1].append(np.full(n + extra, ids[a + d]))
                    out[2].append(np.full(n + extra, hashes[a + d]))
                    out[3].append(np.concatenate([pos[new], np.full(extra, -1, np.int32)]))
                    out[4].extend([None] * n + ([more.tobytes()] if len(more) else []))
                if out[0]:
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in out[:4]), pa.array(out[4], pa.binary())], ["key", "_id", "_th", "pos", "more"])

    rows = base.join(lists, ["_id", "_th"]).sortWithinPartitions("_id", "_th").select("_id", "_th", "text", "anchors")
    found = rows.mapInArrow(compare, "key long, _id long, _th long, pos int, more binary")
    place = F.struct("_id", "_th", "pos")
    first = F.min(place).over(Window.partitionBy("key", F.col("pos") < 0))
    late = found.withColumn("first", first).filter((place > F.col("first")) | (F.col("pos") < 0))
    late = late.groupBy("_id", "_th").agg(F.collect_list(F.struct("pos", "more")).alias("late"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, t, late in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "late"))):
                ws = (t or "").encode().split()  # splits at exactly these six bytes
                gone = []
                if late:
                    parts = [np.frombuffer(x["more"], np.int32) if x["pos"] < 0 else np.array([x["pos"]], np.int32) for x in late]
                    edge = np.zeros(len(ws) + 1, np.int64)
                    pos = np.unique(np.concatenate(parts))
                    np.add.at(edge, pos, 1)
                    np.add.at(edge, pos + size, -1)
                    gone = spans(np.cumsum(edge)[:-1] > 0).tolist()
                n, kept, at = len(ws), [], 0
                for x, y in gone:
                    kept += ws[at:x]
                    at = y
                kept += ws[at:]
                for c, v in zip(out, (i, n, n - len(kept), [{"start": x, "stop": y} for x, y in gone], b" ".join(kept).decode())):
                    c.append(v)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), kind, pa.string()))], ["doc_id", "n_words", "n_removed", "spans", "kept"])

    smallest = F.when(F.col("_id") == F.lit(-(2**63)), F.lit(None).cast("long")).otherwise(F.col("_id"))
    done = base.join(late, ["_id", "_th"], "left").select(smallest.alias("doc_id"), "text", "late")
    return done.mapInArrow(remove, "doc_id long, n_words long, n_removed long, spans array<struct<start: int, stop: int>>, kept string")
