"""Periodic runs of words: a harmonic grid of (period, grid point) pairs whose longest common extensions are found by
binary search over prefix hashes, for all pairs of a batch of documents at once.

A run of period q and length L >= max(least, power * q) repeats itself for L - q words, so one of the points that stand
max(least - q, (power - 1) * q) apart lies in that stretch, and its word equals the one q later. Over all periods that
is a harmonic series of points. A pair whose two words are equal is extended to both sides; what is long enough is
compared word by word, and of the periods of one stretch the smallest stays.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrail.llm.common import bounded, fresh, frugal
from kinetrail.llm.words import INVERSE, SPACED, Words, powers, words

#: Pairs looked at together.
PAIRS = 1 << 19
#: What is told of a run, in words.
PARTS = ("start", "length", "period")
RUNS = pa.list_(pa.struct([(k, pa.int64()) for k in PARTS]))


def grid(n: int, longest: int, least: int, power: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(point, period) pairs over n words, for the periods that a document of `longest` words has room for, PAIRS or so
    at a time."""
    period = np.arange(1, longest // power + 1)
    gap = np.maximum(least - period, (power - 1) * period)
    count = -(-n // gap)
    upto = np.cumsum(count)
    a = 0
    while a < len(period):
        before = int(upto[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(upto, before + PAIRS)))
        k = np.repeat(np.arange(a, b), count[a:b])
        point = (np.arange(len(k)) - (upto[k] - count[k] - before)) * gap[k]
        yield point, period[k]
        a = b


def extension(total: np.ndarray, at: np.ndarray, period: np.ndarray, room: np.ndarray, way: int) -> np.ndarray:
    """How many words from `at` on (way 1), or before it (way -1), equal those a period later, at most room; by binary
    search over the prefix hashes `total`, for all pairs at once."""
    shift = powers(INVERSE, int(period.max(initial=0)) + 1)[period]
    low, high = np.zeros_like(room), room.copy()
    while True:
        todo = np.flatnonzero(low < high)
        if not len(todo):
            return low
        mid = (low[todo] + high[todo] + 1) // 2
        a, p = at[todo], period[todo]
        start, stop = (a, a + mid) if way > 0 else (a - mid, a)
        same = (total[stop] - total[start]) * shift[todo] == total[stop + p] - total[start + p]
        low[todo] = np.where(same, mid, low[todo])
        high[todo] = np.where(same, high[todo], mid - 1)


def stepped(same: Callable[[int, int, int], bool], at: np.ndarray, period: np.ndarray, room: np.ndarray, way: int) -> np.ndarray:
    """extension(), word by word."""
    out = np.zeros_like(room)
    for i, (a, p, most) in enumerate(zip(at.tolist(), period.tolist(), room.tolist())):
        k = 0
        while k < most and same(*((a + k, a + k + p) if way > 0 else (a - k - 1, a - k - 1 + p)), 1):
            k += 1
        out[i] = k
    return out


def find_runs(symbols: np.ndarray, first: np.ndarray, same: Callable[[int, int, int], bool], least: int = 24, power: int = 3, stepwise: bool = False) -> np.ndarray:
    """Rows (start, stop, period) in order of start and period of every run within documents first[d] to first[d + 1] of
    words with hashes `symbols`: maximal stretches of at least `least` words and `power` periods, by their smallest
    period. same(a, b, k): whether the k words from a on are those from b on. stepwise: extend word by word, which is what
    happens where words or ranges of one hash turn out to differ."""
    n = len(symbols)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(symbols * powers(INVERSE, n), out=total[1:])
    counts = np.diff(first)
    begin, end = np.repeat(first[:-1], counts), np.repeat(first[1:], counts)
    found = []
    for at, p in grid(n, int(counts.max(initial=0)), least, power):
        ok = at + p < end[at]
        at, p = at[ok], p[ok]
        ok = symbols[at] == symbols[at + p]
        at, p = at[ok], p[ok]
        after, before = (stepped(same, at, p, room, way) if stepwise else extension(total, at, p, room, way) for room, way in ((end[at] - at - p, 1), (at - begin[at], -1)))
        ok = before + after + p >= np.maximum(least, power * p)
        found.append(np.stack([at - before, at + after + p, p], axis=1)[ok])
    runs = np.unique(np.concatenate(found) if found else np.zeros((0, 3), np.int64), axis=0)
    if not stepwise and not all(same(a, a + p, b - a - p) for a, b, p in runs.tolist()):
        return find_runs(symbols, first, same, least, power, True)
    return runs[np.unique(runs[:, :2], axis=0, return_index=True)[1]]


def rotated(n: int, h: int) -> np.ndarray:
    """Which of its n words a document of checksum h has at each place: where h ends in 0, those from a on repeat with a
    period that depends on n and h."""
    at, g = np.arange(n), h // 10
    if h % 10 or not n:
        return at
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at[a:] = a + (at[a:] - a) % p
    return at


def plain(w: Words, ids: list) -> np.ndarray:
    """Word numbers as they come."""
    return np.arange(len(w.start))


def planted(w: Words, ids: list) -> np.ndarray:
    """Word numbers after `rotated` by the CRC-32 of each decimal doc_id; a document whose doc_id is null stays as it is."""
    parts = [rotated(n, zlib.crc32(str(i).encode()) if i is not None else 1) + a for i, n, a in zip(ids, w.counts.tolist(), w.first.tolist())]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def joined(w: Words, which: np.ndarray, doc: np.ndarray) -> pa.Array:
    """The words numbered `which`, joined by one space, of each document; doc: that of each, ascending."""
    n = len(w.counts)
    last = np.diff(doc, append=n) != 0
    size = w.end[which] - w.start[which] + ~last
    stop = np.cumsum(size)
    at = np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(w.start[which] - (stop - size), size)
    out = w.data[np.minimum(at, max(0, len(w.data) - 1))]
    out[stop[~last] - 1] = 32
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, size, n))]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def periodic_runs(docs: DataFrame, *keep: str, least: int = 24, power: int = 3, order: Callable[[Words, list], np.ndarray] = plain) -> DataFrame:
    """Of each row of docs (doc_id, text): doc_id, the columns named by keep, n_words, runs (array of start, length, period
    in words, by start and period) and text with the repeats of each run dropped: words that a run contains after its first
    period go, the others are joined by one space. Words are `[^\\x20\\x09-\\x0D]+`; order may put others in their places.

    A run is a maximal stretch of words that are equal a period apart, of at least `least` words and `power` periods; of
    several periods of one stretch the smallest counts, and runs may overlap. Null or empty text: no words, no runs, empty
    text. Rows that repeat or share a doc_id (or have none): one row each. Empty table: no rows. Kept columns come back
    under their names after the operator's own, which therefore must differ. A document's words are held at once, with a
    few numbers for each; no document meets another, so there is no shuffle.
    """
    if clash := {k.lower() for k in keep} & {"doc_id", "n_words", "runs", "text"}:
        raise ValueError(f"columns of these names can't be kept: {sorted(clash)}")
    (body,) = fresh(docs.select("doc_id", *keep), "body")

    @frugal
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, w in words(batch.column(batch.num_columns - 1), SPACED):
                pick = order(w, ids[a:b])
                data, start, end = w.data, w.start[pick], w.end[pick]

                def same(x: int, y: int, k: int) -> bool:
                    some = lambda a: [data[i:j].tobytes() for i, j in zip(start[a : a + k].tolist(), end[a : a + k].tolist())]  # noqa: B023, E731
                    return some(x) == some(y)

                runs = find_runs(w.hash[pick], w.first, same, least, power)
                gone = np.zeros(len(pick) + 1, np.int64)
                np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
                np.add.at(gone, runs[:, 1], -1)
                left = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
                by = np.searchsorted(runs[:, 0], w.first)
                listed = [[{"start": s - x, "length": e - s, "period": p} for s, e, p in runs[i:j].tolist()] for x, i, j in zip(w.first.tolist(), by.tolist(), by[1:].tolist())]
                cols = [c.slice(a, b - a) for c in batch.columns[:-1]] + [pa.array(w.counts, pa.int64()), pa.array(listed, RUNS), joined(w, pick[left], w.doc[left])]
                yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:-1], "n_words", "runs", "text"])

    slim = bounded(docs).select("doc_id", *keep, F.col("text").cast("string").alias(body))
    return slim.mapInArrow(scan, slim.drop(body).schema.add("n_words", "long").add("runs", T.ArrayType(T.StructType([T.StructField(k, T.LongType()) for k in PARTS]))).add("text", "string"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    for batch in batches:
        rows = []
        for i, runs, text in zip(batch.column("doc_id").to_pylist(), batch.column("runs").to_pylist(), batch.column("text").to_pylist()):
            lines = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in runs)
            best = min(runs, key=lambda r: (-Fraction(r["length"], r["period"]), r["start"], r["period"]), default=None)
            top = (best["start"], best["length"], best["period"], 1000 * best["length"] // best["period"]) if best else (None,) * 4
            rows.append((i, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        kinds = [batch.schema.field("doc_id").type, *[pa.int64()] * 5, pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def run_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of each row of docs, its words
    in the `planted` order: the run of the largest exponent (ties: the earliest, then the smallest period; nulls where
    there is none), and digests of all runs and of the text without their repeats."""
    found = periodic_runs(docs, order=planted)
    of = dict(found.dtypes)["doc_id"]
    return found.mapInArrow(_digest, f"doc_id {of}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
