"""MinHash near-duplicates: signatures cut into bands tie candidates together, each candidate pair is verified in sequence,
batch by batch of its signatures, and left as soon as the posterior of its similarity rules a link out; what survives is
compared in full.

A pair of Jaccard similarity t = 0.85 shares no band of `rows` values with probability (1 - t ** rows) ** bands, 9e-9 for
48 bands of 7. With a uniform prior, m equal values of n make the similarity Beta(m + 1, n - m + 1), which reaches t
with the probability of at most m hits in n + 1 draws of t; a pair goes when that falls below MISS.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrail.llm.ngram_join import CHUNK, MOST, Block, Prefixes, linked, with_ids
from kinetrail.llm.words import mix

#: Posterior probability of a link below which a pair is left.
MISS = 1e-9
#: Signature values compared at a time.
BATCH = 48
#: Set members hashed at a time.
PART = 2048


def least_matches(n: int, percent: int, miss: float) -> int:
    """The fewest equal values of n at which the similarity may still reach percent with probability `miss`."""
    t, total = percent / 100, 0.0
    for m in range(n + 1):
        total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t) + (n + 1 - m) * math.log1p(-t)) if t < 1 else 0.0
        if total >= miss:
            return m
    return n


class Bands(Prefixes):
    """Keys of a set: its bands; sets are compared by their signatures, then in full."""

    def __init__(self, percent: int, bands: int = 48, rows: int = 7, miss: float = MISS, seed: int = 1):
        super().__init__(percent)
        self.bands, self.rows, self.miss = bands, rows, miss
        seeds = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) + np.uint64(seed << 32))
        self.xor = (seeds[::2] >> np.uint64(32)).astype(np.uint32)[:, None]
        self.times = ((seeds[1::2] >> np.uint64(32)).astype(np.uint32) | np.uint32(1))[:, None]

    def signature(self, s: np.ndarray) -> np.ndarray:
        """The smallest of the set's members (hashes, at least one) under each of bands * rows mixtures."""
        h, best = (s >> np.uint64(32)).astype(np.uint32), None
        for a in range(0, len(h), PART):
            x = h[None, a : a + PART] ^ self.xor
            x *= self.times
            x ^= x >> np.uint32(16)
            least = x.min(axis=1)
            best = least if best is None else np.minimum(best, least)
        return best

    def keys(self, s: np.ndarray) -> np.ndarray:
        parts = self.signature(s).astype(np.uint64).reshape(self.bands, self.rows)
        total = np.arange(1, self.bands + 1, dtype=np.uint64)
        for k in range(self.rows):
            total = mix(total + parts[:, k])
        return total

    def least(self, n: Column) -> Column:
        return F.lit(1)

    def block(self) -> Block:
        return Sequential(self)


class Sequential(Block):
    """Sets of a block and their signatures."""

    def __init__(self, method: Bands):
        super().__init__(method.percent)
        self.method = method
        n = method.bands * method.rows
        self.stops = [*range(BATCH, n, BATCH), n]
        self.need = [least_matches(k, method.percent, method.miss) for k in self.stops] if method else []
        self.signs = np.zeros((64, n), np.uint32)

    def _candidates(self, size: int, keys: list[int]) -> list[int]:
        if (shared := self._shared(keys)) is None:
            return []
        p, sizes = self.percent, self.sizes[: len(self.sets)]
        return np.flatnonzero((shared > 0) & (100 * size >= p * sizes) & (100 * sizes >= p * size)).tolist()

    def _remember(self, me: int) -> None:
        if me == len(self.signs):
            self.signs = np.concatenate([self.signs, np.zeros_like(self.signs)])
        self.signs[me] = self.method.signature(self.sets[me])

    def _walk(self, me: int, wanted: dict[int, None]) -> None:
        left = np.fromiter(wanted, np.int64, len(wanted))
        hits, at, mine = np.zeros(len(left), np.int64), 0, self.signs[me]
        for stop, need in zip(self.stops, self.need):
            hits += (self.signs[left, at:stop] == mine[at:stop]).sum(axis=1)
            ok = hits >= need
            left, hits, at = left[ok], hits[ok], stop
        x, p = self.sets[me], self.percent
        for y in left.tolist():
            if self.find(y) != self.find(me):
                s = self.sets[y]
                both = int((x[np.minimum(np.searchsorted(x, s), len(x) - 1)] == s).sum())
                if 100 * both >= p * (len(x) + len(s) - both):
                    self.links[y] += 1
                    self.union(me, y)


def near_duplicates(docs: DataFrame, n: int = 3, percent: int = 85, bands: int = 48, rows: int = 7, miss: float = MISS, chunk: int = CHUNK, most: int = MOST) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs (doc_id, text): the size of its set of distinct word
    n-grams (A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`; fewer words: the whole sequence as one), the smallest doc_id
    that links lead to, and whether that is its own. Two sets are linked if 100 * intersection >= percent * union, which
    is confirmed on whole sets; a link is missed with the small probabilities above.

    Equal sets are one set, so copies need no comparison. Null text or no words: an empty set, linked with nothing. Rows that
    repeat or share a doc_id: one row each. A null doc_id: component_id is null only where no row of the component has a
    doc_id, and then its rows are kept. Empty table: no rows. Very long texts: one set at a time is held. Other columns are left out.
    """
    found = with_ids(linked(docs, n, percent, chunk, most, Bands(percent, bands, rows, miss)))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
