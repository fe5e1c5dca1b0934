"""Windows over one ordered stretch of rows as array operations; a missing value is NaN.

Sums, spreads and extremes join the scan to the end of one chunk with the scan from the start of the next (chunks are as
long as the window), so each value is met twice whatever the width and nothing is subtracted. Ranks and medians descend a
tree of bits (a wavelet matrix) for all windows at once, a few steps for each bit of the number of distinct values.
Exponentially weighted means carry a numerator and a denominator from chunk to chunk.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

Array = np.ndarray


def lagged(x: Array, k: int) -> Array:
    """x k rows before, or -k rows after."""
    out = np.full(len(x), np.nan)
    if k >= 0:
        out[k:] = x[: max(0, len(x) - k)]
    else:
        out[:k] = x[-k:]
    return out


def filled(x: Array) -> Array:
    """Each missing value replaced by the last one before it."""
    at = np.where(np.isnan(x), -1, np.arange(len(x)))
    at = np.maximum.accumulate(at) if len(x) else at
    return np.where(at >= 0, x[np.maximum(at, 0)], np.nan)


class Chunks:
    """Windows of `back` rows before to `ahead` rows after each of n, cut into chunks of their length."""

    def __init__(self, n: int, back: int, ahead: int):
        self.n, self.back, self.width = n, back, back + ahead + 1
        self.rows = -(-(n + self.width - 1) // self.width) if n else 0
        start = np.arange(n)
        self.start, self.end = start, start + self.width - 1
        self.whole = start % self.width == 0

    def table(self, x: Array, gap: float) -> Array:
        out = np.full(self.rows * self.width, gap)
        out[self.back : self.back + self.n] = x
        return out.reshape(self.rows, self.width)

    def extreme(self, x: Array, best: np.ufunc) -> Array:
        gap = -np.inf if best is np.fmax else np.inf
        t = self.table(np.where(np.isnan(x), gap, x), gap)
        ends, starts = best.accumulate(t, axis=1).ravel(), best.accumulate(t[:, ::-1], axis=1)[:, ::-1].ravel()
        return best(starts[self.start], ends[self.end])

    def _moments(self, t: Array, u: Array | None) -> tuple[Array, Array, Array, Array, Array]:
        """Count, mean, squares about it, and of a second table its mean and the products with the first, from the start of
        each chunk."""
        ok = ~np.isnan(t) if u is None else ~np.isnan(t) & ~np.isnan(u)
        k = np.add.accumulate(ok, axis=1, dtype=np.int64)

        def means(v: Array) -> tuple[Array, Array, Array]:
            v = np.where(ok, v, 0.0)
            mean = np.add.accumulate(v, axis=1) / np.maximum(k, 1)
            before = np.zeros_like(mean)
            before[:, 1:] = mean[:, :-1]
            return v, mean, before

        v, mean, before = means(t)
        more = ok & (k > 1)
        squares = np.add.accumulate(np.where(more, (v - before) * (v - mean), 0.0), axis=1)
        if u is None:
            return k, mean, squares, mean, squares
        w, mean2, _ = means(u)
        return k, mean, squares, mean2, np.add.accumulate(np.where(more, (v - before) * (w - mean2), 0.0), axis=1)

    def moments(self, x: Array, y: Array | None = None) -> tuple[Array, Array, Array, Array, Array]:
        """Of each window: how many values there are (both of x and y, where y is given), mean of x, sum of squares about
        it, mean of y, sum of products."""
        t, u = self.table(x, np.nan), None if y is None else self.table(y, np.nan)
        ends = [m.ravel()[self.end] for m in self._moments(t, u)]
        starts = [m[:, ::-1].ravel()[self.start] for m in self._moments(t[:, ::-1], None if u is None else u[:, ::-1])]
        starts[0] = np.where(self.whole, 0, starts[0])  # one chunk is the whole window: its end tells all
        (na, ma, sa, wa, pa), (nb, mb, sb, wb, pb) = starts, ends
        n = na + nb
        share, both, gap = nb / np.maximum(n, 1), np.where(self.whole, 0.0, 1.0), mb - ma
        weight = na * share
        mean = np.where(na == 0, mb, ma + gap * share)
        mean2 = np.where(na == 0, wb, wa + (wb - wa) * share)
        return n, mean, both * sa + sb + gap * gap * weight, mean2, both * pa + pb + gap * (wb - wa) * weight


class Ranks:
    """Counts and quantiles of the values that are there, in any ranges of rows."""

    def __init__(self, x: Array):
        ok = ~np.isnan(x)
        self.before = np.concatenate([[0], np.cumsum(ok)])  # values before each row
        self.values, codes = np.unique(x[ok], return_inverse=True)
        self.code = np.zeros(len(x), np.int64)
        self.code[ok] = codes
        self.levels = []
        for bit in range(max(0, int(len(self.values) - 1).bit_length()) - 1, -1, -1):
            one = (codes >> bit) & 1 == 1
            zeros = np.concatenate([[0], np.cumsum(~one)])
            self.levels.append((bit, zeros))
            codes = np.concatenate([codes[~one], codes[one]])

    def range(self, low: Array, high: Array) -> tuple[Array, Array]:
        n = len(self.before) - 1
        return self.before[np.clip(low, 0, n)], self.before[np.clip(high, 0, n)]

    def kth(self, low: Array, high: Array, k: Array) -> Array:
        """The k-th smallest (from 0) of values low to high, all as positions among values."""
        out = np.zeros(len(k), np.int64)
        for bit, zeros in self.levels:
            a, b = zeros[low], zeros[high]
            right = k >= b - a
            k = np.where(right, k - (b - a), k)
            low, high = np.where(right, zeros[-1] + low - a, a), np.where(right, zeros[-1] + high - b, b)
            out += right.astype(np.int64) << bit
        return self.values[np.minimum(out, len(self.values) - 1)] if len(self.values) else np.full(len(k), np.nan)

    def below(self, low: Array, high: Array, code: Array) -> tuple[Array, Array]:
        """How many of values low to high are less than, and equal to, that of a code."""
        less = np.zeros(len(code), np.int64)
        for bit, zeros in self.levels:
            a, b = zeros[low], zeros[high]
            right = (code >> bit) & 1 == 1
            less += np.where(right, b - a, 0)
            low, high = np.where(right, zeros[-1] + low - a, a), np.where(right, zeros[-1] + high - b, b)
        return less, high - low

    def median(self, back: int, ahead: int) -> tuple[Array, Array]:
        """Count and median of each row's window."""
        i = np.arange(len(self.code))
        low, high = self.range(i - back, i + ahead + 1)
        n = high - low
        safe = np.maximum(n, 1)
        return n, (self.kth(low, high, (safe - 1) // 2) + self.kth(low, high, safe // 2)) / 2

    def share(self, back: int) -> tuple[Array, Array]:
        """Count of each row's trailing window, and the average rank of the row's own value as a share of it."""
        i = np.arange(len(self.code))
        low, high = self.range(i - back, i + 1)
        less, equal = self.below(low, high, self.code)
        return high - low, (less + (equal + 1) / 2) / np.maximum(high - low, 1)


@dataclass
class Decay:
    """What an exponentially weighted mean carries on: the mean and the weights' sum at the last value, rows since then."""

    mean: float = math.nan
    weight: float = 0.0
    age: int = 0


def decaying(x: Array, span: float, start: Decay = Decay()) -> tuple[Array, Decay]:
    """The mean so far, each value weighted (1 - 2 / (span + 1)) to the power of its age in rows; a missing value keeps
    the mean before it. start: what came before."""
    n, ok = len(x), ~np.isnan(x)
    d = 1 - 2 / (span + 1)
    last = int(np.flatnonzero(ok)[-1]) if ok.any() else -1
    if last < 0:
        return np.full(n, start.mean), Decay(start.mean, start.weight, start.age + n)
    if d <= 0:
        mean = np.where(ok, x, np.nan)
        weight = np.ones(n)
    else:
        size = max(1, min(1024, int(30 / -math.log(d))))
        rows = -(-n // size)
        up = d ** -np.arange(size, dtype=np.float64)
        down = d ** np.arange(size, dtype=np.float64)
        sums = []
        carry = start.weight * d**start.age if start.weight else 0.0
        for part, begin in ((np.where(ok, x, 0.0), carry * (start.mean if start.weight else 0.0)), (ok.astype(np.float64), carry)):
            t = np.zeros(rows * size)
            t[:n] = part
            t = np.add.accumulate(t.reshape(rows, size) * up, axis=1) * down
            whole, held = d**size, np.empty(rows)
            for k in range(rows):
                held[k] = begin
                begin = begin * whole + t[k, -1]
            sums.append((t + held[:, None] * (down * d)).ravel()[:n])
        mean, weight = np.where(ok, sums[0] / np.where(ok, sums[1], 1.0), np.nan), sums[1]
    end = Decay(float(mean[last]), float(weight[last]), n - 1 - last)
    mean = filled(mean)
    return np.where(np.isnan(mean), start.mean, mean), end


def after(before: Decay, rows: int, part: Decay, span: float) -> Decay:
    """What `rows` more rows, which by themselves carry `part` on, leave of what was carried before."""
    if math.isnan(part.mean):
        return Decay(before.mean, before.weight, before.age + rows)
    if not before.weight:
        return part
    d = max(0.0, 1 - 2 / (span + 1))
    old = before.weight * d ** (before.age + rows - part.age)
    return Decay((part.mean * part.weight + before.mean * old) / (part.weight + old), part.weight + old, part.age)
