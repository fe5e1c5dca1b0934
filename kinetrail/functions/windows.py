"""Frame-exact windows over one sequence: trailing, centred and forward, with a least count of values."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scale(width: float, fps: float) -> int:
    """Rows of a window given for 30 frames a second, at least 1; halves go to the even number."""
    return max(1, round(width * fps / 30.0))


def bounds(width: int, side: str) -> tuple[int, int]:
    """Rows before and after the current one: trailing, centred or future."""
    return {"trailing": (-(width - 1), 0), "centred": (-(width // 2), (width - 1) // 2), "future": (0, width - 1)}[side]


def ordered(seq: str = "seq", frame: str = "frame"):
    return Window.partitionBy(seq).orderBy(frame)


def roll(value: Column, width: int, least: int, agg: Callable[[Column], Column], side: str = "trailing", seq: str = "seq", frame: str = "frame") -> Column:
    """agg over the window of width rows; null where fewer than least values are not null."""
    w = ordered(seq, frame).rowsBetween(*bounds(width, side))
    return F.when(F.count(value).over(w) >= least, agg(value).over(w))


def rank_share(value: Column, width: int, least: int, seq: str = "seq", frame: str = "frame") -> Column:
    """Average rank of the value among those of its trailing window, as a share of them; null for a null value."""
    w = ordered(seq, frame).rowsBetween(-(width - 1), 0)
    held = F.collect_list(value).over(w)
    below, equal = F.size(F.filter(held, lambda v: v < value)), F.size(F.filter(held, lambda v: v == value))
    return F.when(value.isNotNull() & (F.size(held) >= least), (below + (equal + 1) / 2) / F.nullif(F.size(held), F.lit(0)))


def correlation(a: Column, b: Column, width: int, least: int, seq: str = "seq", frame: str = "frame") -> Column:
    """Pearson correlation of a and b where both are there, over the trailing window; null for a constant side."""
    w = ordered(seq, frame).rowsBetween(-(width - 1), 0)
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    spread = F.stddev_samp(x).over(w) * F.stddev_samp(y).over(w)
    return F.when((F.count(x).over(w) >= least) & (spread > 0), F.covar_samp(x, y).over(w) / F.nullif(spread, F.lit(0.0)))


def changed(state: Column, seq: str = "seq", frame: str = "frame") -> Column:
    """1 where the state differs from the row before, or either is missing, else 0."""
    before = F.lag(state).over(ordered(seq, frame))
    return F.when(state.isNull() | before.isNull() | (state != before), 1).otherwise(0)


def by_rate(df: DataFrame, rates: list[float] | None, make: Callable[[DataFrame, float], DataFrame], column: str = "fps", default: float = 30.0) -> DataFrame:
    """make(rows of a frame rate, rate) for each rate, together: window widths are literals of a plan. rates: those that
    df may hold, None to look them up (one small job); a null rate counts as `default`, any other fails when its row is
    read."""
    known = df.withColumn(column, F.coalesce(F.col(column).cast("double"), F.lit(float(default))))
    if rates is None:
        rates = sorted(r[0] for r in known.select(column).distinct().collect())
    values = [float(r) for r in rates]
    checked = F.when(F.col(column).isin(values), F.col(column)).otherwise(F.raise_error(F.concat(F.lit("a frame rate that was not named: "), F.col(column).cast("string"))).cast("double"))
    known = known.withColumn(column, checked)
    return reduce(DataFrame.unionByName, [make(known.filter(F.col(column) == r), r) for r in values])
