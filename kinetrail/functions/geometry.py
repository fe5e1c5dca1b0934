"""Expressions over points of one frame, and motion along a sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrail.functions.windows import bounds, ordered, roll

EPS = 1e-6
Point = tuple[Column, Column]


def minus(a: Point, b: Point) -> Point:
    return a[0] - b[0], a[1] - b[1]


def length(v: Point) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1])


def dot(a: Point, b: Point) -> Column:
    return a[0] * b[0] + a[1] * b[1]


def cosine(a: Point, b: Point) -> Column:
    return dot(a, b) / (length(a) * length(b) + EPS)


def area(a: Point, b: Point, c: Point) -> Column:
    """Of the triangle of three points."""
    return F.abs((b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])) / 2


def clipped(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def spine_angle(a: Point, middle: Point, b: Point) -> Column:
    """Degrees at the middle point; 180 where a point is missing."""
    return F.coalesce(F.degrees(F.acos(clipped(cosine(minus(a, middle), minus(b, middle)), -1.0, 1.0))), F.lit(180.0))


def wall_distance(p: Point, width: Column, height: Column, circular: Column) -> Column:
    """From a point to the nearest wall of an arena, at least 0."""
    away = length((p[0] - width / 2, p[1] - height / 2))
    straight = F.least(p[0], width - p[0], p[1], height - p[1])
    return F.when(p[0].isNotNull() & p[1].isNotNull(), F.greatest(F.when(circular, F.least(width, height) / 2 - away).otherwise(straight), F.lit(0.0)))


def moment(points: list[Point], mean: Point, j: int, k: int) -> Column:
    """Second moment of coordinates j and k of points about their mean, divided by the count of points, missing ones
    too, less 1."""
    return sum((F.coalesce((p[j] - mean[j]) * (p[k] - mean[k]), F.lit(0.0)) for p in points), F.lit(0.0)) / float(max(1, len(points) - 1))


def axes(xx: Column, yy: Column, xy: Column) -> tuple[Column, Column]:
    """Larger and smaller eigenvalue of a symmetric matrix."""
    root = F.sqrt((xx - yy) * (xx - yy) + 4 * xy * xy)
    return (xx + yy + root) / 2, (xx + yy - root) / 2


def spread_axes(points: list[Point]) -> tuple[Column, Column]:
    """axes() of the moments of a frame's points."""

    def centre(k: int) -> Column:
        total = sum((F.coalesce(p[k], F.lit(0.0)) for p in points), F.lit(0.0))
        return F.try_divide(total, sum((p[k].isNotNull().cast("double") for p in points), F.lit(0.0)))

    mean = centre(0), centre(1)
    return axes(moment(points, mean, 0, 0), moment(points, mean, 1, 1), moment(points, mean, 0, 1))


def step(c: Column, k: int = 1, seq: str = "seq", frame: str = "frame") -> Column:
    """Difference to the k-th row before."""
    return c - F.lag(c, k).over(ordered(seq, frame))


def tortuosity(x: Column, y: Column, path: Column, width: int) -> tuple[Column, Column]:
    """Path over displacement, and displacement over path, of the trailing window; path: a row's own step."""
    total = roll(path, width, width // 2, F.sum)
    net = F.coalesce(length((step(x, width), step(y, width))), F.lit(0.0))
    return total / (net + 0.1), net / (total + 1.0)


def asymmetry(speed: Column, width: int) -> Column:
    """Mean of the rows to come less that of the rows past, 0 where one is missing."""
    least = max(3, width // 4)
    return F.coalesce(roll(speed, width, least, F.avg, "future") - roll(speed, width, least, F.avg), F.lit(0.0))


def divergence(speed: Column, width: int, least: int) -> Column:
    """Symmetric Kullback-Leibler divergence of normal distributions fitted to past and future; 0 where one is missing."""

    def fitted(side: str) -> tuple[Column, Column]:
        return roll(speed, width, least, F.avg, side), F.greatest(roll(speed, width, least, F.var_samp, side), F.lit(EPS))

    def one_way(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
        gap = a[0] - b[0]
        return (a[1] / b[1] + gap * gap / b[1] - 1 + F.log(b[1] / a[1])) / 2

    past, future = fitted("trailing"), fitted("future")
    return F.coalesce(one_way(past, future) + one_way(future, past), F.lit(0.0))


def share_where(flag: Column, width: int, side: str = "trailing") -> Column:
    """Share of the window's rows, missing ones as false, for which flag holds."""
    return F.avg(F.when(flag, 1.0).otherwise(0.0)).over(ordered().rowsBetween(*bounds(width, side)))


def tracked(df: DataFrame, side: str = "") -> list[str]:
    return [c[len(side) : -2] for c in df.columns if c.startswith(side) and c.endswith("_x") and f"{c[:-2]}_y" in df.columns]


def point(part: str, side: str = "") -> Point:
    return F.col(f"{side}{part}_x"), F.col(f"{side}{part}_y")


def middle(points: list[Point]) -> Point:
    """Mean of the points that are there."""

    def mean(k: int) -> Column:
        total = sum((F.coalesce(p[k], F.lit(0.0)) for p in points), F.lit(0.0))
        return F.try_divide(total, sum((p[k].isNotNull().cast("double") for p in points), F.lit(0.0)))

    return mean(0), mean(1)
