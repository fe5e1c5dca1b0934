"""Points of one frame as arrays; a missing coordinate is NaN."""

from __future__ import annotations

import numpy as np

from kinetrail.functions.kernel import Array
from kinetrail.functions.sequences import Frames, Point

EPS = 1e-6


def minus(a: Point, b: Point) -> Point:
    return a[0] - b[0], a[1] - b[1]


def dot(a: Point, b: Point) -> Array:
    return a[0] * b[0] + a[1] * b[1]


def length(v: Point) -> Array:
    return np.sqrt(v[0] * v[0] + v[1] * v[1])


def squared(a: Point, b: Point) -> Array:
    d = minus(a, b)
    return dot(d, d)


def apart(a: Point, b: Point) -> Array:
    return length(minus(a, b))


def cosine(a: Point, b: Point) -> Array:
    return dot(a, b) / (length(a) * length(b) + EPS)


def halfway(a: Point, b: Point) -> Point:
    return (a[0] + b[0]) / 2, (a[1] + b[1]) / 2


def area(a: Point, b: Point, c: Point) -> Array:
    """Of the triangle of three points."""
    return np.abs((b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])) / 2


def spine_angle(a: Point, middle: Point, b: Point) -> Array:
    """Degrees at the middle point; 180 where a point is missing."""
    bend = np.degrees(np.arccos(np.clip(cosine(minus(a, middle), minus(b, middle)), -1.0, 1.0)))
    return np.where(np.isnan(bend), 180.0, bend)


def middle(points: list[Point]) -> Point:
    """Mean of the points that are there."""

    def mean(k: int) -> Array:
        there = sum((~np.isnan(p[k])).astype(np.float64) for p in points)
        total = sum(np.where(np.isnan(p[k]), 0.0, p[k]) for p in points)
        return np.where(there > 0, total / np.maximum(there, 1.0), np.nan)

    return mean(0), mean(1)


def centre(s: Frames, prefer: tuple[str, ...] = ("body_center",), side: str = "") -> Point:
    """The first preferred part that is tracked, else the middle of all parts."""
    parts = s.tracked(side)
    return next((s.point(p, side) for p in prefer if p in parts), None) or middle([s.point(p, side) for p in parts])


def moment(points: list[Point], mean: Point, j: int, k: int) -> Array:
    """Second moment of coordinates j and k of points about their mean, divided by the count of points, missing ones
    too, less 1."""
    terms = ((p[j] - mean[j]) * (p[k] - mean[k]) for p in points)
    return sum(np.where(np.isnan(t), 0.0, t) for t in terms) / float(max(1, len(points) - 1))


def axes(xx: Array, yy: Array, xy: Array) -> tuple[Array, Array]:
    """Larger and smaller eigenvalue of a symmetric matrix."""
    root = np.sqrt((xx - yy) * (xx - yy) + 4 * xy * xy)
    return (xx + yy + root) / 2, (xx + yy - root) / 2
