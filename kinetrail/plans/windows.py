"""Registered queries of windows, ranks and decays over tracks, whose widths follow each sequence's rate; results are not
rounded, since the order of a sum decides the last digits of a rounded one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinetrail.functions.kernel import Array
from kinetrail.functions.sequences import Frames, features
from kinetrail.plans.catalog import OVER, TRACKS, register
from kinetrail.sources.tables import tracks

_N = "CAST(GREATEST(1, ROUND_EVEN({} * fps / 30.0, 0)) AS BIGINT)"
_SIDES = {"trailing": ("({}) - 1 PRECEDING", "CURRENT ROW"), "centred": ("({}) // 2 PRECEDING", "(({}) - 1) // 2 FOLLOWING"), "future": ("CURRENT ROW", "({}) - 1 FOLLOWING")}


def _over(width: int, side: str) -> str:
    low, high = (b.format(_N.format(width)) for b in _SIDES[side])
    return f"OVER ({OVER} ROWS BETWEEN {low} AND {high})"


def _mean(side: str) -> None:
    def family(s: Frames) -> dict[str, Array]:
        return {"v": s.window(s.columns["x"], s.n(15), 3, "mean", side)}

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return features(tracks(spark, sf_dir).select("seq", "frame", "fps", "x"), family)

    register(f"window_mean_{side}", f"WITH {TRACKS} SELECT seq, frame, CASE WHEN COUNT(x) {_over(15, side)} >= 3 THEN AVG(x) {_over(15, side)} END AS v FROM tracks", query)


for _side in _SIDES:
    _mean(_side)

SPANS = (60, 120, 240)


def _decaying(s: Frames) -> list[tuple[str, Array, float]]:
    return [(f"e{span}", s.columns["x"], span) for span in SPANS]


def _decays(s: Frames) -> dict[str, Array]:
    return s.decays(_decaying(s))


_decays.decays = _decaying
_weight = lambda span: f"POW(CAST({1 - 2 / (span + 1)!r} AS DOUBLE), a.frame - b.frame)"


@register("decayed_means", f"WITH {TRACKS} SELECT a.seq, a.frame, " + ", ".join(f"SUM(b.x * {_weight(n)}) / SUM({_weight(n)}) AS e{n}" for n in SPANS) + " FROM tracks a LEFT JOIN tracks b ON a.seq = b.seq AND b.frame <= a.frame AND b.x IS NOT NULL GROUP BY a.seq, a.frame")
def decayed_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(tracks(spark, sf_dir).select("seq", "frame", "fps", "x"), _decays)


def _ranked(s: Frames) -> dict[str, Array]:
    x, n = s.columns["x"], s.n(240)
    return {"rank": s.rank_share(x, n, 5), "median": s.past(x, n, 5, "median"), "around": s.mid(x, n, 5, "median")}


@register("order_statistics", f"""WITH {TRACKS}, h AS (SELECT *, LIST(x) FILTER (x IS NOT NULL) {_over(240, 'trailing')} AS a FROM tracks)
  SELECT seq, frame, CASE WHEN x IS NOT NULL AND LEN(a) >= 5 THEN (LEN(LIST_FILTER(a, lambda v: v < x)) + (LEN(LIST_FILTER(a, lambda v: v = x)) + 1) / 2.0) / LEN(a) END AS rank,
    CASE WHEN LEN(a) >= 5 THEN MEDIAN(x) {_over(240, 'trailing')} END AS median, CASE WHEN COUNT(x) {_over(240, 'centred')} >= 5 THEN MEDIAN(x) {_over(240, 'centred')} END AS around FROM h""")
def order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(tracks(spark, sf_dir).select("seq", "frame", "fps", "x"), _ranked)
