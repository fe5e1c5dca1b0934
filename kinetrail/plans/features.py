"""Registered queries of motion features, labels, decay and resampling, and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrail.functions import geometry as G
from kinetrail.functions.decay import ewm
from kinetrail.functions.windows import ordered, roll
from kinetrail.operators import labels, sampling, scoring
from kinetrail.operators.pairing import rolling_correlations
from kinetrail.plans.catalog import FRAMES, OVER, PLAIN, POSES, SCORED, SEGMENTS, TRACKS, _halves, register, rounded
from kinetrail.sources.tables import poses, segments, tracks

#: A row's own step, and steps of the SQL side.
STEPS = TRACKS + f", d AS (SELECT seq, frame, fps, x, y, x - LAG(x) OVER w AS dx, y - LAG(y) OVER w AS dy FROM tracks WINDOW w AS ({OVER})), v AS (SELECT *, SQRT(dx * dx + dy * dy) AS s FROM d)"


def _points() -> list[G.Point]:
    return [(F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by"))]


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir).withColumns({"dx": G.step(F.col("x")), "dy": G.step(F.col("y"))})
    return t.withColumn("s", G.length((F.col("dx"), F.col("dy"))))


def _ewm(span: int) -> None:
    d = 1 - 2 / (span + 1)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ewm(tracks(spark, sf_dir).select("seq", "frame", "x"), "x", span, "v").select("seq", "frame", rounded(F.col("v")).alias("v"))

    register(f"ewm_{span}", f"""WITH {TRACKS} SELECT a.seq, a.frame, ROUND(SUM(b.x * POW(CAST({d!r} AS DOUBLE), a.frame - b.frame)) / SUM(POW(CAST({d!r} AS DOUBLE), a.frame - b.frame)), 4) AS v
      FROM tracks a LEFT JOIN tracks b ON a.seq = b.seq AND b.frame <= a.frame AND b.x IS NOT NULL GROUP BY a.seq, a.frame""", query)  # fmt: skip


for _span in (120, 240):
    _ewm(_span)


@register("tortuosity", f"""WITH {STEPS}, p AS (SELECT seq, frame, CASE WHEN COUNT(s) OVER w >= 15 THEN SUM(s) OVER w END AS path, COALESCE(SQRT(POW(x - LAG(x, 30) OVER o, 2) + POW(y - LAG(y, 30) OVER o, 2)), 0) AS net
  FROM v WINDOW w AS ({OVER} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), o AS ({OVER})) SELECT seq, frame, ROUND(path / (net + 0.1), 4) AS tortuosity, ROUND(net / (path + 1.0), 4) AS efficiency FROM p""")
def tortuosity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = G.tortuosity(F.col("x"), F.col("y"), F.col("s"), 30)
    return _steps(spark, sf_dir).select("seq", "frame", rounded(a).alias("tortuosity"), rounded(b).alias("efficiency"))


@register("curvature", f"""WITH {STEPS}, e AS (SELECT *, dx - LAG(dx) OVER w AS ddx, dy - LAG(dy) OVER w AS ddy, ABS(ATAN2(dy, dx) - LAG(ATAN2(dy, dx)) OVER w) AS turn FROM v WINDOW w AS ({OVER})),
  k AS (SELECT *, ABS(dx * ddy - dy * ddx) / (s * s * s + 0.000001) AS k FROM e)
  SELECT seq, frame, ROUND(CASE WHEN COUNT(k) OVER w >= 5 THEN AVG(k) OVER w END, 4) AS curvature, ROUND(CASE WHEN COUNT(turn) OVER w >= 5 THEN SUM(turn) OVER w END, 4) AS turning FROM k WINDOW w AS ({OVER} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    dx, dy, s = F.col("dx"), F.col("dy"), F.col("s")
    t = _steps(spark, sf_dir).withColumns({"ddx": G.step(dx), "ddy": G.step(dy), "turn": F.abs(G.step(F.atan2(dy, dx)))})
    t = t.withColumn("k", F.abs(dx * F.col("ddy") - dy * F.col("ddx")) / (s * s * s + G.EPS))
    return t.select("seq", "frame", rounded(roll(F.col("k"), 30, 5, F.avg)).alias("curvature"), rounded(roll(F.col("turn"), 30, 5, F.sum)).alias("turning"))


@register("jitter", f"""WITH {STEPS}, e AS (SELECT *, SQRT(POW(dx - LAG(dx) OVER w, 2) + POW(dy - LAG(dy) OVER w, 2)) AS j FROM v WINDOW w AS ({OVER}))
  SELECT seq, frame, ROUND(AVG(j) OVER w, 4) AS mean, ROUND(MAX(j) OVER w, 4) AS most FROM e WINDOW w AS ({OVER} ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)""")
def jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _steps(spark, sf_dir)
    t = t.withColumn("j", G.length((G.step(F.col("dx")), G.step(F.col("dy")))))
    return t.select("seq", "frame", rounded(roll(F.col("j"), 9, 1, F.avg)).alias("mean"), rounded(roll(F.col("j"), 9, 1, F.max)).alias("most"))


@register("speed_states", f"""WITH {STEPS}, m AS (SELECT seq, frame, CASE WHEN COUNT(s) OVER w >= 5 THEN AVG(s) OVER w END AS m FROM v WINDOW w AS ({OVER} ROWS BETWEEN 14 PRECEDING AND CURRENT ROW))
  SELECT seq, frame, CASE WHEN m <= 0.5 THEN 0 WHEN m <= 2 THEN 1 WHEN m <= 5 THEN 2 WHEN m > 5 THEN 3 END AS state, ROUND(AVG(CASE WHEN m > 5 THEN 1.0 ELSE 0.0 END) OVER w, 4) AS fast FROM m WINDOW w AS ({OVER} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""")
def speed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("m")
    t = _steps(spark, sf_dir).withColumn("m", roll(F.col("s"), 15, 5, F.avg))
    state = F.when(m <= 0.5, 0).when(m <= 2, 1).when(m <= 5, 2).when(m > 5, 3)
    return t.select("seq", "frame", state.alias("state"), rounded(G.share_where(m > 5, 60)).alias("fast"))


_MOMENTS = ", ".join(f"CASE WHEN COUNT(s) OVER {w} >= 7 THEN {f}(s) OVER {w} END AS {n}" for w, n, f in (("p", "m0", "AVG"), ("p", "w0", "VAR_SAMP"), ("u", "m1", "AVG"), ("u", "w1", "VAR_SAMP")))


@register("speed_asymmetry", f"""WITH {STEPS}, m AS (SELECT seq, frame, {_MOMENTS} FROM v WINDOW p AS ({OVER} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), u AS ({OVER} ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING)),
  g AS (SELECT seq, frame, m0, m1, GREATEST(w0, 0.000001) AS a, GREATEST(w1, 0.000001) AS b FROM m)
  SELECT seq, frame, ROUND(COALESCE(m1 - m0, 0), 4) AS asymmetry, ROUND(COALESCE((a / b + POW(m0 - m1, 2) / b - 1 + LN(b / a)) / 2 + (b / a + POW(m0 - m1, 2) / a - 1 + LN(a / b)) / 2, 0), 3) AS divergence FROM g""")
def speed_asymmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    return _steps(spark, sf_dir).select("seq", "frame", rounded(G.asymmetry(s, 30)).alias("asymmetry"), rounded(G.divergence(s, 30, 7), 3).alias("divergence"))


@register("spine", f"""WITH {POSES}, c AS (SELECT entity, frame, ((ax - 1) * (bx - 1) + (ay - 1) * (by2 - 1)) / (SQRT(POW(ax - 1, 2) + POW(ay - 1, 2)) * SQRT(POW(bx - 1, 2) + POW(by2 - 1, 2)) + 0.000001) AS c FROM poses)
  SELECT c.entity, c.frame, ROUND(c, 4) AS cosine, ROUND(COALESCE(DEGREES(ACOS(LEAST(GREATEST(c, -1), 1))), 180), 3) AS angle, ROUND(ABS((bx - ax) * (1 - ay) - (1 - ax) * (by2 - ay)) / 2, 4) AS area FROM c JOIN poses p ON c.entity = p.entity AND c.frame = p.frame""")
def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    (a, b), middle = _points(), (F.lit(1.0), F.lit(1.0))
    return poses(spark, sf_dir).select("entity", "frame", rounded(G.cosine(G.minus(a, middle), G.minus(b, middle))).alias("cosine"), rounded(G.spine_angle(a, middle, b), 3).alias("angle"), rounded(G.area(a, b, middle)).alias("area"))


@register("arena", f"""WITH {POSES}, p AS (SELECT entity, frame, ax + 20 AS x, ay + 15 AS y, entity % 2 = 0 AS circ FROM poses)
  SELECT entity, frame, ROUND(GREATEST(CASE WHEN circ THEN 15 - SQRT(POW(x - 20, 2) + POW(y - 15, 2)) ELSE LEAST(x, 40 - x, y, 30 - y) END, 0), 4) AS wall FROM p""")
def arena(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = _points()[0]
    wall = G.wall_distance((x + 20, y + 15), F.lit(40.0), F.lit(30.0), F.col("entity") % 2 == 0)
    return poses(spark, sf_dir).select("entity", "frame", rounded(wall).alias("wall"))


@register("body_axes", f"""WITH {POSES}, m AS (SELECT entity, frame, POW(ax - bx, 2) / 2 AS xx, POW(ay - by2, 2) / 2 AS yy, (ax - bx) * (ay - by2) / 2 AS xy FROM poses)
  SELECT entity, frame, ROUND((xx + yy + SQRT(POW(xx - yy, 2) + 4 * xy * xy)) / 2, 4) AS longest FROM m""")
def body_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poses(spark, sf_dir).select("entity", "frame", rounded(G.spread_axes(_points())[0]).alias("longest"))


@register("pair_speed_correlation", f"""WITH {STEPS}, b AS (SELECT a.seq AS agent, c.seq AS target, a.frame, CASE WHEN c.s IS NOT NULL THEN a.s END AS q, CASE WHEN a.s IS NOT NULL THEN c.s END AS r FROM v a JOIN v c ON a.frame = c.frame AND a.seq <> c.seq)
  SELECT agent, target, frame, ROUND(CASE WHEN COUNT(q) OVER w >= 10 AND STDDEV_SAMP(q) OVER w * STDDEV_SAMP(r) OVER w > 0 THEN COVAR_SAMP(q, r) OVER w / (STDDEV_SAMP(q) OVER w * STDDEV_SAMP(r) OVER w) END, 4) AS r FROM b WINDOW w AS (PARTITION BY agent, target ORDER BY frame ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""")
def pair_speed_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling_correlations(_steps(spark, sf_dir).select("seq", "frame", "s"), 60, 10).withColumn("r", rounded(F.col("r")))


@register("smooth_scores", f"WITH {TRACKS} SELECT seq, frame, ROUND(AVG(k / 100.0) OVER ({OVER} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS prob FROM tracks")
def smooth_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir).select("seq", "frame", rounded(roll(F.col("k") / 100.0, 5, 1, F.avg, "centred")).alias("prob"))


@register("label_keys", f"""WITH {TRACKS} SELECT event_id, CAST(seq AS VARCHAR) AS agent, CAST(CASE event_id % 4 WHEN 1 THEN k ELSE seq END AS VARCHAR) AS target, action FROM tracks""")
def label_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    agent = F.concat(F.lit("mouse"), "seq")
    kinds = [(agent, F.lit("self"), "action"), (agent, F.concat(F.lit("mouse"), "k"), "action"), (agent, "action"), (agent, F.lit("none"), "action")]
    raw = F.element_at(F.array(*(F.concat_ws(",", *k) for k in kinds)), (F.col("event_id") % 4 + 1).cast("int"))
    a, t, c = labels.key_parts(F.col("raw"))
    return tracks(spark, sf_dir).select("event_id", raw.alias("raw")).select("event_id", a.alias("agent"), t.alias("target"), c.alias("action"))


@register("label_lists", f"WITH {TRACKS} SELECT event_id, CAST(seq AS VARCHAR) AS agent, UNNEST(['self', CAST(k AS VARCHAR)]) AS target, LOWER(action) AS action FROM tracks")
def label_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda target: F.concat_ws(",", F.concat(F.lit("'"), "seq"), target, F.upper("action"))
    t = tracks(spark, sf_dir).select("event_id", F.to_json(F.array(one(F.lit("self")), one(F.col("k").cast("string")), one(F.lit("self")))).alias("j"))
    return labels.listed(t, "j", "event_id")


@register("resolve_ids", f"""WITH {TRACKS}, r AS (SELECT DISTINCT seq, k FROM tracks), known AS (SELECT DISTINCT seq, k FROM tracks WHERE k % 3 = 0)
  SELECT r.seq, 'm' || r.k AS raw, CAST(COALESCE(a.k, b.k) AS VARCHAR) AS id FROM r LEFT JOIN known a ON a.seq = r.seq AND a.k = r.k LEFT JOIN known b ON b.seq = r.seq AND b.k = r.k - 1""")
def resolve_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir)
    return labels.resolve(t.select("seq", F.concat(F.lit("m"), "k").alias("raw")), t.filter("k % 3 = 0").select("seq", F.col("k").cast("string").alias("id")), "seq")


@register("active_labels", f"""WITH {SEGMENTS}, f AS (SELECT agent, ARG_MIN(action, event_id) AS action FROM segments GROUP BY agent) SELECT event_id, s.agent, s.action FROM segments s JOIN f ON s.agent = f.agent AND s.action = f.action""")
def active_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).select("event_id", "agent", "action")
    truth = s.select("agent", F.col("event_id").alias("row"), F.col("action").alias("labels_of"))
    return labels.active(s, truth, "agent", ["action"]).select("event_id", "agent", "action")


@register("fail_safe_fill", f"""WITH {SEGMENTS}, x AS (SELECT agent, MIN(start) AS first, MAX(stop) AS last FROM segments WHERE agent % 2 = 0 GROUP BY agent),
  t AS (SELECT agent, target, action, ROW_NUMBER() OVER (PARTITION BY agent, target ORDER BY action) - 1 AS i, COUNT(*) OVER (PARTITION BY agent, target) AS n FROM (SELECT DISTINCT agent, target, action FROM segments)),
  p AS (SELECT *, CAST(CEIL((last + 1 - first) * 1.0 / n) AS BIGINT) AS part FROM x JOIN t USING (agent))
  SELECT agent, target, action, first + i * part AS start, LEAST(first + (i + 1) * part, last + 1) AS stop FROM p WHERE first + i * part < LEAST(first + (i + 1) * part, last + 1)""")
def fail_safe_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    s = s.withColumn("video", F.col("agent"))
    extents = s.groupBy("video").agg(F.min("start").alias("first"), F.max("stop").alias("last"))
    return labels.fill(extents, s.select("video", "agent", "target", "action"), s.filter("agent % 2 = 1"), "video").drop("video")


@register("row_ids", f"WITH {SEGMENTS} SELECT event_id, ROW_NUMBER() OVER (ORDER BY agent, start, event_id) - 1 AS row_id FROM segments")
def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.numbered(segments(spark, sf_dir), "agent", ["start", "event_id"]).select("event_id", "row_id")


@register("upsample", f"""WITH {TRACKS}, l AS (SELECT action, event_id, k < 10 AS y FROM tracks), c AS (SELECT action, COUNT(*) FILTER (y) AS p, CAST(CEIL(0.3 * COUNT(*) FILTER (NOT y) / (1 - 0.3)) AS BIGINT) AS w FROM l GROUP BY action),
  r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY action, y ORDER BY MD5(CAST(event_id AS VARCHAR)), event_id) AS i FROM l JOIN c USING (action))
  SELECT action, event_id, y, CASE WHEN y AND w > p THEN w // p + CASE WHEN i <= w % p THEN 1 ELSE 0 END ELSE 1 END AS copies FROM r""")
def upsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.upsample(tracks(spark, sf_dir).select("action", "event_id", (F.col("k") < 10).alias("y")), "action", "event_id", 0.3)
    return rows.groupBy("action", "event_id", "y").agg(F.count("*").alias("copies"))


@register("score_report", f"WITH {FRAMES}, {PLAIN}, {SCORED} SELECT lab, action, ROUND(CASE WHEN tp + fp > 0 THEN tp * 1.0 / (tp + fp) ELSE 0 END, 6) AS prec, ROUND(CASE WHEN tp + fn > 0 THEN tp * 1.0 / (tp + fn) ELSE 0 END, 6) AS recall, tp + fn AS support, ROUND(f, 6) AS f FROM f")
def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    r = scoring.report(scoring.counts(a, b))
    return r.select("lab", "action", rounded(F.col("prec"), 6).alias("prec"), rounded(F.col("recall"), 6).alias("recall"), "support", rounded(F.col("f"), 6).alias("f"))


@register("offset_alignment", f"""WITH {STEPS} SELECT seq, frame, ROUND((dx * LAG(dx, 10) OVER w + dy * LAG(dy, 10) OVER w) / (s * LAG(s, 10) OVER w + 0.000001), 4) AS past, ROUND((dx * LEAD(dx, 10) OVER w + dy * LEAD(dy, 10) OVER w) / (s * LEAD(s, 10) OVER w + 0.000001), 4) AS ahead FROM v WINDOW w AS ({OVER})""")
def offset_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, v = ordered(), (F.col("dx"), F.col("dy"))
    at = lambda f: tuple(f(c, 10).over(w) for c in v)
    return _steps(spark, sf_dir).select("seq", "frame", rounded(G.cosine(v, at(F.lag))).alias("past"), rounded(G.cosine(v, at(F.lead))).alias("ahead"))
