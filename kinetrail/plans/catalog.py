"""Registered queries of the library's own operators, and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetrail.functions.windows import bounds, by_rate, changed, correlation, ordered, rank_share, roll, scale
from kinetrail.operators import intervals, sampling, scoring
from kinetrail.sources.tables import RATES, poses, recordings, segments, table, tracks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

TRACKS = """tracks AS (SELECT event_id, user_id, event_type AS action, CAST(json_extract(props, '$.k') AS BIGINT) AS k, user_id % 8 AS seq,
  ROW_NUMBER() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) - 1 AS frame, CASE WHEN event_id % 17 <> 0 THEN value END AS x,
  CAST(json_extract(props, '$.k') AS DOUBLE) AS y, CASE (user_id % 8) % 3 WHEN 0 THEN 25 WHEN 1 THEN 30 ELSE 50 END AS fps FROM events)"""
SEGMENTS = TRACKS + """, segments AS (SELECT event_id, seq AS agent, user_id % 3 AS target, action, frame AS start, frame + 1 + k % 20 AS stop FROM tracks)"""
POSES = """poses AS (SELECT label AS entity, ROW_NUMBER() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, CAST(embedding[1] AS DOUBLE) * 10 AS ax,
  CAST(embedding[2] AS DOUBLE) * 10 AS ay, CAST(embedding[3] AS DOUBLE) * 10 AS bx, CAST(embedding[4] AS DOUBLE) * 10 AS by2 FROM embeddings)"""
OVER = "PARTITION BY seq ORDER BY frame"


def register(name: str, sql: str, query=None):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add(query) if query else add


def rounded(c, digits: int = 4):
    return F.round(c, digits)


def _rolling(name: str, width: int, least: int, side: str, agg, sql_agg: str) -> None:
    """A window of width frames at 30 a second, scaled to each sequence's rate."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        make = lambda df, fps: df.select("seq", "frame", rounded(roll(F.col("x"), scale(width, fps), least, agg, side)).alias("v"))
        return by_rate(tracks(spark, sf_dir), RATES, make)

    parts = []
    for fps in RATES:
        a, b = bounds(scale(width, fps), side)
        parts.append(f"SELECT seq, frame, ROUND(CASE WHEN COUNT(x) OVER w >= {least} THEN {sql_agg} OVER w END, 4) AS v FROM tracks WHERE fps = {fps} WINDOW w AS ({OVER} ROWS BETWEEN {-a} PRECEDING AND {b} FOLLOWING)")
    register(name, f"WITH {TRACKS} " + " UNION ALL ".join(parts), query)


for _side in ("trailing", "centred", "future"):
    _rolling(f"roll_std_{_side}", 30, 5, _side, F.stddev_samp, "STDDEV_SAMP(x)")
for _agg, _f in (("sum", F.sum), ("min", F.min), ("max", F.max)):
    _rolling(f"roll_{_agg}", 20, 4, "trailing", _f, f"{_agg.upper()}(x)")
_rolling("roll_var", 60, 5, "centred", F.var_samp, "VAR_SAMP(x)")
_rolling("roll_median", 15, 3, "trailing", lambda c: F.percentile(c, F.lit(0.5)), "MEDIAN(x)")
_rolling("roll_median_future", 15, 3, "future", lambda c: F.percentile(c, F.lit(0.5)), "MEDIAN(x)")


@register("roll_rank", f"""WITH {TRACKS}, held AS (SELECT seq, frame, x, LIST(x) FILTER (x IS NOT NULL) OVER ({OVER} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS a FROM tracks)
  SELECT seq, frame, ROUND(CASE WHEN x IS NOT NULL AND LEN(a) >= 5 THEN (LEN(LIST_FILTER(a, lambda v: v < x)) + (LEN(LIST_FILTER(a, lambda v: v = x)) + 1) / 2.0) / LEN(a) END, 4) AS v FROM held""")
def roll_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir).select("seq", "frame", rounded(rank_share(F.col("x"), 20, 5)).alias("v"))


@register("roll_correlation", f"""WITH {TRACKS}, both_ AS (SELECT seq, frame, x, CASE WHEN x IS NOT NULL THEN y END AS z FROM tracks)
  SELECT seq, frame, ROUND(CASE WHEN COUNT(x) OVER w >= 10 AND STDDEV_SAMP(x) OVER w * STDDEV_SAMP(z) OVER w > 0 THEN COVAR_SAMP(x, z) OVER w / (STDDEV_SAMP(x) OVER w * STDDEV_SAMP(z) OVER w) END, 4) AS v
  FROM both_ WINDOW w AS ({OVER} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def roll_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir).select("seq", "frame", rounded(correlation(F.col("x"), F.col("y"), 30, 10)).alias("v"))


@register("lag_lead", f"WITH {TRACKS} SELECT seq, frame, LAG(y, 5) OVER w AS before, LEAD(y, 5) OVER w AS after, y - LAG(y, 10) OVER w AS diff FROM tracks WINDOW w AS ({OVER})")
def lag_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, y = ordered(), F.col("y")
    return tracks(spark, sf_dir).select("seq", "frame", F.lag(y, 5).over(w).alias("before"), F.lead(y, 5).over(w).alias("after"), (y - F.lag(y, 10).over(w)).alias("diff"))


@register("third_difference", f"WITH {TRACKS} SELECT seq, frame, y - 3 * LAG(y, 1) OVER w + 3 * LAG(y, 2) OVER w - LAG(y, 3) OVER w AS jerk FROM tracks WINDOW w AS ({OVER})")
def third_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, y = ordered(), F.col("y")
    return tracks(spark, sf_dir).select("seq", "frame", (y - 3 * F.lag(y, 1).over(w) + 3 * F.lag(y, 2).over(w) - F.lag(y, 3).over(w)).alias("jerk"))


@register("speed", f"WITH {TRACKS}, d AS (SELECT seq, frame, fps, x - LAG(x) OVER w AS dx, y - LAG(y) OVER w AS dy FROM tracks WINDOW w AS ({OVER})) SELECT seq, frame, ROUND(SQRT(dx * dx + dy * dy) * fps, 4) AS speed FROM d")
def speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ordered()
    step = lambda c: F.col(c) - F.lag(c).over(w)
    return tracks(spark, sf_dir).select("seq", "frame", rounded(F.sqrt(step("x") * step("x") + step("y") * step("y")) * F.col("fps")).alias("speed"))


@register("state_share", f"""WITH {TRACKS}, s AS (SELECT seq, frame, action, CASE WHEN LAG(action) OVER ({OVER}) IS NULL OR action <> LAG(action) OVER ({OVER}) THEN 1 ELSE 0 END AS c FROM tracks)
  SELECT seq, frame, ROUND(AVG(CASE WHEN action = 'click' THEN 1.0 ELSE 0.0 END) OVER w, 4) AS share, CAST(SUM(c) OVER w AS BIGINT) AS changes FROM s WINDOW w AS ({OVER} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def state_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ordered().rowsBetween(-29, 0)
    t = tracks(spark, sf_dir).withColumn("c", changed(F.col("action")))
    return t.select("seq", "frame", rounded(F.avg(F.when(F.col("action") == "click", 1.0).otherwise(0.0)).over(w)).alias("share"), F.sum("c").over(w).cast("long").alias("changes"))


@register("interval_raster", f"WITH {SEGMENTS} SELECT DISTINCT t.seq AS agent, t.frame, s.action FROM tracks t JOIN segments s ON t.seq = s.agent AND t.frame BETWEEN s.start AND s.stop")
def interval_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = tracks(spark, sf_dir).select(F.col("seq").alias("agent"), "frame")
    return intervals.raster(frames, segments(spark, sf_dir).select("agent", "action", "start", "stop"), ["agent"]).select("agent", "frame", "action")


@register("argmax_threshold", f"""WITH {TRACKS}, scores AS (SELECT seq, frame, o AS ordinal, ((k * (o + 3)) % 101) / 100.0 AS prob FROM tracks, (VALUES (0), (1), (2)) v(o)),
  r AS (SELECT seq, frame, ordinal, prob, ROW_NUMBER() OVER (PARTITION BY seq, frame ORDER BY prob DESC, ordinal) AS n FROM scores)
  SELECT seq, frame, CASE WHEN prob >= 0.27 THEN ordinal ELSE -1 END AS state FROM r WHERE n = 1""")
def argmax_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir).select("seq", "frame", "k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("ordinal"))
    scores = t.withColumn("prob", ((F.col("k") * (F.col("ordinal") + 3)) % 101) / 100.0)
    return intervals.best_state(scores, ["seq"])


@register("run_lengths", f"""WITH {TRACKS}, s AS (SELECT seq, frame, CASE WHEN k < 20 THEN -1 ELSE k // 40 END AS state FROM tracks),
  e AS (SELECT *, LAG(state) OVER ({OVER}) AS p FROM s), c AS (SELECT * FROM e WHERE p IS NULL OR state <> p), r AS (SELECT seq, state, frame AS start, LEAD(frame) OVER ({OVER}) AS stop FROM c)
  SELECT seq, state, start, stop FROM r WHERE stop IS NOT NULL AND state <> -1 AND stop - start >= 3""")
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir)
    return intervals.run_lengths(t.select("seq", "frame", F.when(F.col("k") < 20, F.lit(-1)).otherwise(F.floor(F.col("k") / 40)).cast("long").alias("state")))


@register("greedy_nonoverlap", f"""WITH RECURSIVE {SEGMENTS}, o AS (SELECT agent, target, action, start, stop, ROW_NUMBER() OVER (PARTITION BY agent, target ORDER BY start, stop, action) AS n FROM segments),
  g AS (SELECT agent, target, action, start, stop, n, start >= 0 AS kept, stop AS last FROM o WHERE n = 1 UNION ALL
    SELECT o.agent, o.target, o.action, o.start, o.stop, o.n, o.start >= g.last, CASE WHEN o.start >= g.last THEN o.stop ELSE g.last END FROM g JOIN o ON o.agent = g.agent AND o.target = g.target AND o.n = g.n + 1)
  SELECT agent, target, action, start, stop FROM g WHERE kept""")
def greedy_nonoverlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.greedy(segments(spark, sf_dir), ["agent", "target"])


@register("timeline_repair", f"""WITH {SEGMENTS}, m AS (SELECT agent, MAX(stop) // 2 AS lim FROM segments GROUP BY agent),
  r AS (SELECT event_id, lim, LEAST(GREATEST(CAST(ROUND_EVEN(start * 25.0 / 30.0, 0) AS BIGINT), 0), lim) AS a, LEAST(GREATEST(CAST(ROUND_EVEN(stop * 25.0 / 30.0, 0) AS BIGINT), 0), lim) AS b FROM segments JOIN m USING (agent))
  SELECT event_id, LEAST(a, b) AS start, GREATEST(a, b) AS stop FROM r""")
def timeline_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    limit = s.groupBy("agent").agg(F.floor(F.max("stop") / 2).cast("long").alias("limit"))
    return intervals.repair(s.join(limit, "agent")).select("event_id", "start", "stop")


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = segments(spark, sf_dir).withColumn("lab", F.col("agent") % 3)
    return s.filter("event_id % 2 = 0"), s.filter("event_id % 2 = 1")


FRAMES = SEGMENTS + """, fr AS (SELECT event_id % 2 AS half, agent % 3 AS lab, agent, target, action, UNNEST(RANGE(start, stop)) AS frame, start, stop FROM segments WHERE start < stop)"""
SCORED = """c AS (SELECT COALESCE(a.lab, b.lab) AS lab, COALESCE(a.action, b.action) AS action, SUM(CASE WHEN a.frame IS NOT NULL AND b.frame IS NOT NULL THEN 1 ELSE 0 END) AS tp,
  SUM(CASE WHEN a.frame IS NULL THEN 1 ELSE 0 END) AS fp, SUM(CASE WHEN b.frame IS NULL THEN 1 ELSE 0 END) AS fn FROM t a FULL OUTER JOIN p b
  ON a.lab = b.lab AND a.agent = b.agent AND a.target = b.target AND a.action = b.action AND a.frame = b.frame GROUP BY 1, 2),
  f AS (SELECT lab, action, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CASE WHEN tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2.0 * tp + fn + fp) END AS f FROM c)"""
PLAIN = "t AS (SELECT DISTINCT lab, agent, target, action, frame FROM fr WHERE half = 0), p AS (SELECT DISTINCT lab, agent, target, action, frame FROM fr WHERE half = 1)"
FIRST = """q AS (SELECT half, lab, agent, target, action, frame, ROW_NUMBER() OVER (PARTITION BY half, lab, agent, target, frame ORDER BY start, stop, action) AS n FROM fr),
  t AS (SELECT * FROM q WHERE n = 1 AND half = 0), p AS (SELECT * FROM q WHERE n = 1 AND half = 1)"""


@register("score_by_action", f"WITH {FRAMES}, {PLAIN}, {SCORED} SELECT lab, action, tp, fp, fn, ROUND(f, 6) AS f FROM f")
def score_by_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    return scoring.f_beta(scoring.counts(a, b)).withColumn("f", rounded(F.col("f"), 6))


@register("score_macro", f"WITH {FRAMES}, {PLAIN}, {SCORED}, l AS (SELECT lab, AVG(f) AS f FROM f GROUP BY lab) SELECT ROUND(AVG(f), 6) AS score, COUNT(*) AS labs FROM l")
def score_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    return scoring.macro(scoring.f_beta(scoring.counts(a, b))).withColumn("score", rounded(F.col("score"), 6))


@register("score_first_wins", f"WITH {FRAMES}, {FIRST}, {SCORED} SELECT lab, action, tp, fp, fn, ROUND(f, 6) AS f FROM f")
def score_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (scoring.first_wins(scoring.dense(s)) for s in _halves(spark, sf_dir))
    return scoring.f_beta(scoring.counts(a, b)).withColumn("f", rounded(F.col("f"), 6))


@register("class_weights", f"WITH {TRACKS}, c AS (SELECT action, SUM(CASE WHEN k < 10 THEN 1 ELSE 0 END) AS p, SUM(CASE WHEN k >= 10 THEN 1 ELSE 0 END) AS n FROM tracks GROUP BY action) SELECT action, CAST(p AS BIGINT) AS pos, CAST(n AS BIGINT) AS neg, ROUND(GREATEST(n, 1) * 1.0 / GREATEST(p, 1), 6) AS weight FROM c")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.class_weights(tracks(spark, sf_dir).select("action", (F.col("k") < 10).alias("y")), "action").withColumn("weight", rounded(F.col("weight"), 6))


@register("downsample", f"""WITH {TRACKS}, l AS (SELECT action, event_id, k < 10 AS y FROM tracks), c AS (SELECT action, COUNT(*) FILTER (y) AS p, COUNT(*) FILTER (NOT y) AS n FROM l GROUP BY action),
  r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY action, y ORDER BY MD5(CAST(event_id AS VARCHAR)), event_id) AS i FROM l JOIN c USING (action))
  SELECT action, event_id, y FROM r WHERE y OR i <= CASE WHEN p * 1.0 / (p + n) >= 0.3 THEN n ELSE LEAST(GREATEST(FLOOR(CAST(p AS DOUBLE) * (CAST(1 AS DOUBLE) - CAST(0.3 AS DOUBLE)) / CAST(0.3 AS DOUBLE)), 1), n) END""")
def downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.downsample(tracks(spark, sf_dir).select("action", "event_id", (F.col("k") < 10).alias("y")), "action", "event_id", 0.3)


@register("group_hold_out", "WITH g AS (SELECT DISTINCT user_id FROM events), r AS (SELECT user_id, ROW_NUMBER() OVER (ORDER BY MD5(CAST(user_id AS VARCHAR)), user_id) AS n, COUNT(*) OVER () AS c FROM g) SELECT user_id, n <= GREATEST(1, CAST(FLOOR(c * 0.1) AS BIGINT)) AS held_out FROM r")
def group_hold_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.hold_out(table(spark, sf_dir, "events"), "user_id")


@register("directed_pairs", f"WITH {POSES} SELECT a.entity AS agent, b.entity AS target, a.frame, ROUND(SQRT((a.ax - b.ax) * (a.ax - b.ax) + (a.ay - b.ay) * (a.ay - b.ay)), 4) AS distance FROM poses a JOIN poses b ON a.frame = b.frame AND a.entity <> b.entity")
def directed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = poses(spark, sf_dir).select(F.col("entity").alias("agent"), "frame", "ax", "ay")
    b = poses(spark, sf_dir).select(F.col("entity").alias("target"), "frame", F.col("ax").alias("bx"), F.col("ay").alias("by"))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    return a.join(b, "frame").filter("agent <> target").select("agent", "target", "frame", rounded(F.sqrt(dx * dx + dy * dy)).alias("distance"))


@register("centroid", f"WITH {POSES} SELECT entity, frame, ROUND((ax + bx) / 2, 4) AS cx, ROUND(LEAST(ay, by2), 4) AS low FROM poses")
def centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poses(spark, sf_dir).select("entity", "frame", rounded((F.col("ax") + F.col("bx")) / 2).alias("cx"), rounded(F.least("ay", "by")).alias("low"))


@register("lookup_fallback", """WITH m AS (SELECT r_name AS lab, c_custkey AS video, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS width FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  d AS (SELECT lab, MEDIAN(width) AS usual FROM m GROUP BY lab) SELECT video, ROUND(COALESCE(CASE WHEN width > 100 THEN width END, usual, 12.4), 4) AS width FROM m JOIN d USING (lab)""")
def lookup_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = recordings(spark, sf_dir)
    usual = m.groupBy("lab").agg(F.median("width").alias("usual"))
    return m.join(usual, "lab", "left").select("video", rounded(F.coalesce(F.when(F.col("width") > 100, F.col("width")), "usual", F.lit(12.4))).alias("width"))


@register("anti_missing", "SELECT c_custkey AS video FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("video"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("video")).join(orders, "video", "left_anti")


@register("pivot_actions", f"WITH {TRACKS} SELECT seq, fps, " + ", ".join(f"CAST(COUNT(*) FILTER (action = '{a}') AS BIGINT) AS n_{a}" for a in ("click", "view", "purchase")) + " FROM tracks GROUP BY seq, fps")
def pivot_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda a: F.sum(F.when(F.col("action") == a, 1).otherwise(0)).cast("long").alias(f"n_{a}")
    return tracks(spark, sf_dir).groupBy("seq", "fps").agg(*map(n, ("click", "view", "purchase")))


@register("frame_extent", f"WITH {TRACKS} SELECT seq, MIN(frame) AS first, MAX(frame) AS last, CAST(COUNT(x) AS BIGINT) AS present, ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT action)), ',') AS actions FROM tracks GROUP BY seq")
def frame_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir).groupBy("seq").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("x").alias("present"), F.array_join(F.array_sort(F.collect_set("action")), ",").alias("actions"))
