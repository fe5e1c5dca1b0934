"""Registered queries of metadata predicates, tracking rows, labels, splits and models, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrail.functions.geometry import middle, point, tracked
from kinetrail.operators import boosting, intervals, labels, models, sampling, scoring
from kinetrail.plans.catalog import FRAMES as SCORE_FRAMES
from kinetrail.plans.catalog import PLAIN, QUERIES, SCORED, SEGMENTS, TRACKS, _halves, register
from kinetrail.plans.families import FRAMES_SQL
from kinetrail.sources import recordings as R
from kinetrail.sources.tables import PARTS, frames, segments, table, tracks

STRAINS = ["mouse1_strain", "mouse2_strain", "mouse3_strain", "mouse4_strain"]
META = """meta AS (SELECT r_name AS lab_id, CAST(c_custkey AS BIGINT) AS video_id, CASE c_custkey % 4 WHEN 0 THEN 25.0 WHEN 1 THEN 30.0 WHEN 2 THEN 50.0 END AS fps, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS mouse1_strain, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS mouse2_strain,
  CASE WHEN c_acctbal > 5000 THEN c_mktsegment END AS mouse3_strain, c_mktsegment AS mouse4_strain, CASE c_custkey % 5 WHEN 0 THEN 'Lights On' WHEN 1 THEN 'lights on' WHEN 2 THEN 'lights off' END AS mouse1_condition, CASE WHEN c_custkey % 3 = 1 THEN '["nose","tail_base"]' ELSE '["nose"]' END AS body_parts_tracked,
  CASE WHEN c_custkey % 7 <> 0 THEN '["mouse1,self,rear","mouse1,mouse2,chase"]' END AS behaviors_labeled FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    fps = F.when(k % 4 == 0, 25.0).when(k % 4 == 1, 30.0).when(k % 4 == 2, 50.0)
    return rows.select(
        F.col("r_name").alias("lab_id"), k.cast("long").alias("video_id"), fps.alias("fps"), F.when(k % 2 == 0, seg).alias("mouse1_strain"), F.when(k % 3 == 0, seg).alias("mouse2_strain"), F.when(F.col("c_acctbal") > 5000, seg).alias("mouse3_strain"),
        seg.alias("mouse4_strain"), F.when(k % 5 == 0, "Lights On").when(k % 5 == 1, "lights on").when(k % 5 == 2, "lights off").alias("mouse1_condition"), F.when(k % 3 == 1, '["nose","tail_base"]').otherwise('["nose"]').alias("body_parts_tracked"),
        F.when(k % 7 != 0, '["mouse1,self,rear","mouse1,mouse2,chase"]').alias("behaviors_labeled"),
    )


@register("metadata_selection", f"""WITH {META}, m AS (SELECT *, COALESCE(contains(lab_id, 'AS') AND LOWER(mouse1_condition) = 'lights on', FALSE) AS sleeping FROM meta)
  SELECT video_id, CAST((mouse1_strain IS NOT NULL)::INT + (mouse2_strain IS NOT NULL)::INT + (mouse3_strain IS NOT NULL)::INT + (mouse4_strain IS NOT NULL)::INT AS INTEGER) AS n_mice
  FROM m WHERE behaviors_labeled IS NOT NULL AND video_id NOT IN (11, 12) AND body_parts_tracked = '["nose"]' AND NOT sleeping""")
def metadata_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.select_recordings(R.require(metadata(spark, sf_dir), ["lab_id", "video_id"]), "AS", STRAINS, '["nose"]', [11, 12]).select("video_id", "n_mice")


@register("sleeping_flag", f"WITH {META} SELECT video_id, COALESCE(contains(lab_id, 'AS') AND LOWER(mouse1_condition) = 'lights on', FALSE) AS sleeping FROM meta")
def sleeping_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata(spark, sf_dir).select("video_id", R.sleeping("AS").alias("sleeping"))


def tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long rows (video_id, mouse_id, video_frame, bodypart, x, y, per_cm); odd videos have four parts only."""
    f = frames(spark, sf_dir)
    cells = F.array(*(F.struct(F.lit(p).alias("bodypart"), F.coalesce(f"{p}_x", F.lit(float("nan"))).alias("x"), F.col(f"{p}_y").alias("y")) for p in PARTS))
    rows = f.select(F.col("video").alias("video_id"), F.col("entity").alias("mouse_id"), F.col("frame").alias("video_frame"), (F.col("fps") / 10).alias("per_cm"), F.explode(cells).alias("c")).select("*", "c.*").drop("c")
    return rows.filter((F.col("video_id") % 2 == 0) | F.col("bodypart").isin(*PARTS[:4]))


_WIDE = ("nose", "ear_left", "lateral_left")


@register("pose_pivot", f"WITH {FRAMES_SQL} SELECT video AS video_id, entity AS mouse_id, frame AS video_frame, " + ", ".join(f"{p}_{c} / (fps / 10.0) AS {p}_{c}" for p in _WIDE[:2] for c in "xy") + ", " + ", ".join(f"CASE WHEN video % 2 = 0 AND FALSE THEN {_WIDE[2]}_{c} END AS {_WIDE[2]}_{c}" for c in "xy") + " FROM fr")
def pose_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.drop_parts(tracking(spark, sf_dir), ["lateral_left", "lateral_right"])
    return R.wide(rows, list(_WIDE), per_cm="per_cm", keys=("video_id", "mouse_id", "video_frame", "per_cm")).drop("per_cm")


@register("null_skipping_centroid", f"WITH {FRAMES_SQL} SELECT seq, frame, " + ", ".join(f"LIST_AVG([{', '.join(f'{p}_{c}' for p in PARTS)}]) AS c{c}" for c in "xy") + " FROM fr")
def null_skipping_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    x, y = middle([point(p) for p in tracked(f)])
    return f.select("seq", "frame", x.alias("cx"), y.alias("cy"))


@register("three_valued_labels", f"""WITH {SEGMENTS}, lab AS (SELECT DISTINCT agent, action FROM segments WHERE target = 0 AND start % 5 = 0)
  SELECT t.seq AS agent, t.frame, l.action, EXISTS (SELECT 1 FROM segments s WHERE s.agent = t.seq AND s.action = l.action AND s.target = 0 AND t.frame BETWEEN s.start AND s.stop) AS y FROM tracks t JOIN lab l ON t.seq = l.agent""")
def three_valued_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).filter("target = 0")
    f = tracks(spark, sf_dir).select(F.col("seq").alias("agent"), "frame")
    return R.labelled_frames(f, s.filter("start % 5 = 0"), intervals.raster(f, s, ["agent"]), ["agent"])


@register("trainable_rows", f"WITH {TRACKS}, r AS (SELECT event_id, action, k < 10 AND action <> 'view' AS y FROM tracks), b AS (SELECT action FROM r WHERE action IN ('click', 'view', 'purchase') GROUP BY action HAVING COUNT(DISTINCT y) > 1) SELECT event_id, action, y FROM r WHERE action IN (SELECT action FROM b)")
def trainable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracks(spark, sf_dir).select("event_id", "action", ((F.col("k") < 10) & (F.col("action") != "view")).alias("y"))
    return R.trainable(rows, ["click", "view", "purchase"])


@register("aligned_columns", f"WITH {TRACKS} SELECT event_id, CAST(y AS REAL) AS y, CAST(0 AS REAL) AS absent, CAST(x AS REAL) AS x FROM tracks")
def aligned_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.aligned(tracks(spark, sf_dir), ["y", "absent", "x"], ["event_id"])


_PROBS = "s AS (SELECT seq, frame, o AS ordinal, ['dig', 'rear', 'rest'][o + 1] AS action, ((k * (o + 3)) % 101) / 100.0 AS prob FROM tracks, (VALUES (0), (1), (2)) v(o))"


@register("action_thresholds", f"""WITH {TRACKS}, {_PROBS}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY seq, frame ORDER BY prob DESC, ordinal) AS n FROM s)
  SELECT seq, frame, CASE WHEN prob >= CASE action WHEN 'dig' THEN 0.9 WHEN 'rest' THEN 0.6 ELSE 0.27 END THEN action END AS action FROM r WHERE n = 1""")
def action_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir).select("seq", "frame", "k", F.posexplode(F.array(F.lit("dig"), F.lit("rear"), F.lit("rest"))).alias("ordinal", "action"))
    scores = t.withColumn("prob", ((F.col("k") * (F.col("ordinal") + 3)) % 101) / 100.0)
    return intervals.best_actions(scores, ["seq"], spark.createDataFrame([("dig", 0.9), ("rest", 0.6)], "action string, threshold double"))


@register("ensemble_means", f"WITH {TRACKS}, {_PROBS} SELECT seq, frame, AVG(prob) AS prob FROM s WHERE action IN (SELECT CASE WHEN k % 2 = 0 THEN 'dig' ELSE 'rest' END FROM tracks) GROUP BY seq, frame")
def ensemble_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir)
    members = t.select("seq", "frame", "k", F.posexplode(F.array(F.lit("dig"), F.lit("rear"), F.lit("rest"))).alias("ordinal", "action"))
    usable = models.available(members, t.select(F.when(F.col("k") % 2 == 0, "dig").otherwise("rest").alias("action")))
    return models.ensemble_mean(usable.withColumn("prob", ((F.col("k") * (F.col("ordinal") + 3)) % 101) / 100.0), ["seq", "frame"])


@register("rows_split", "SELECT event_id, CAST(('0x' || SUBSTR(MD5(event_id || '|7'), 1, 8)) AS BIGINT) / 4294967296.0 < 0.1 AS held_out FROM events")
def rows_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split_rows(table(spark, sf_dir, "events").select("event_id"), "event_id", 0.1, 7)


@register("rows_capped", "SELECT event_id FROM events ORDER BY MD5(event_id || '|7'), event_id LIMIT 1000")
def rows_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.cap_rows(table(spark, sf_dir, "events").select("event_id"), "event_id", 1000, 7)


@register("single_action_targets", f"""WITH {SEGMENTS}, f AS (SELECT action, ARG_MIN(agent = target, event_id) AS alone FROM segments GROUP BY action)
  SELECT event_id, CASE WHEN alone OR s.action = 'view' THEN agent ELSE target END AS target FROM segments s JOIN f USING (action)""")
def single_action_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).withColumn("row", F.col("event_id"))
    return labels.single_targets(s, ["view"]).select("event_id", "target")


@register("active_label_triples", f"""WITH {SEGMENTS}, f AS (SELECT agent, ARG_MIN(action, event_id) AS action, ARG_MIN(target, event_id) AS target FROM segments GROUP BY agent)
  SELECT event_id, s.agent, s.action FROM segments s JOIN f ON s.agent = f.agent AND s.action = f.action AND s.target IN (f.target, f.agent)""")
def active_label_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).select("event_id", F.col("agent").alias("video"), F.col("agent").cast("string").alias("agent"), F.col("target").cast("string").alias("target"), "action")
    mouse = F.concat(F.lit("mouse"), "agent")
    listed = F.to_json(F.array(F.concat_ws(",", mouse, F.concat(F.lit("mouse"), "target"), "action"), F.concat_ws(",", mouse, F.lit("self"), "action")))
    found = labels.active_triples(s, s.select("video", F.col("event_id").alias("row"), listed.alias("labels_of")), "video")
    return found.select("event_id", F.col("agent").cast("long").alias("agent"), "action")


@register("score_granular", f"""WITH {SCORE_FRAMES}, {PLAIN}, {SCORED}, w AS (SELECT action, CAST(SUM(tp) AS BIGINT) AS tp, CAST(SUM(fp) AS BIGINT) AS fp, CAST(SUM(fn) AS BIGINT) AS fn FROM c GROUP BY action),
  k AS (SELECT action, CASE WHEN ARG_MIN(agent = target, event_id) OR action = 'view' THEN 'single' ELSE 'pair' END AS switch FROM segments WHERE event_id % 2 = 0 GROUP BY action)
  SELECT COALESCE(switch, 'unknown') AS switch, action, tp, fp, fn, tp + fn AS support, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS prec, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS recall,
    CASE WHEN tp + fp + fn = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fn + fp) END AS f FROM w LEFT JOIN k USING (action)""")
def score_granular(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    kinds = scoring.categories(a.withColumn("row", F.col("event_id")), ["view"])
    return scoring.granular(scoring.counts(a, b), kinds).select("switch", "action", "tp", "fp", "fn", "support", "prec", "recall", "f")


def boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of one action trained on the sequences that are not held out, and its probabilities on all rows. No SQL: the
    trees are the library's own."""
    rows = tracks(spark, sf_dir).select("event_id", "seq", "frame", "x", "y", (F.col("k") < 30).alias("label"))
    split = sampling.split_rows(rows, "event_id", 0.3).withColumn("y", F.col("y") + F.coalesce("x", F.lit(0.0)) / 100)
    fitted = models.train(split.filter("not held_out").select("x", F.col("y").alias("feature"), F.col("label").alias("y")), ["x", "feature"], trees=5, depth=3)
    scored = models.score(split.withColumn("feature", F.col("y")), ["x", "feature"], [fitted, fitted])
    return scored.select("event_id", "held_out", "prob")


QUERIES["boosted_trees"] = boosted_trees


_LABELLED = f"""WITH {TRACKS}, l AS (SELECT fps AS section, CASE WHEN seq % 2 = 0 THEN 'single' ELSE 'pair' END AS branch, a.action, t.action = a.action AS y FROM tracks t, (SELECT DISTINCT action FROM tracks) a),
  c AS (SELECT section, branch, action, CAST(COUNT(*) FILTER (y) AS BIGINT) AS pos, CAST(COUNT(*) FILTER (NOT y) AS BIGINT) AS neg FROM l GROUP BY ALL)
  SELECT section, branch, action, pos, neg, pos AS used_pos, CASE WHEN CAST(pos AS DOUBLE) / (pos + neg) >= CAST(0.3 AS DOUBLE) THEN neg ELSE LEAST(GREATEST(CAST(FLOOR(pos * (1 - CAST(0.3 AS DOUBLE)) / CAST(0.3 AS DOUBLE)) AS BIGINT), 1), neg) END AS used_neg, 4 AS trees
  FROM c WHERE pos > 0 AND neg > 0"""


#: Kinds of events: fixed values.
ACTIONS = ("signup", "click", "error", "view", "purchase")


@register("boosted_actions", _LABELLED)
def boosted_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of every action of every section and branch, each on its own resampled rows: what it was fitted on."""
    t = tracks(spark, sf_dir).select("event_id", "action", "x", F.col("y").alias("value"), F.col("fps").alias("section"), F.when(F.col("seq") % 2 == 0, "single").otherwise("pair").alias("branch"))
    rows = t.withColumn("listed", F.explode(F.array(*map(F.lit, ACTIONS)))).select("section", "branch", F.col("listed").alias("action"), "event_id", (F.col("action") == F.col("listed")).alias("y"), "x", "value")
    found = boosting.fit_all(rows, ["section", "branch", "action"], ["x", "value"], "event_id", boosting.Settings(trees=4, depth=3))
    return found.select("section", "branch", "action", "pos", "neg", "used_pos", "used_neg", F.size(F.array_distinct(F.transform("nodes", lambda n: n["tree"]))).alias("trees"))


_OFFICIAL = f"""WITH {SEGMENTS}, g AS (SELECT *, agent AS video, agent % 3 AS lab FROM segments), truth AS (SELECT * FROM g WHERE event_id % 2 = 0 AND agent <> 3), guess AS (SELECT * FROM g WHERE event_id % 2 = 1),
  one AS (SELECT video, ARG_MIN(action, event_id) AS x1, ARG_MAX(action, event_id) AS x2 FROM truth GROUP BY video),
  act AS (SELECT guess.* FROM guess JOIN one USING (video) WHERE start < stop AND guess.action IN (x1, x2)),
  fr AS (SELECT video, lab, agent, target, action, event_id, UNNEST(RANGE(start, stop)) AS frame FROM act),
  p AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY video, agent, target, frame ORDER BY event_id) AS n FROM fr) WHERE n = 1),
  t AS (SELECT DISTINCT lab, agent, target, action, UNNEST(RANGE(start, stop)) AS frame FROM truth WHERE start < stop), {SCORED}
  SELECT lab, action, tp, fp, fn, f FROM f"""


@register("score_listed", _OFFICIAL)
def score_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of recordings that the solution has, whose label its first row lists, the first row in the table's own
    order taking a frame that several cover."""
    s = segments(spark, sf_dir).withColumns({"video": F.col("agent"), "lab": F.col("agent") % 3, "row": F.col("event_id")})
    truth, guess = s.filter("event_id % 2 = 0 AND agent <> 3"), s.filter("event_id % 2 = 1")
    told = truth.groupBy("video").agg(F.concat_ws(",", F.min_by("action", "row"), F.max_by("action", "row")).alias("labels_of")).withColumn("row", F.lit(0))
    kept = labels.active(scoring.within(guess, truth, "video"), told, "video", ["action"])
    return scoring.f_beta(scoring.counts(truth, scoring.first_wins(kept)))


@register("frames_without_events", f"WITH {TRACKS}, h AS (SELECT DISTINCT seq, frame FROM tracks WHERE action = 'view') SELECT seq, frame FROM tracks WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.seq = tracks.seq AND h.frame + 1 = tracks.frame)")
def frames_without_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that no view precedes: an anti-join that keeps most rows."""
    t = tracks(spark, sf_dir)
    return t.select("seq", "frame").join(t.filter("action = 'view'").select("seq", (F.col("frame") + 1).alias("frame")), ["seq", "frame"], "left_anti")
