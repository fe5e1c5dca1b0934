"""Registered queries of the one-entity feature families, and their SQL, in which a window's width is an expression of
each row's rate."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession

from kinetrail.functions import motion
from kinetrail.functions.sequences import features
from kinetrail.plans.catalog import register
from kinetrail.sources.tables import PARTS, frames

_COORDS = ", ".join(f"CASE WHEN (vec_id + {i}) % 17 <> 0 THEN CAST(embedding[{2 * i + k + 1}] AS DOUBLE) * 10 + {(20, 15)[k]} END AS {p}_{'xy'[k]}" for i, p in enumerate(PARTS) for k in (0, 1))
FRAMES_SQL = f"""fr0 AS (SELECT *, vec_id // 250 AS video, CAST(label % 2 AS BIGINT) AS entity FROM embeddings),
  fr AS (SELECT video, entity, video * 2 + entity AS seq, ROW_NUMBER() OVER (PARTITION BY video, entity ORDER BY vec_id) - 1 AS frame, CASE video % 3 WHEN 0 THEN 25 WHEN 1 THEN 30 ELSE 50 END AS fps, video % 2 = 0 AS circ, {_COORDS} FROM fr0)"""


def n(width: int) -> str:
    """Frames of a window given for 30 a second."""
    return f"CAST(GREATEST(1, ROUND_EVEN({width} * fps / 30.0, 0)) AS BIGINT)"


def _over(low: str, high: str) -> str:
    return f"OVER (PARTITION BY seq ORDER BY frame ROWS BETWEEN {low} AND {high})"


def _roll(agg: str, c: str, least: str, w: str) -> str:
    return f"CASE WHEN COUNT({c}) {w} >= {least} THEN {agg}({c}) {w} END"


def past(agg: str, c: str, width: str, least: str = "1") -> str:
    return _roll(agg, c, least, _over(f"({width}) - 1 PRECEDING", "CURRENT ROW"))


def mid(agg: str, c: str, width: str, least: str = "1") -> str:
    return _roll(agg, c, least, _over(f"({width}) // 2 PRECEDING", f"(({width}) - 1) // 2 FOLLOWING"))


def ahead(agg: str, c: str, width: str, least: str = "1") -> str:
    return _roll(agg, c, least, _over("CURRENT ROW", f"({width}) - 1 FOLLOWING"))


def lag(c: str, k: str = "1") -> str:
    return f"LAG({c}, {k}) OVER (PARTITION BY seq ORDER BY frame)"


def lead(c: str, k: str) -> str:
    return f"LEAD({c}, {k}) OVER (PARTITION BY seq ORDER BY frame)"


def part_of(width: str, k: int, least: int = 1) -> str:
    return f"GREATEST({least}, ({width}) // {k})"


def moved(x: str, y: str, k: str = "1") -> str:
    """Way from k rows before."""
    return f"SQRT(POW({x} - {lag(x, k)}, 2) + POW({y} - {lag(y, k)}, 2))"


def gap2(a: str, b: str) -> str:
    return f"(POW({a}_x - {b}_x, 2) + POW({a}_y - {b}_y, 2))"


def select(columns: dict[str, str], source: str, keys: str = "seq, frame") -> str:
    return f"SELECT {keys}, " + ", ".join(f'{v} AS "{k}"' for k, v in columns.items()) + f" FROM {source}"


CX, CY = "body_center_x", "body_center_y"
LONG = "COUNT(*) OVER (PARTITION BY seq)"


def _distances() -> str:
    out = {f"{a}+{b}": gap2(a, b) for a, b in combinations(PARTS, 2)}
    for name, a, b in (("sp_lf", "ear_left", "ear_left"), ("sp_rt", "ear_right", "ear_right"), ("sp_lf2", "ear_left", "tail_base"), ("sp_rt2", "ear_right", "tail_base")):
        out[name] = f"POW({a}_x - {lag(b + '_x', n(10))}, 2) + POW({a}_y - {lag(b + '_y', n(10))}, 2)"
    out["elong"] = f"{gap2('nose', 'tail_base')} / ({gap2('ear_left', 'ear_right')} + 1e-6)"
    u, v = ("nose_x - body_center_x", "nose_y - body_center_y"), ("tail_base_x - body_center_x", "tail_base_y - body_center_y")
    out["body_ang"] = f"(({u[0]}) * ({v[0]}) + ({u[1]}) * ({v[1]})) / (SQRT({gap2('nose', 'body_center')}) * SQRT({gap2('tail_base', 'body_center')}) + 1e-6)"
    return f"WITH {FRAMES_SQL} " + select(out, "fr")


def _centre_windows() -> str:
    out = {}
    for w in (5, 15, 30, 60):
        for a, c in (("x", CX), ("y", CY)):
            out |= {f"c{a}_m{w}": mid("AVG", c, n(w)), f"c{a}_s{w}": mid("STDDEV_SAMP", c, n(w)), f"{a}_rng{w}": f"{mid('MAX', c, n(w))} - {mid('MIN', c, n(w))}"}
        out[f"disp{w}"] = f"SQRT(POW({past('SUM', 'dx', n(w))}, 2) + POW({past('SUM', 'dy', n(w))}, 2))"
        out[f"act{w}"] = f"SQRT({past('VAR_SAMP', 'dx', n(w))} + {past('VAR_SAMP', 'dy', n(w))})"
    return f"WITH {FRAMES_SQL}, d AS (SELECT *, {CX} - {lag(CX)} AS dx, {CY} - {lag(CY)} AS dy FROM fr) " + select(out, "d")


def _kinematics() -> str:
    out = {}
    for k in (1, 2, 5, 10, 20, 40):
        way = f"COALESCE({moved(CX, CY, n(k))}, 0)"
        out |= {f"c_disp_l{k}": way, f"c_sp_l{k}": f"{way} * fps / {n(k)}"}
    out |= {"c_v": "v", "c_a": "a", "c_j": "j"}
    for w in (5, 15, 30, 60, 120):
        q = part_of(n(w), 4)
        m, s = past("AVG", "v", n(w), q), past("STDDEV_SAMP", "v", n(w), q)
        out |= {f"c_v_m{w}": m, f"c_v_s{w}": s, f"c_v_max{w}": past("MAX", "v", n(w), q), f"c_v_cv{w}": f"({s}) / (({m}) + 1e-6)"}
        out |= {f"c_a_m{w}": past("AVG", "a", n(w), q), f"c_a_s{w}": past("STDDEV_SAMP", "a", n(w), q), f"c_j_m{w}": past("AVG", "j", n(w), q)}
    short, long = (past("AVG", "v", n(w), part_of(n(w), 3)) for w in (15, 90))
    out |= {"c_v_contrast_15_90": f"COALESCE(({short}) - ({long}), 0)", "c_v_ratio_15_90": f"COALESCE(({short}) / (({long}) + 1e-6), 0)"}
    out |= {f"c_active_{s}s": past("AVG", "active", n(30 * s)) for s in (1, 3)}
    return f"""WITH {FRAMES_SQL}, s1 AS (SELECT *, COALESCE({moved(CX, CY)}, 0) * fps AS v FROM fr),
      s2 AS (SELECT *, COALESCE(v - {lag('v')}, 0) * fps AS a, {past('MEDIAN', 'v', n(60))} AS typical FROM s1),
      s3 AS (SELECT *, COALESCE(a - {lag('a')}, 0) * fps AS j, CASE WHEN v > typical + 1.0 THEN 1.0 ELSE 0.0 END::DOUBLE AS active FROM s2) """ + select(out, "s3")


def _paths() -> str:
    out = {}
    for s in (1, 3):
        w = f"GREATEST(5, {s} * fps)"
        path, net = past("SUM", "way", w, f"({w}) // 2"), f"COALESCE({moved(CX, CY, w)}, 0)"
        out |= {f"tortuosity_{s}s": f"({path}) / ({net} + 0.1)", f"move_eff_{s}s": f"{net} / (({path}) + 1.0)"}
    out["path_cum180"] = f"COALESCE({mid('SUM', 'step', f'2 * {n(180)} + 1', part_of(n(180), 6, 5))}, 0)"
    for w in (30, 90):
        out[f"path_eff_{w}"] = f"{moved(CX, CY, n(w))} / (({past('SUM', 'step', n(w))}) + 1e-6)"
    w = f"GREATEST(3, {n(30)})"
    q = part_of(w, 4, 3)
    out["spd_asym_1s"] = f"COALESCE(({ahead('AVG', 'v', w, q)}) - ({past('AVG', 'v', w, q)}), 0)"
    out["spd_asym_median_1s"] = f"COALESCE(({ahead('MEDIAN', 'v', w, q)}) - ({past('MEDIAN', 'v', w, q)}), 0)"
    out["spd_symkl_1s"] = "COALESCE(0.5 * (vp / vf + POW(mf - mp, 2) / vf - 1 + LN(vf / vp)) + 0.5 * (vf / vp + POW(mp - mf, 2) / vp - 1 + LN(vp / vf)), 0)"
    w = f"GREATEST(5, {n(30)})"
    q = part_of(w, 4, 3)
    moments = ", ".join(f"{x} AS {c}" for c, x in {"mp": past("AVG", "v", w, q), "mf": ahead("AVG", "v", w, q), "vp0": past("VAR_SAMP", "v", w, q), "vf0": ahead("VAR_SAMP", "v", w, q)}.items())
    clip = ", ".join(f"CASE WHEN {c}0 IS NOT NULL THEN GREATEST({c}0, 1e-6) END AS {c}" for c in ("vp", "vf"))
    return f"""WITH {FRAMES_SQL}, s1 AS (SELECT *, {moved(CX, CY)} AS step FROM fr), s2 AS (SELECT *, COALESCE(step, 0) AS way, COALESCE(step, 0) * fps AS v FROM s1),
      s3 AS (SELECT *, {moments} FROM s2), s4 AS (SELECT *, {clip} FROM s3) """ + select(out, "s4")


def _turns() -> str:
    out = {f"curv_mean_{w}": past("AVG", "bend", n(w), part_of(n(w), 6)) for w in (15, 30, 60)}
    out |= {f"turn_rate_{w}": past("SUM", "turn", n(w), part_of(n(w), 6)) for w in (15, 30)}
    return f"""WITH {FRAMES_SQL}, d AS (SELECT *, {CX} - {lag(CX)} AS dx, {CY} - {lag(CY)} AS dy FROM fr),
      e AS (SELECT *, ABS(dx * (dy - {lag('dy')}) - dy * (dx - {lag('dx')})) / (POW(SQRT(dx * dx + dy * dy), 3) + 1e-6) AS bend, ABS(ATAN2(dy, dx) - {lag('ATAN2(dy, dx)')}) AS turn FROM d) """ + select(out, "e")


def _scales() -> str:
    out = {}
    for w in (5, 10, 20, 40, 160, 320):
        for name, agg in (("m", "AVG"), ("s", "STDDEV_SAMP")):
            out[f"sp_{name}{w}"] = f"CASE WHEN {LONG} >= {n(w)} THEN {past(agg, 's', n(w), part_of(n(w), 4))} END"
    inner = f"WITH {FRAMES_SQL}, d AS (SELECT *, {moved(CX, CY)} * fps AS s FROM fr), m AS ({select(out, 'd')}) "
    return inner + "SELECT *, sp_m5 / (sp_m40 + 1e-6) AS sp_ratio_5_40, sp_m10 / (sp_m160 + 1e-6) AS sp_ratio_10_160 FROM m"


def _states() -> str:
    out = {}
    for w in (30, 60, 120):
        gate = f"CASE WHEN {LONG} >= {n(w)} THEN"
        out |= {f"s{k}_{w}": f"{gate} {past('AVG', f'in{k}', n(w), part_of(n(w), 6))} END" for k in range(4)}
        out[f"trans_{w}"] = f"{gate} {past('SUM', 'change', n(w), part_of(n(w), 6))} END"
    kinds = ", ".join(f"CASE WHEN state = {k} THEN 1.0 ELSE 0.0 END::DOUBLE AS in{k}" for k in range(4))
    return f"""WITH {FRAMES_SQL}, d AS (SELECT *, {moved(CX, CY)} * fps AS s FROM fr), m AS (SELECT *, {past('AVG', 's', n(15), part_of(n(15), 3))} AS m FROM d),
      t AS (SELECT *, CASE WHEN m <= 0.5 THEN 0 WHEN m <= 2 THEN 1 WHEN m <= 5 THEN 2 WHEN m IS NOT NULL THEN 3 END AS state FROM m),
      u AS (SELECT *, {kinds}, CASE WHEN state = {lag('state')} THEN 0.0 ELSE 1.0 END::DOUBLE AS change FROM t) """ + select(out, "u")


def _long_range() -> str:
    out = {f"{a}_ml{w}": f"CASE WHEN {LONG} >= {n(w)} THEN {past('AVG', c, n(w), part_of(n(w), 6, 5))} END" for a, c in (("x", CX), ("y", CY)) for w in (120, 240)}
    rank = "(LEN(LIST_FILTER(a{w}, lambda v: v < s)) + (LEN(LIST_FILTER(a{w}, lambda v: v = s)) + 1) / 2.0) / LEN(a{w})"
    out |= {f"sp_pct{w}": f"CASE WHEN {LONG} >= {n(w)} AND s IS NOT NULL AND LEN(a{w}) >= {part_of(n(w), 6, 5)} THEN {rank.format(w=w)} END" for w in (60, 120, 240)}
    held = ", ".join(f"LIST(s) FILTER (s IS NOT NULL) {_over(f'{n(w)} - 1 PRECEDING', 'CURRENT ROW')} AS a{w}" for w in (60, 120, 240))
    q = lambda span: f"POW(CAST(1 AS DOUBLE) - CAST(2 AS DOUBLE) / ({n(span).replace('fps', 'a.fps')} + 1), a.frame - b.frame)"
    means = ", ".join(f"SUM(b.{c} * {q(s)}) / SUM(CASE WHEN b.{c} IS NOT NULL THEN {q(s)} END) AS {x}_e{s}" for x, c in (("x", CX), ("y", CY)) for s in (60, 120, 240))
    # a missing value keeps the mean before it
    kept = ", ".join(f"LAST_VALUE(CASE WHEN {c} IS NOT NULL THEN {x}_e{s} END IGNORE NULLS) OVER (PARTITION BY seq ORDER BY frame) AS {x}_e{s}" for x, c in (("x", CX), ("y", CY)) for s in (60, 120, 240))
    return f"""WITH {FRAMES_SQL}, d AS (SELECT *, {moved(CX, CY)} * fps AS s FROM fr), h AS (SELECT *, {held} FROM d), o AS ({select(out, 'h')}),
      e0 AS (SELECT a.seq, a.frame, ANY_VALUE(a.{CX}) AS {CX}, ANY_VALUE(a.{CY}) AS {CY}, {means} FROM fr a JOIN fr b ON a.seq = b.seq AND b.frame <= a.frame GROUP BY a.seq, a.frame, a.fps),
      e AS (SELECT seq, frame, {kept} FROM e0) SELECT * FROM o JOIN e USING (seq, frame)"""


def _grooming() -> str:
    out = {}
    for w, tag in ((6, "0p2s"), (9, "0p3s"), (15, "0p5s"), (30, "1p0s")):
        over = lambda agg, c: past(agg, c, n(w), part_of(n(w), 3))  # noqa: B023, E731
        out |= {f"groom_hbd_med_{tag}": over("MEDIAN", "ratio"), f"groom_hbd_mean_{tag}": over("AVG", "ratio"), f"groom_nose_rad_std_{tag}": f"COALESCE({over('STDDEV_SAMP', 'r')}, 0)"}
        out |= {f"groom_cs_mean_{tag}": over("AVG", "cs"), f"groom_ns_mean_{tag}": over("AVG", "ns")}
        out |= {f"groom_orient_jit_mean_{tag}": over("AVG", "turn"), f"groom_orient_jit_std_{tag}": f"COALESCE({over('STDDEV_SAMP', 'turn')}, 0)"}
    ang = "ATAN2(nose_y - tail_base_y, nose_x - tail_base_x)"
    return f"""WITH {FRAMES_SQL}, b AS (SELECT *, COALESCE({moved(CX, CY)} * fps, 0) AS cs, COALESCE({moved('nose_x', 'nose_y')} * fps, 0) AS ns, SQRT({gap2('nose', 'body_center')}) AS r, COALESCE(ABS({ang} - {lag(ang)}), 0) AS turn FROM fr),
      g AS (SELECT *, LEAST(GREATEST(ns / (cs + 1e-3), 0), 10) AS ratio FROM b) """ + select(out, "g")


def _front_rear() -> str:
    speed = lambda ps: "COALESCE((" + " + ".join(moved(f"{p}_x", f"{p}_y") for p in ps) + f") / {len(ps)}, 0) * fps"
    w = "(fps // 2)"
    out = {"fr_ratio": "fr", "fr_ratio_ma": past("AVG", "fr", w), "front_jitter": past("AVG", "jolt", w)}
    return f"""WITH {FRAMES_SQL}, b AS (SELECT *, {speed(('nose', 'ear_left', 'ear_right'))} AS f, {speed(('tail_base', 'hip_left', 'hip_right'))} AS r FROM fr),
      g AS (SELECT *, LN(1 + f) - LN(1 + r) AS fr, ABS(f - {lag('f')}) AS jolt FROM b) """ + select(out, "g")


def _part_motion() -> str:
    out, parts = {}, ("nose", "ear_left", "ear_right", "tail_base")
    for p in parts:
        out[f"{p}_v"] = f"{p}_v"
        for k in (2, 5, 10, 20):
            way = f"COALESCE({moved(p + '_x', p + '_y', n(k))}, 0)"
            out |= {f"{p}_disp_l{k}": way, f"{p}_sp_l{k}": f"{way} * fps / {n(k)}"}
        for w in (10, 30, 60):
            out |= {f"{p}_v_m{w}": past("AVG", f"{p}_v", n(w), part_of(n(w), 4)), f"{p}_v_s{w}": past("STDDEV_SAMP", f"{p}_v", n(w), part_of(n(w), 4))}
    out |= {"ear_lr_v_diff": "ABS(ear_left_v - ear_right_v)", "ear_lr_v_ratio": "ear_left_v / (ear_right_v + 1e-6)"}
    speeds = ", ".join(f"COALESCE({moved(p + '_x', p + '_y')}, 0) * fps AS {p}_v" for p in parts)
    return f"WITH {FRAMES_SQL}, b AS (SELECT *, {speeds} FROM fr) " + select(out, "b")


def _nose_tail() -> str:
    out = {"nt_dist": "nt"}
    for k in (5, 10, 20, 40, 80):
        out |= {f"nt_lg{k}": lag("nt", n(k)), f"nt_df{k}": f"COALESCE(nt - {lag('nt', n(k))}, 0)"}
    for w in (15, 30, 60, 120):
        m, s = past("AVG", "nt", n(w), part_of(n(w), 4)), past("STDDEV_SAMP", "nt", n(w), part_of(n(w), 4))
        out |= {f"nt_m{w}": m, f"nt_s{w}": s, f"nt_cv{w}": f"({s}) / (({m}) + 1e-6)"}
    out |= {"nt_v": "v", "nt_v_m30": past("AVG", "v", n(30))}
    return f"WITH {FRAMES_SQL}, a AS (SELECT *, SQRT({gap2('nose', 'tail_base')}) AS nt FROM fr), b AS (SELECT *, ABS(COALESCE(nt - {lag('nt')}, 0) * fps) AS v FROM a) " + select(out, "b")


def _ears() -> str:
    out = {f"ear_o{o}": lead("e", n(o)) if o > 0 else lag("e", n(-o)) for o in (-40, -20, -10, 10, 20, 40)}
    out["ear_con"] = f"({mid('STDDEV_SAMP', 'e', n(30))}) / (({mid('AVG', 'e', n(30))}) + 1e-6)"
    return f"WITH {FRAMES_SQL}, a AS (SELECT *, SQRT({gap2('ear_left', 'ear_right')}) AS e FROM fr) " + select(out, "a")


def _shape() -> str:
    xs, ys = [f"{p}_x" for p in PARTS], [f"{p}_y" for p in PARTS]
    mean = lambda cs: f"LIST_AVG([{', '.join(cs)}])"
    total = lambda terms: " + ".join(f"COALESCE({t}, 0)" for t in terms)
    d = len(PARTS) - 1
    out = {"morph_len": "len", "morph_wid": "wid", "morph_area": "len * wid", "morph_ratio": "ratio", "morph_ratio_ma": past("AVG", "ratio", n(15)), "spine_angle": "ang", "spine_var_30": past("STDDEV_SAMP", "ang", "30")}
    out |= {"area_head": "head", "area_head_ch": f"COALESCE(head - {lag('head')}, 0)", "area_body": "body", "shape_factor": f"body / ({gap2('nose', 'tail_base')} + 1e-6)"}
    shoelace = lambda a, b, c: f"0.5 * ABS({a}_x * ({b}_y - {c}_y) + {b}_x * ({c}_y - {a}_y) + {c}_x * ({a}_y - {b}_y))"
    cos = f"((nose_x - {CX}) * (tail_base_x - {CX}) + (nose_y - {CY}) * (tail_base_y - {CY})) / (SQRT({gap2('nose', 'body_center')}) * SQRT({gap2('tail_base', 'body_center')}) + 1e-6)"
    return f"""WITH {FRAMES_SQL}, c AS (SELECT *, {mean(xs)} AS mx, {mean(ys)} AS my, {cos} AS cs FROM fr),
      v AS (SELECT *, ({total(f'POW({x} - mx, 2)' for x in xs)}) / {d} AS a, ({total(f'POW({y} - my, 2)' for y in ys)}) / {d} AS b, ({total(f'({x} - mx) * ({y} - my)' for x, y in zip(xs, ys))}) / {d} AS k FROM c),
      e AS (SELECT *, (a + b + SQRT(POW(a - b, 2) + 4 * k * k)) / 2 AS e1, (a + b - SQRT(POW(a - b, 2) + 4 * k * k)) / 2 AS e2 FROM v),
      l AS (SELECT *, SQRT(e1) AS len, CASE WHEN e2 >= 0 THEN SQRT(e2) END AS wid FROM e),
      z AS (SELECT *, len / (wid + 1e-6) AS ratio, COALESCE(DEGREES(ACOS(CASE WHEN cs IS NOT NULL THEN LEAST(GREATEST(cs, -1), 1) END)), 180) AS ang, {shoelace('nose', 'ear_left', 'ear_right')} AS head, {shoelace('nose', 'tail_base', 'body_center')} AS body FROM l) """ + select(out, "z")


def _jitter() -> str:
    parts, out = ("nose", "ear_left"), {}
    for p in parts:
        for w in (6, 9, 15):
            out |= {f"{p}_jitter_mean_{w}": past("AVG", f"j_{p}", n(w)), f"{p}_jitter_max_{w}": past("MAX", f"j_{p}", n(w))}
    first = ", ".join(f"{p}_{a} - {lag(f'{p}_{a}')} AS d{a}_{p}" for p in parts for a in "xy")
    second = ", ".join(f"{moved(f'dx_{p}', f'dy_{p}')} AS j_{p}" for p in parts)
    return f"WITH {FRAMES_SQL}, a AS (SELECT *, {first} FROM fr), b AS (SELECT *, {second} FROM a) " + select(out, "b")


def _arena() -> str:
    clip = lambda c: f"CASE WHEN {c} IS NOT NULL THEN LEAST(GREATEST({c}, 0), 1) END"
    corner = "LEAST(" + ", ".join(f"SQRT(POW({CX} - {x}, 2) + POW({CY} - {y}, 2))" for x in (0, 40) for y in (0, 30)) + ")"
    out = {"arena_x_norm": clip(f"({CX} / 40.000001)"), "arena_y_norm": clip(f"({CY} / 30.000001)"), "arena_center_dist": "away", "arena_wall_dist": "wall", "arena_corner_dist": "corner"}
    out |= {"arena_wall_close_2cm": "nw", "arena_corner_close_3cm": "nc", "arena_wall_close_rate_1s": past("AVG", "nw", n(30), part_of(n(30), 3)), "arena_corner_close_rate_1s": past("AVG", "nc", n(30), part_of(n(30), 3))}
    return f"""WITH {FRAMES_SQL}, a AS (SELECT *, SQRT(POW({CX} - 20, 2) + POW({CY} - 15, 2)) AS away FROM fr),
      b AS (SELECT *, CASE WHEN {CX} IS NOT NULL THEN GREATEST(CASE WHEN circ THEN 15 - away ELSE LEAST({CX}, 40 - {CX}, {CY}, 30 - {CY}) END, 0) END AS wall FROM a),
      c AS (SELECT *, CASE WHEN circ THEN wall ELSE {corner} END AS corner FROM b),
      d AS (SELECT *, CASE WHEN wall < 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS nw, CASE WHEN corner < 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS nc FROM c) """ + select(out, "d")


def _key_lags() -> str:
    out = {}
    for k in ("nt_dist", "elong", "sp_m5"):
        for b in (5, 10):
            out |= {f"{k}_lag{b}": lag(k, n(b)), f"{k}_lead{b}": lead(k, n(b))}
    return f"""WITH {FRAMES_SQL}, a AS (SELECT *, SQRT({gap2('nose', 'tail_base')}) AS nt_dist, {gap2('nose', 'tail_base')} / ({gap2('ear_left', 'ear_right')} + 1e-6) AS elong, {moved(CX, CY)} * fps AS s FROM fr),
      b AS (SELECT *, CASE WHEN {LONG} >= {n(5)} THEN {past('AVG', 's', n(5), part_of(n(5), 4))} END AS sp_m5 FROM a) """ + select(out, "b")


SQL = {
    "distances": _distances, "centre_windows": _centre_windows, "kinematics": _kinematics, "paths": _paths, "turns": _turns, "speed_scales": _scales, "speed_states": _states, "long_range": _long_range,
    "grooming": _grooming, "front_rear": _front_rear, "part_motion": _part_motion, "nose_tail": _nose_tail, "ears": _ears, "shape": _shape, "jitter": _jitter, "arena": _arena, "single_key_lags": _key_lags,
}


def _family(name: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return features(frames(spark, sf_dir), motion.FAMILIES[name])

    register(f"single_{name.removeprefix('single_')}", SQL[name](), query)


for _name in motion.FAMILIES:
    _family(_name)
