"""Registered queries of the pair feature families, and their SQL."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrail.functions import pairs
from kinetrail.functions.sequences import features
from kinetrail.operators.pairing import directed
from kinetrail.plans.catalog import register
from kinetrail.plans.families import FRAMES_SQL, gap2, lag, lead, mid, n, part_of, past, select
from kinetrail.sources.tables import PARTS, frames

_SIDES = ", ".join(f"{s}.{p}_{c} AS {s.upper()}_{p}_{c}" for s in "ab" for p in PARTS for c in "xy")
PAIRS_SQL = f"{FRAMES_SQL}, pr AS (SELECT a.video, a.entity AS agent, b.entity AS target, a.video * 4 + a.entity * 2 + b.entity AS seq, a.frame, a.fps, {_SIDES} FROM fr a JOIN fr b ON a.video = b.video AND a.frame = b.frame AND a.entity <> b.entity)"
KEYS = "video, agent, target, frame"
CA, CB = "A_body_center", "B_body_center"


def gap(a: str, b: str) -> str:
    return f"SQRT({gap2(a, b)})"


def cos(u: tuple[str, str], v: tuple[str, str]) -> str:
    return f"(({u[0]}) * ({v[0]}) + ({u[1]}) * ({v[1]})) / (SQRT(POW({u[0]}, 2) + POW({u[1]}, 2)) * SQRT(POW({v[0]}, 2) + POW({v[1]}, 2)) + 1e-6)"


def between(a: str, b: str) -> tuple[str, str]:
    return f"{a}_x - {b}_x", f"{a}_y - {b}_y"


def yes(c: str) -> str:
    return f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END::DOUBLE"


def _elong(s: str) -> str:
    return f"{gap(f'{s}_nose', f'{s}_tail_base')} / ({gap(f'{s}_ear_left', f'{s}_ear_right')} + 1e-6)"


def _distances() -> str:
    out = {f"12+{p}+{q}": gap2(f"A_{p}", f"B_{q}") for p, q in product(PARTS, PARTS)}
    out["rel_ori"] = cos(between("A_nose", "A_tail_base"), between("B_nose", "B_tail_base"))
    out |= {"A_elong": "ea", "B_elong": "eb", "AB_elong_diff": "ea - eb", "AB_elong_ratio": "ea / (eb + 1e-6)"}
    return f"WITH {PAIRS_SQL}, e AS (SELECT *, {_elong('A')} AS ea, {_elong('B')} AS eb FROM pr) " + select(out, "e", KEYS)


def _motion() -> str:
    back = lambda a, b: f"POW({a}_x - {lag(f'{b}_x', n(10))}, 2) + POW({a}_y - {lag(f'{b}_y', n(10))}, 2)"
    out = {"sp_A": back("A_ear_left", "A_ear_left"), "sp_AB": back("A_ear_left", "B_ear_left"), "sp_B": back("B_ear_left", "B_ear_left"), "appr": f"n2 - {lag('n2', n(10))}", "ab_cd": "cd"}
    out |= {"v_cls": yes("cd < 5"), "cls": yes("cd >= 5 AND cd < 15"), "med": yes("cd >= 15 AND cd < 30"), "far": yes("cd >= 30"), "nn": "nn"}
    for w in (5, 15, 30, 60):
        out |= {f"d_{k}{w}": mid(f, "d2", n(w)) for k, f in (("m", "AVG"), ("s", "STDDEV_SAMP"), ("mn", "MIN"), ("mx", "MAX"))}
        out |= {f"int{w}": f"1 / (1 + ({mid('VAR_SAMP', 'd2', n(w))}))", f"co_m{w}": mid("AVG", "co", n(w)), f"co_s{w}": mid("STDDEV_SAMP", "co", n(w))}
    for k in (10, 20, 40):
        out |= {f"nn_lg{k}": lag("nn", n(k)), f"nn_ch{k}": f"nn - {lag('nn', n(k))}", f"cl_ps{k}": past("AVG", "near", n(k))}
    out |= {f"va_{o}": "al" if not o else lead("al", n(o)) if o > 0 else lag("al", n(-o)) for o in (-20, -10, 0, 10, 20)}
    out["int_con"] = f"({mid('STDDEV_SAMP', 'cd', n(30))}) / (({mid('AVG', 'cd', n(30))}) + 1e-6)"
    steps = ", ".join(f"{s}_body_center_{c} - {lag(f'{s}_body_center_{c}')} AS d{s.lower()}{c}" for s in "AB" for c in "xy")
    return f"""WITH {PAIRS_SQL}, s AS (SELECT *, {gap(CA, CB)} AS cd, {gap2(CA, CB)} AS d2, {gap('A_nose', 'B_nose')} AS nn, {gap2('A_nose', 'B_nose')} AS n2, {steps} FROM pr),
      t AS (SELECT *, dax * dbx + day * dby AS co, {cos(('dax', 'day'), ('dbx', 'dby'))} AS al, {yes('nn < 10')} AS near FROM s) """ + select(out, "t", KEYS)


_LEADS = f"""l1 AS (SELECT *, A_body_center_x - B_body_center_x AS rx, A_body_center_y - B_body_center_y AS ry, {', '.join(f"{s}_body_center_{c} - {lag(f'{s}_body_center_{c}')} AS d{s.lower()}{c}" for s in 'AB' for c in 'xy')} FROM pr),
  l2 AS (SELECT *, {cos(('dax', 'day'), ('rx', 'ry'))} AS al, {cos(('dbx', 'dby'), ('-rx', '-ry'))} AS bl, SQRT(dax * dax + day * day) AS sa, SQRT(dbx * dbx + dby * dby) AS sb, SQRT(rx * rx + ry * ry) AS far FROM l1),
  l3 AS (SELECT *, ({lag('far')} - far) * bl AS chase, CASE WHEN sb IS NOT NULL THEN sa END AS ta, CASE WHEN sa IS NOT NULL THEN sb END AS tb FROM l2)"""


def _interaction() -> str:
    mean = lambda c, w: past("AVG", c, n(w), part_of(n(w), 6))
    out = {f"{s}_ld{w}": mean(c, w) for s, c in (("A", "al"), ("B", "bl")) for w in (30, 60)} | {"chase_30": mean("chase", 30)}
    for w in (60, 120):
        q = part_of(n(w), 6)
        spread = f"({past('STDDEV_SAMP', 'ta', n(w), q)}) * ({past('STDDEV_SAMP', 'tb', n(w), q)})"
        together = f"COVAR_SAMP(ta, tb) OVER (PARTITION BY seq ORDER BY frame ROWS BETWEEN {n(w)} - 1 PRECEDING AND CURRENT ROW)"
        out[f"sp_cor{w}"] = f"CASE WHEN {spread} > 0 THEN {together} / ({spread}) END"
    return f"WITH {PAIRS_SQL}, {_LEADS} " + select(out, "l3", KEYS)


def _to(x: str, y: str) -> str:
    return f"SQRT(POW(A_nose_x - {x}, 2) + POW(A_nose_y - {y}, 2))"


_AT = {"nn": "nose", "ne_l": "ear_left", "ne_r": "ear_right", "ntb": "tail_base", "nbd": "body_center"}
SNIFFS = {k: _to(f"B_{p}_x", f"B_{p}_y") for k, p in _AT.items()} | {k: _to(f"(B_{p}_left_x + B_{p}_right_x) / 2", f"(B_{p}_left_y + B_{p}_right_y) / 2") for k, p in (("ne_m", "ear"), ("nhm", "hip"))}
_SNIFFED = ", ".join(f"{v} AS {k}" for k, v in SNIFFS.items())


def _sniff() -> str:
    out = {"snf_dmin_face": "LEAST(nn, ne_l, ne_r, ne_m)", "snf_dmin_genital": "LEAST(nhm, ntb)", "snf_d_body": "nbd"}
    for k in SNIFFS:
        out[f"snf_d_{k}"] = k
        out |= {f"snf_dch_{k}_l{m}": f"COALESCE({k} - {lag(k, n(m))}, 0)" for m in (5, 10, 20)}
        for w in (15, 30, 60):
            out |= {f"snf_dm_{k}_w{w}": past("AVG", k, n(w), part_of(n(w), 4)), f"snf_ds_{k}_w{w}": past("STDDEV_SAMP", k, n(w), part_of(n(w), 4))}
        out |= {f"snf_close_{k}_{c}cm": yes(f"{k} < {c}") for c in (2, 5)}
    return f"WITH {PAIRS_SQL}, s AS (SELECT *, {_SNIFFED} FROM pr) " + select(out, "s", KEYS)


def _groom() -> str:
    out = {}
    for w in (6, 15, 30):
        mean = lambda c: past("AVG", c, n(w), part_of(n(w), 3))  # noqa: B023, E731
        out |= {f"rel_jit_m{w}f": mean("rj"), f"rel_jit_max{w}f": past("MAX", "rj", n(w), part_of(n(w), 3)), f"target_spd_m{w}f": mean("sp")}
        out |= {f"groom_ratio_{w}f": f"({mean('rj')}) / (({mean('sp')}) + 0.1)", f"jit_ratio_{w}f": f"({mean('rj')}) / (({mean('bj')}) + 1e-6)"}
    second = lambda c: f"{c} - 2 * {lag(c)} + {lag(c, '2')}"
    shake = lambda x, y: f"COALESCE(SQRT(POW({second(x)}, 2) + POW({second(y)}, 2)), 0)"
    return f"""WITH {PAIRS_SQL}, r AS (SELECT *, A_nose_x - B_body_center_x AS rx, A_nose_y - B_body_center_y AS ry FROM pr),
      j AS (SELECT *, {shake('rx', 'ry')} AS rj, {shake('B_body_center_x', 'B_body_center_y')} AS bj, COALESCE(SQRT(POW(B_body_center_x - {lag('B_body_center_x')}, 2) + POW(B_body_center_y - {lag('B_body_center_y')}, 2)), 0) * fps AS sp FROM r) """ + select(out, "j", KEYS)


def _egocentric() -> str:
    places = {"Bc": ("B_body_center_x", "B_body_center_y"), "Bn": ("B_nose_x", "B_nose_y"), "Bg": ("(B_hip_left_x + B_hip_right_x) / 2", "(B_hip_left_y + B_hip_right_y) / 2")}
    out = {"ego_B_in_front_rate_1s": past("AVG", "front", n(30))}
    for t in places:
        x, y, v = (f"{t}_{c}" for c in "xyv")
        out |= {f"ego_{t}_x": x, f"ego_{t}_y": y, f"ego_{t}_r": f"SQRT({x} * {x} + {y} * {y})", f"ego_{t}_ang": f"ATAN2({x}, {y})", f"ego_{t}_vx": f"{t}_vx", f"ego_{t}_vy": f"{t}_vy", f"ego_{t}_v": v}
        out |= {f"ego_{t}_{k}": yes(c) for k, c in {"front": f"{y} > 0", "back": f"{y} < 0", "left": f"{x} > 0", "right": f"{x} < 0", "front_close": f"{y} > 0 AND ABS({x}) < 5", "back_close": f"{y} < 0 AND ABS({x}) < 5"}.items()}
        for w in (15, 30, 60):
            for k, c in (("x", x), ("y", y), ("v", v)):
                out |= {f"ego_{t}_{k}m{w}": past("AVG", c, n(w), part_of(n(w), 4)), f"ego_{t}_{k}s{w}": past("STDDEV_SAMP", c, n(w), part_of(n(w), 4))}
    own = ", ".join(f"-(({x}) - A_body_center_x) * hy + (({y}) - A_body_center_y) * hx AS {t}_x, (({x}) - A_body_center_x) * hx + (({y}) - A_body_center_y) * hy AS {t}_y" for t, (x, y) in places.items())
    speeds = ", ".join(f"COALESCE({t}_{c} - {lag(f'{t}_{c}')}, 0) * fps AS {t}_v{c}" for t in places for c in "xy")
    return f"""WITH {PAIRS_SQL}, g AS (SELECT *, SQRT({gap2('A_nose', 'A_tail_base')}) + 1e-6 AS h FROM pr), u AS (SELECT *, (A_nose_x - A_tail_base_x) / h AS hx, (A_nose_y - A_tail_base_y) / h AS hy FROM g),
      o AS (SELECT *, {own} FROM u), s AS (SELECT *, {speeds}, {yes('Bc_y > 0')} AS front FROM o), v AS (SELECT *, {', '.join(f'SQRT({t}_vx * {t}_vx + {t}_vy * {t}_vy) AS {t}_v' for t in places)} FROM s) """ + select(out, "v", KEYS)


def _key_lags() -> str:
    out = {}
    for k in ("ab_cd", "nn", "appr", "int_con", "chase_30", "snf_dmin_face", "snf_dmin_genital", "snf_d_body", "A_elong", "B_elong"):
        for b in (5, 10, 20, 40):
            out |= {f"{k}_lag{b}": lag(k, n(b)), f"{k}_lead{b}": lead(k, n(b))}
    return f"""WITH {PAIRS_SQL}, {_LEADS}, s AS (SELECT *, {_SNIFFED}, {gap(CA, CB)} AS ab_cd, {gap2('A_nose', 'B_nose')} AS n2, {_elong('A')} AS A_elong, {_elong('B')} AS B_elong FROM l3),
      k AS (SELECT *, n2 - {lag('n2', n(10))} AS appr, ({mid('STDDEV_SAMP', 'ab_cd', n(30))}) / (({mid('AVG', 'ab_cd', n(30))}) + 1e-6) AS int_con, {past('AVG', 'chase', n(30), part_of(n(30), 6))} AS chase_30,
        LEAST(nn, ne_l, ne_r, ne_m) AS snf_dmin_face, LEAST(nhm, ntb) AS snf_dmin_genital, nbd AS snf_d_body FROM s) """ + select(out, "k", KEYS)


SQL = {"pair_distances": _distances, "pair_motion": _motion, "pair_interaction": _interaction, "pair_sniff": _sniff, "pair_groom": _groom, "pair_egocentric": _egocentric, "pair_key_lags": _key_lags}


def _family(name: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = features(directed(frames(spark, sf_dir)), pairs.FAMILIES[name])
        return rows.select(F.col("seq.video").alias("video"), "*").drop("seq")

    register(f"all_{name}", SQL[name](), query)


for _name in pairs.FAMILIES:
    _family(_name)
