"""Feature families of one entity's motion and posture. Each takes the frames of a sequence (`<part>_x`, `<part>_y` for
tracked parts, in cm) and returns its columns by name; `sequences.features` runs them over a table. Parts that are not
tracked give no columns or, where a family can do without, are left out. Windows given in frames are for 30 a second."""

from __future__ import annotations

from itertools import combinations

import numpy as np

from kinetrail.functions import planar as P
from kinetrail.functions.kernel import Array
from kinetrail.functions.planar import EPS
from kinetrail.functions.sequences import Frames, flag, zero

Columns = dict[str, Array]


def distances(s: Frames) -> Columns:
    """Squared distances of all parts, squared displacements of ears over 10 frames, elongation, body angle."""
    parts = s.tracked()
    out = {f"{a}+{b}": P.squared(s.point(a), s.point(b)) for a, b in combinations(parts, 2)}
    if {"ear_left", "ear_right", "tail_base"} <= set(parts):
        then = lambda p: tuple(s.lag(c, s.n(10)) for c in s.point(p))
        for name, a, b in (("sp_lf", "ear_left", "ear_left"), ("sp_rt", "ear_right", "ear_right"), ("sp_lf2", "ear_left", "tail_base"), ("sp_rt2", "ear_right", "tail_base")):
            out[name] = P.squared(s.point(a), then(b))
    if (elong := elongation(s)) is not None:
        out["elong"] = elong
    if {"nose", "body_center", "tail_base"} <= set(parts):
        c = s.point("body_center")
        out["body_ang"] = P.cosine(P.minus(s.point("nose"), c), P.minus(s.point("tail_base"), c))
    return out


def elongation(s: Frames) -> Array | None:
    """Squared length of the body over that of the line between the ears."""
    if {"nose", "tail_base", "ear_left", "ear_right"} <= set(s.tracked()):
        return P.squared(s.point("nose"), s.point("tail_base")) / (P.squared(s.point("ear_left"), s.point("ear_right")) + EPS)
    return None


def centre_windows(s: Frames) -> Columns:
    """Mean, spread and range of the centre, displacement and activity in windows of 5 to 60 frames."""
    c = P.centre(s)
    way, out = [s.diff(x) for x in c], {}
    for w in (5, 15, 30, 60):
        n = s.n(w)
        for axis, p in zip("xy", c):
            out[f"c{axis}_m{w}"], out[f"c{axis}_s{w}"] = s.mid(p, n, 1, "mean"), s.mid(p, n, 1, "std")
            out[f"{axis}_rng{w}"] = s.mid(p, n, 1, "max") - s.mid(p, n, 1, "min")
        out[f"disp{w}"] = P.length((s.past(way[0], n, 1, "sum"), s.past(way[1], n, 1, "sum")))
        out[f"act{w}"] = np.sqrt(s.past(way[0], n, 1, "var") + s.past(way[1], n, 1, "var"))
    return out


def kinematics(s: Frames) -> Columns:
    """Displacements, speed, acceleration and jerk of the centre, their statistics, contrast and activity."""
    c, out = P.centre(s), {}
    for k in (1, 2, 5, 10, 20, 40):
        n = s.n(k)
        out[f"c_disp_l{k}"] = zero(s.step(c, n))
        out[f"c_sp_l{k}"] = out[f"c_disp_l{k}"] * s.fps / n
    v = out["c_v"] = zero(s.step(c)) * s.fps
    a = out["c_a"] = zero(s.diff(v)) * s.fps
    j = out["c_j"] = zero(s.diff(a)) * s.fps
    for w in (5, 15, 30, 60, 120):
        n = s.n(w)
        least = max(1, n // 4)
        m, d = s.past(v, n, least, "mean"), s.past(v, n, least, "std")
        out |= {f"c_v_m{w}": m, f"c_v_s{w}": d, f"c_v_max{w}": s.past(v, n, least, "max"), f"c_v_cv{w}": d / (m + EPS)}
        out |= {f"c_a_m{w}": s.past(a, n, least, "mean"), f"c_a_s{w}": s.past(a, n, least, "std"), f"c_j_m{w}": s.past(j, n, least, "mean")}
    short, long = (s.past(v, s.n(w), max(1, s.n(w) // 3), "mean") for w in (15, 90))
    out |= {"c_v_contrast_15_90": zero(short - long), "c_v_ratio_15_90": zero(short / (long + EPS))}
    active = flag(v > s.past(v, s.n(60), 1, "median") + 1.0)
    return out | {f"c_active_{k}s": s.past(active, s.n(30 * k), 1, "mean") for k in (1, 3)}


def paths(s: Frames) -> Columns:
    """Tortuosity and efficiency over seconds, path of about six seconds around, path efficiency, and how speed differs
    between past and future (means, medians, divergence of normal distributions)."""
    c, out = P.centre(s), {}
    step = s.step(c)
    way, v = zero(step), zero(step) * s.fps
    for k in (1, 3):
        n = max(5, int(k * s.fps))
        path, net = s.past(way, n, n // 2, "sum"), zero(s.step(c, n))
        out |= {f"tortuosity_{k}s": path / (net + 0.1), f"move_eff_{k}s": net / (path + 1.0)}
    n = s.n(180)
    out["path_cum180"] = zero(s.mid(step, 2 * n + 1, max(5, n // 6), "sum"))
    for w in (30, 90):
        out[f"path_eff_{w}"] = s.step(c, s.n(w)) / (s.past(step, s.n(w), 1, "sum") + EPS)
    n = max(3, s.n(30))
    least = max(3, n // 4)
    out["spd_asym_1s"], out["spd_asym_median_1s"] = (zero(s.ahead(v, n, least, kind) - s.past(v, n, least, kind)) for kind in ("mean", "median"))
    n = max(5, s.n(30))
    fits = [(side(v, n, max(3, n // 4), "mean"), np.maximum(side(v, n, max(3, n // 4), "var"), EPS)) for side in (s.past, s.ahead)]
    one_way = lambda a, b: (a[1] / b[1] + (a[0] - b[0]) ** 2 / b[1] - 1 + np.log(b[1] / a[1])) / 2
    out["spd_symkl_1s"] = zero(one_way(*fits) + one_way(*fits[::-1]))
    return out


def turns(s: Frames) -> Columns:
    """Mean curvature of the centre's way, and how much its direction turns (angles are not unwrapped)."""
    dx, dy = (s.diff(x) for x in P.centre(s))
    bend = np.abs(dx * s.diff(dy) - dy * s.diff(dx)) / (P.length((dx, dy)) ** 3 + EPS)
    turn = np.abs(s.diff(np.arctan2(dy, dx)))
    out = {f"curv_mean_{w}": s.past(bend, s.n(w), max(1, s.n(w) // 6), "mean") for w in (15, 30, 60)}
    return out | {f"turn_rate_{w}": s.past(turn, s.n(w), max(1, s.n(w) // 6), "sum") for w in (15, 30)}


def speed_scales(s: Frames) -> Columns:
    """Mean and spread of speed in windows of 5 to 320 frames, missing where the sequence is shorter than the window."""
    v, out = s.step(P.centre(s)) * s.fps, {}
    for w in (5, 10, 20, 40, 160, 320):
        n = s.n(w)
        for name, kind in (("m", "mean"), ("s", "std")):
            out[f"sp_{name}{w}"] = s.long_enough(s.past(v, n, max(1, n // 4), kind), n)
    return out | {f"sp_ratio_{a}_{b}": out[f"sp_m{a}"] / (out[f"sp_m{b}"] + EPS) for a, b in ((5, 40), (10, 160))}


def speed_states(s: Frames) -> Columns:
    """Shares of four states of smoothed speed (cuts at 0.5, 2 and 5 cm a second, each in the lower state) and changes
    between them; missing where the sequence is shorter than the window."""
    m = s.past(s.step(P.centre(s)) * s.fps, s.n(15), max(1, s.n(15) // 3), "mean")
    state = np.where(np.isnan(m), np.nan, np.searchsorted([0.5, 2.0, 5.0], zero(m), side="left"))
    change = flag(~(state == s.lag(state)))
    out = {}
    for w in (30, 60, 120):
        n = s.n(w)
        least = max(1, n // 6)
        out |= {f"s{k}_{w}": s.long_enough(s.past(flag(state == k), n, least, "mean"), n) for k in range(4)}
        out[f"trans_{w}"] = s.long_enough(s.past(change, n, least, "sum"), n)
    return out


def _long_means(s: Frames) -> list[tuple[str, Array, float]]:
    return [(f"{axis}_e{span}", x, s.n(span)) for axis, x in zip("xy", P.centre(s)) for span in (60, 120, 240)]


def long_range(s: Frames) -> Columns:
    """Wide means and exponentially weighted means of the centre, and the speed's rank within wide windows."""
    c, out = P.centre(s), s.decays(_long_means(s))
    for w in (120, 240):
        n = s.n(w)
        out |= {f"{axis}_ml{w}": s.long_enough(s.past(x, n, max(5, n // 6), "mean"), n) for axis, x in zip("xy", c)}
    v = s.step(c) * s.fps
    return out | {f"sp_pct{w}": s.long_enough(s.rank_share(v, s.n(w), max(5, s.n(w) // 6)), s.n(w)) for w in (60, 120, 240)}


long_range.decays = _long_means


def grooming(s: Frames) -> Columns:
    """Head against body speed, radial jitter of the nose and jitter of orientation in windows of 0.2 to 1 second; nothing
    without a nose."""
    if "nose" not in s.tracked():
        return {}
    c, nose, out = P.centre(s, ("body_center", "neck")), s.point("nose"), {}
    body, head, radius = zero(s.step(c) * s.fps), zero(s.step(nose) * s.fps), P.apart(nose, c)
    turn = None
    if "tail_base" in s.tracked():
        d = P.minus(nose, s.point("tail_base"))
        turn = zero(np.abs(s.diff(np.arctan2(d[1], d[0]))))
    ratio = np.clip(head / (body + 1e-3), 0.0, 10.0)
    for w, tag in ((6, "0p2s"), (9, "0p3s"), (15, "0p5s"), (30, "1p0s")):
        over = lambda x, kind: s.past(x, s.n(w), max(1, s.n(w) // 3), kind)  # noqa: B023, E731
        out |= {f"groom_hbd_med_{tag}": over(ratio, "median"), f"groom_hbd_mean_{tag}": over(ratio, "mean"), f"groom_nose_rad_std_{tag}": zero(over(radius, "std"))}
        out |= {f"groom_cs_mean_{tag}": over(body, "mean"), f"groom_ns_mean_{tag}": over(head, "mean")}
        if turn is not None:
            out |= {f"groom_orient_jit_mean_{tag}": over(turn, "mean"), f"groom_orient_jit_std_{tag}": zero(over(turn, "std"))}
    return out


def front_rear(s: Frames) -> Columns:
    """Log ratio of the speeds of front and rear parts, its mean over half a second, and the front's jitter; nothing where
    no front or no rear part is tracked."""

    def speed(names: tuple[str, ...]) -> Array | None:
        have = [p for p in names if p in s.tracked()]
        return zero(sum(s.step(s.point(p)) for p in have) / len(have)) * s.fps if have else None

    front, rear = speed(("nose", "ear_left", "ear_right")), speed(("tail_base", "hip_left", "hip_right"))
    if front is None or rear is None:
        return {}
    ratio, n = np.log1p(front) - np.log1p(rear), max(1, int(0.5 * s.fps))
    return {"fr_ratio": ratio, "fr_ratio_ma": s.past(ratio, n, 1, "mean"), "front_jitter": s.past(np.abs(s.diff(front)), n, 1, "mean")}


def part_motion(s: Frames) -> Columns:
    """Speed of nose, ears and tail base, their displacements and statistics, and how the ears differ."""
    have, out = [p for p in ("nose", "ear_left", "ear_right", "tail_base") if p in s.tracked()], {}
    for p in have:
        v = out[f"{p}_v"] = zero(s.step(s.point(p))) * s.fps
        for k in (2, 5, 10, 20):
            out[f"{p}_disp_l{k}"] = zero(s.step(s.point(p), s.n(k)))
            out[f"{p}_sp_l{k}"] = out[f"{p}_disp_l{k}"] * s.fps / s.n(k)
        for w in (10, 30, 60):
            n = s.n(w)
            out[f"{p}_v_m{w}"], out[f"{p}_v_s{w}"] = s.past(v, n, max(1, n // 4), "mean"), s.past(v, n, max(1, n // 4), "std")
    if {"ear_left", "ear_right"} <= set(have):
        a, b = out["ear_left_v"], out["ear_right_v"]
        out |= {"ear_lr_v_diff": np.abs(a - b), "ear_lr_v_ratio": a / (b + EPS)}
    return out


def nose_tail(s: Frames) -> Columns:
    """Distance of nose and tail base: earlier values, differences, statistics, and how fast it changes; nothing where one
    of them is not tracked."""
    if not {"nose", "tail_base"} <= set(s.tracked()):
        return {}
    nt = P.apart(s.point("nose"), s.point("tail_base"))
    v, out = np.abs(zero(s.diff(nt)) * s.fps), {"nt_dist": nt}
    for k in (5, 10, 20, 40, 80):
        out |= {f"nt_lg{k}": s.lag(nt, s.n(k)), f"nt_df{k}": zero(s.diff(nt, s.n(k)))}
    for w in (15, 30, 60, 120):
        n = s.n(w)
        m, d = s.past(nt, n, max(1, n // 4), "mean"), s.past(nt, n, max(1, n // 4), "std")
        out |= {f"nt_m{w}": m, f"nt_s{w}": d, f"nt_cv{w}": d / (m + EPS)}
    return out | {"nt_v": v, "nt_v_m30": s.past(v, s.n(30), 1, "mean")}


def ears(s: Frames) -> Columns:
    """Distance of the ears at earlier and later frames, and how steady it is; nothing where one is not tracked."""
    if not {"ear_left", "ear_right"} <= set(s.tracked()):
        return {}
    e, n = P.apart(s.point("ear_left"), s.point("ear_right")), s.n(30)
    out = {f"ear_o{o}": s.lag(e, -s.n(o) if o > 0 else s.n(-o)) for o in (-40, -20, -10, 10, 20, 40)}
    return out | {"ear_con": s.mid(e, n, 1, "std") / (s.mid(e, n, 1, "mean") + EPS)}


def shape(s: Frames) -> Columns:
    """Principal axes of the parts, bend of the spine (its spread over 30 rows at every rate), areas of triangles."""
    parts = set(s.tracked())
    points = [s.point(p) for p in s.tracked()]
    mean = P.middle(points)
    xx, yy, xy = (P.moment(points, mean, j, k) for j, k in ((0, 0), (1, 1), (0, 1)))
    long, wide = (np.where(e >= 0, np.sqrt(np.maximum(e, 0.0)), np.nan) for e in P.axes(xx, yy, xy))
    ratio = long / (wide + EPS)
    out = {"morph_len": long, "morph_wid": wide, "morph_area": long * wide, "morph_ratio": ratio, "morph_ratio_ma": s.past(ratio, s.n(15), 1, "mean")}
    if {"nose", "body_center", "tail_base"} <= parts:
        angle = P.spine_angle(s.point("nose"), s.point("body_center"), s.point("tail_base"))
        out |= {"spine_angle": angle, "spine_var_30": s.past(angle, 30, 1, "std")}
    if {"nose", "ear_left", "ear_right"} <= parts:
        head = P.area(s.point("nose"), s.point("ear_left"), s.point("ear_right"))
        out |= {"area_head": head, "area_head_ch": zero(s.diff(head))}
    third = next((p for p in ("body_center", "neck") if p in parts), None)
    if third and {"nose", "tail_base"} <= parts:
        body = P.area(s.point("nose"), s.point("tail_base"), s.point(third))
        out |= {"area_body": body, "shape_factor": body / (P.squared(s.point("nose"), s.point("tail_base")) + EPS)}
    return out


def jitter(s: Frames) -> Columns:
    """Mean and largest second difference of the head's parts in short windows."""
    out = {}
    for p in [p for p in ("nose", "head", "ear_left") if p in s.tracked()]:
        shake = P.length(tuple(s.diff(s.diff(x)) for x in s.point(p)))
        for w in (6, 9, 15):
            out |= {f"{p}_jitter_{kind}_{w}": s.past(shake, s.n(w), 1, kind) for kind in ("mean", "max")}
    return out


def arena(s: Frames) -> Columns:
    """Place in the arena (columns arena_width, arena_height, arena_shape): a shape with `circ` in its name is round.
    Nothing where the arena's size has no columns."""
    if not {"arena_width", "arena_height"} <= set(s.columns):
        return {}
    c, w, h = P.centre(s), s.columns["arena_width"], s.columns["arena_height"]
    away, near = P.apart(c, (w / 2, h / 2)), lambda x: np.where(np.isnan(x), np.nan, np.maximum(x, 0.0))
    if "arena_shape" in s.texts and "circ" in s.texts["arena_shape"].lower():
        corner = wall = near(np.fmin(w, h) / 2 - away)
    else:
        wall = near(np.fmin(np.fmin(c[0], w - c[0]), np.fmin(c[1], h - c[1])))
        corner = np.fmin.reduce([P.apart(c, (x, y)) for x in (np.zeros(len(w)), w) for y in (np.zeros(len(h)), h)])
    close, cornered, n = flag(wall < 2.0), flag(corner < 3.0), s.n(30)
    rate = lambda x: s.past(x, n, max(1, n // 3), "mean")
    return {
        "arena_x_norm": np.clip(c[0] / (w + EPS), 0.0, 1.0), "arena_y_norm": np.clip(c[1] / (h + EPS), 0.0, 1.0), "arena_center_dist": away, "arena_wall_dist": wall,
        "arena_corner_dist": corner, "arena_wall_close_2cm": close, "arena_corner_close_3cm": cornered, "arena_wall_close_rate_1s": rate(close), "arena_corner_close_rate_1s": rate(cornered),
    }


def key_lags(s: Frames, keys: dict[str, Array | None], lags: tuple[int, ...]) -> Columns:
    """Earlier and later values of the keys that are there."""
    out = {}
    for k, x in keys.items():
        for b in lags if x is not None else ():
            out |= {f"{k}_lag{b}": s.lag(x, s.n(b)), f"{k}_lead{b}": s.lag(x, -s.n(b))}
    return out


def single_key_lags(s: Frames, lags: tuple[int, ...] = (5, 10)) -> Columns:
    """nose-tail distance, elongation and fast mean speed, earlier and later."""
    nt = P.apart(s.point("nose"), s.point("tail_base")) if {"nose", "tail_base"} <= set(s.tracked()) else None
    n = s.n(5)
    fast = s.long_enough(s.past(s.step(P.centre(s)) * s.fps, n, max(1, n // 4), "mean"), n)
    return key_lags(s, {"nt_dist": nt, "elong": elongation(s), "sp_m5": fast}, lags)


#: Every family, by name.
FAMILIES = {f.__name__: f for f in (distances, centre_windows, kinematics, paths, turns, speed_scales, speed_states, long_range, grooming, front_rear, part_motion, nose_tail, ears, shape, jitter, arena, single_key_lags)}
