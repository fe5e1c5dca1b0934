"""Feature families of directed pairs of entities. Each takes the frames of a pair with the agent's parts as `A_<part>_x`,
`A_<part>_y` and the target's as `B_...`, and returns its columns by name; columns whose parts are not tracked are left out."""

from __future__ import annotations

from itertools import product

import numpy as np

from kinetrail.functions import planar as P
from kinetrail.functions.kernel import Array
from kinetrail.functions.motion import Columns, key_lags
from kinetrail.functions.planar import EPS
from kinetrail.functions.sequences import Frames, Point, flag, zero

A, B = "A_", "B_"


def both(s: Frames, *parts: str) -> bool:
    """Whether the parts are tracked on both sides."""
    return set(parts) <= set(s.tracked(A)) & set(s.tracked(B))


def elongation(s: Frames, side: str) -> Array | None:
    """Length of the body over that of the line between the ears."""
    if not {"nose", "tail_base", "ear_left", "ear_right"} <= set(s.tracked(side)):
        return None
    at = lambda p: s.point(p, side)
    return P.apart(at("nose"), at("tail_base")) / (P.apart(at("ear_left"), at("ear_right")) + EPS)


def pair_distances(s: Frames) -> Columns:
    """Squared distances of each part of the agent to each of the target, orientation to each other, elongations."""
    out = {f"12+{p}+{q}": P.squared(s.point(p, A), s.point(q, B)) for p, q in product(s.tracked(A), s.tracked(B))}
    if both(s, "nose", "tail_base"):
        out["rel_ori"] = P.cosine(*(P.minus(s.point("nose", side), s.point("tail_base", side)) for side in (A, B)))
    one, two = elongation(s, A), elongation(s, B)
    out |= {name: x for name, x in (("A_elong", one), ("B_elong", two)) if x is not None}
    return out if one is None or two is None else out | {"AB_elong_diff": one - two, "AB_elong_ratio": one / (two + EPS)}


def _centres(s: Frames) -> tuple[Point, Point]:
    return s.point("body_center", A), s.point("body_center", B)


def _nose_gap(s: Frames) -> Array | None:
    return P.apart(s.point("nose", A), s.point("nose", B)) if both(s, "nose") else None


def _approach(s: Frames) -> Array | None:
    """Change of the squared distance of the noses: positive when they part."""
    return s.diff(P.squared(s.point("nose", A), s.point("nose", B)), s.n(10)) if both(s, "nose") else None


def _steadiness(s: Frames) -> Array | None:
    """Spread of the distance over its mean."""
    if not both(s, "body_center"):
        return None
    gap, n = P.apart(*_centres(s)), s.n(30)
    return s.mid(gap, n, 1, "std") / (s.mid(gap, n, 1, "mean") + EPS)


def pair_motion(s: Frames) -> Columns:
    """Displacements across the pair, approach, distance bins and windows, common movement, nose distances, alignment of
    velocities at offsets, steadiness of the distance."""
    out = {}
    if both(s, "ear_left"):
        a, b = s.point("ear_left", A), s.point("ear_left", B)
        then = lambda p: tuple(s.lag(c, s.n(10)) for c in p)
        out |= {"sp_A": P.squared(a, then(a)), "sp_AB": P.squared(a, then(b)), "sp_B": P.squared(b, then(b))}
    if both(s, "nose"):
        nn = _nose_gap(s)
        near = flag(nn < 10.0)
        out |= {"appr": _approach(s), "nn": nn}
        for k in (10, 20, 40):
            n = s.n(k)
            out |= {f"nn_lg{k}": s.lag(nn, n), f"nn_ch{k}": s.diff(nn, n), f"cl_ps{k}": s.past(near, n, 1, "mean")}
    if both(s, "body_center"):
        ca, cb = _centres(s)
        gap, gap2 = P.apart(ca, cb), P.squared(ca, cb)
        va, vb = (tuple(s.diff(x) for x in c) for c in (ca, cb))
        together, align = P.dot(va, vb), P.cosine(va, vb)
        out |= {"ab_cd": gap, "v_cls": flag(gap < 5), "cls": flag((gap >= 5) & (gap < 15)), "med": flag((gap >= 15) & (gap < 30)), "far": flag(gap >= 30)}
        for w in (5, 15, 30, 60):
            n = s.n(w)
            out |= {f"d_{name}{w}": s.mid(gap2, n, 1, kind) for name, kind in (("m", "mean"), ("s", "std"), ("mn", "min"), ("mx", "max"))}
            out |= {f"int{w}": 1 / (1 + s.mid(gap2, n, 1, "var")), f"co_m{w}": s.mid(together, n, 1, "mean"), f"co_s{w}": s.mid(together, n, 1, "std")}
        out |= {f"va_{o}": align if not o else s.lag(align, -s.n(o) if o > 0 else s.n(-o)) for o in (-20, -10, 0, 10, 20)}
        out["int_con"] = _steadiness(s)
    return out


def _leads(s: Frames) -> tuple[Array, Array, Array]:
    """How far agent and target move along the line between them, and chase."""
    ca, cb = _centres(s)
    away = P.minus(ca, cb)
    va, vb = (tuple(s.diff(x) for x in c) for c in (ca, cb))
    lead_b = P.cosine(vb, (-away[0], -away[1]))
    return P.cosine(va, away), lead_b, -s.diff(P.length(away)) * lead_b


def _chase(s: Frames) -> Array | None:
    n = s.n(30)
    return s.past(_leads(s)[2], n, max(1, n // 6), "mean") if both(s, "body_center") else None


def pair_interaction(s: Frames) -> Columns:
    """Who leads, chase, and correlation of speeds; nothing where a body_center is not tracked."""
    if not both(s, "body_center"):
        return {}
    one, two, _ = _leads(s)
    out = {f"{side}_ld{w}": s.past(x, s.n(w), max(1, s.n(w) // 6), "mean") for w in (30, 60) for side, x in (("A", one), ("B", two))}
    out["chase_30"] = _chase(s)
    speeds = [P.length(tuple(s.diff(x) for x in c)) for c in _centres(s)]
    return out | {f"sp_cor{w}": s.correlation(*speeds, s.n(w), max(1, s.n(w) // 6)) for w in (60, 120)}


FACE, GENITAL = ("nn", "ne_l", "ne_r", "ne_m"), ("nhm", "ntb")


def _sniffs(s: Frames) -> Columns:
    """Distances of the agent's nose to places of the target, and the least of those of its face and rear."""
    if "nose" not in s.tracked(A):
        return {}
    parts, nose = s.tracked(B), s.point("nose", A)
    out = {k: P.apart(nose, s.point(p, B)) for k, p in (("nn", "nose"), ("ne_l", "ear_left"), ("ne_r", "ear_right"), ("ntb", "tail_base")) if p in parts}
    for k, p, q in (("ne_m", "ear_left", "ear_right"), ("nhm", "hip_left", "hip_right")):
        if {p, q} <= set(parts):
            out[k] = P.apart(nose, P.halfway(s.point(p, B), s.point(q, B)))
    return out | {"nbd": P.apart(nose, P.centre(s, ("body_center", "neck"), B))}


def _nearest(found: Columns) -> Columns:
    out = {}
    for name, places in (("face", FACE), ("genital", GENITAL)):
        if have := [found[k] for k in places if k in found]:
            out[f"snf_dmin_{name}"] = np.fmin.reduce(have)
    return out | ({"snf_d_body": found["nbd"]} if "nbd" in found else {})


def pair_sniff(s: Frames) -> Columns:
    """Distances of the agent's nose to the target's face, body and rear: values, changes, statistics, closeness; nothing
    where the agent's nose is not tracked."""
    found = _sniffs(s)
    out = _nearest(found)
    for k, d in found.items():
        out[f"snf_d_{k}"] = d
        out |= {f"snf_dch_{k}_l{b}": zero(s.diff(d, s.n(b))) for b in (5, 10, 20)}
        for w in (15, 30, 60):
            n = s.n(w)
            out |= {f"snf_d{name}_{k}_w{w}": s.past(d, n, max(1, n // 4), kind) for name, kind in (("m", "mean"), ("s", "std"))}
        out |= {f"snf_close_{k}_{c}cm": flag(d < float(c)) for c in (2, 5)}
    return out


def pair_groom(s: Frames) -> Columns:
    """Jitter of the agent's nose (or centre) relative to the target's body, against the target's speed and jitter."""
    prefer, out = ("body_center", "neck", "tail_base"), {}
    body = P.centre(s, prefer, B)
    nose = s.point("nose", A) if "nose" in s.tracked(A) else P.centre(s, prefer, A)
    shake = lambda p: zero(P.length(tuple(s.diff(s.diff(x)) for x in p)))
    relative, own, speed = shake(P.minus(nose, body)), shake(body), zero(P.length(tuple(s.diff(x) for x in body))) * s.fps
    for w in (6, 15, 30):
        over = lambda x, kind="mean": s.past(x, s.n(w), max(1, s.n(w) // 3), kind)  # noqa: B023, E731
        out |= {f"rel_jit_m{w}f": over(relative), f"rel_jit_max{w}f": over(relative, "max"), f"target_spd_m{w}f": over(speed)}
        out |= {f"groom_ratio_{w}f": over(relative) / (over(speed) + 0.1), f"jit_ratio_{w}f": over(relative) / (over(own) + EPS)}
    return out


def pair_egocentric(s: Frames) -> Columns:
    """The target's centre, nose and rear in the agent's own axes (x to the left, y ahead); nothing where the agent's nose
    is not tracked."""
    if "nose" not in s.tracked(A):
        return {}
    parts, out = s.tracked(B), {}
    origin = P.centre(s, ("body_center", "neck"), A)
    ahead = P.minus(s.point("nose", A), s.point("tail_base", A) if "tail_base" in s.tracked(A) else origin)
    size = P.length(ahead) + EPS
    hx, hy = ahead[0] / size, ahead[1] / size
    places = {"Bc": P.centre(s, ("body_center", "neck"), B)}
    if "nose" in parts:
        places["Bn"] = s.point("nose", B)
    if {"hip_left", "hip_right"} <= set(parts):
        places["Bg"] = P.halfway(s.point("hip_left", B), s.point("hip_right", B))
    elif "tail_base" in parts:
        places["Bg"] = s.point("tail_base", B)
    for t, place in places.items():
        d = P.minus(place, origin)
        x, y = d[1] * hx - d[0] * hy, d[0] * hx + d[1] * hy
        vx, vy = (zero(s.diff(c)) * s.fps for c in (x, y))
        v = P.length((vx, vy))
        out |= {f"ego_{t}_x": x, f"ego_{t}_y": y, f"ego_{t}_r": P.length((x, y)), f"ego_{t}_ang": np.arctan2(x, y), f"ego_{t}_vx": vx, f"ego_{t}_vy": vy, f"ego_{t}_v": v}
        out |= {f"ego_{t}_front": flag(y > 0), f"ego_{t}_back": flag(y < 0), f"ego_{t}_left": flag(x > 0), f"ego_{t}_right": flag(x < 0)}
        out |= {f"ego_{t}_front_close": flag((y > 0) & (np.abs(x) < 5)), f"ego_{t}_back_close": flag((y < 0) & (np.abs(x) < 5))}
        for w in (15, 30, 60):
            n = s.n(w)
            for name, c in (("x", x), ("y", y), ("v", v)):
                out |= {f"ego_{t}_{name}{tag}{w}": s.past(c, n, max(1, n // 4), kind) for tag, kind in (("m", "mean"), ("s", "std"))}
    return out | {"ego_B_in_front_rate_1s": s.past(out["ego_Bc_front"], s.n(30), 1, "mean")}


def pair_key_lags(s: Frames, lags: tuple[int, ...] = (5, 10, 20, 40)) -> Columns:
    """Ten key columns of the other families, earlier and later, those that are there."""
    near = _nearest(_sniffs(s))
    keys = {"ab_cd": P.apart(*_centres(s)) if both(s, "body_center") else None, "nn": _nose_gap(s), "appr": _approach(s), "int_con": _steadiness(s), "chase_30": _chase(s)}
    keys |= {k: near.get(k) for k in ("snf_dmin_face", "snf_dmin_genital", "snf_d_body")} | {"A_elong": elongation(s, A), "B_elong": elongation(s, B)}
    return key_lags(s, keys, lags)


FAMILIES = {f.__name__: f for f in (pair_distances, pair_motion, pair_interaction, pair_sniff, pair_groom, pair_egocentric, pair_key_lags)}
