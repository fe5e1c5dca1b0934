"""Product codes against plain Lloyd rounds in Python integers."""

import hashlib
from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest

from kinetrail.llm.codes import Bounds, code_table, encode, limbs

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [floor(Fraction(x) * 4096) for x in v], label, v) for i, v, label in rows if v and all(x is not None and isfinite(x) for x in v)]
    size = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    seeds = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[3]))[:entries]
    books = [[cut(s[1], p) for s in seeds] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for k in range(rounds + 1):
        of = [[min((far(cut(v, p), e), j) for j, e in enumerate(books[p])) for p in range(parts)] for _, v, _, _ in kept]
        if k < rounds:
            for p in range(parts):
                for j in range(len(seeds)):
                    mine = [cut(r[1], p) for r, o in zip(kept, of) if o[p][1] == j]
                    if mine:
                        books[p][j] = [sum(c) // len(mine) for c in zip(*mine)]
    errors = [sum(d for d, _ in o) for o in of]
    totals = {}
    for (_, _, label, _), e in zip(kept, errors):
        totals[label] = totals.get(label, 0) + e
    long = lambda x: x if x < 2**63 else None
    total = lambda label: None if any(long(e) is None for r, e in zip(kept, errors) if r[2] == label) and all(long(e) is None for r, e in zip(kept, errors) if r[2] == label) else long(sum(e for r, e in zip(kept, errors) if r[2] == label and long(e) is not None))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{j:02x}" for _, j in o), long(e), total(label), sha) for (i, _, label, _), o, e in zip(kept, of, errors)), key=str)


def check(spark, rows, tasks=3):
    got = code_table(spark.createDataFrame(rows, SCHEMA).repartition(tasks))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_ties_and_clusters(spark):
    """Components on a coarse grid, so that most distances tie, in more tasks than one."""
    rng = np.random.default_rng(1)
    check(spark, [(i, (rng.integers(-3, 4, 16) / 8).tolist(), int(i % 3) if i % 7 else None) for i in range(300)])


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=24).tolist(), 1) for i in range(60)]
    rows += [(3, rows[3][1], 1), (3, rows[4][1], None), (None, rows[5][1], None), (70, None, 1), (71, [], 1), (72, [1.0, None] * 12, 1), (73, [float("nan")] * 24, 2), (74, [float("inf")] + [0.0] * 23, 2), (75, [0.0] * 24, 2)]
    check(spark, rows)
    check(spark, rows[:5])
    extra = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SCHEMA + ", code int, v string, k int")
    assert code_table(extra).count() == len(plain(rows))
    none = code_table(spark.createDataFrame(rows[63:68], SCHEMA))
    assert none.count() == 0 and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError, match="equal parts"):
        encode(spark.createDataFrame([(1, [1.0] * 9, 1)], SCHEMA))


@pytest.mark.parametrize("size", [300.0, 1e9, 1e30, 1.7e308])
def test_very_large_components(spark, size):
    """Some components beyond what doubles add exactly, in the codebook too and not in it; errors beyond a long are null."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) * (size if i in (2, 40) else 1.0) for x in rng.uniform(-1, 1, 8)], i % 2) for i in range(50)]
    check(spark, rows)


def test_bounds_are_exact_and_save_work():
    rng = np.random.default_rng(7)
    v = np.concatenate([rng.integers(0, 50, (400, 4)) + 1000 * k for k in range(8)])
    c, group = v[::200][:16].copy(), np.repeat(np.arange(4), 4)
    found, drift, work = Bounds.none(len(v), 4), None, []
    for _ in range(8):
        work.append(found.assign(v, c, group, drift))
        want = ((v[:, None] - c) ** 2).sum(axis=2)
        assert (found.entry == want.argmin(axis=1)).all()
        new = np.stack([v[found.entry == e].sum(axis=0) // max(1, (found.entry == e).sum()) if (found.entry == e).any() else c[e] for e in range(16)])
        drift, c = np.sqrt(((new - c) ** 2).sum(axis=1).astype(float)), new
    assert work[-1] < work[0] / 4


def test_limbs():
    for x in (0, 5, -5, 2**32, -(2**70) + 3, 10**40):
        assert sum(p << (32 * k) for k, p in enumerate(limbs(x))) == x
