"""Boosted trees: missing values find their side, every model has its own rows, the order of rows doesn't matter."""

import numpy as np
import pytest

from kinetrail.operators.boosting import Settings, fit, fit_all, probability, score_all, trees_of

SMALL = Settings(trees=8, depth=3, step=0.3, least=0.1, ratio=None)


@pytest.mark.parametrize("sign", [1, -1])
def test_missing_values_go_to_a_learned_side(sign):
    """Missing values behave like large ones, then like small ones; nothing imputes them."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    gone = rng.random(4000) < 0.3
    y = np.where(gone, sign > 0, x[:, 1] > 0.5)
    x[gone, 1] = np.nan
    trees = fit(x[:3000], y[:3000], SMALL)
    assert ((probability(trees, x[3000:]) > 0.5) == y[3000:]).mean() > 0.98
    at = np.array([[0.0, np.nan, 0.0]])
    assert (probability(trees, at)[0] > 0.5) == (sign > 0)


def test_only_missing_tells():
    x = np.array([[1.0], [2.0], [3.0], [np.nan], [np.nan]] * 20)
    y = np.isnan(x[:, 0])
    p = probability(fit(x, y, SMALL), x)
    assert p[y].min() > 0.8 and p[~y].max() < 0.2


def test_all_rows_count(spark):
    """No bound by default; the trees are those of all rows, fitted one by one."""
    assert Settings().most is None
    rng = np.random.default_rng(5)
    u, v = rng.integers(0, 500, 3000) / 7, np.where(rng.random(3000) < 0.1, np.nan, rng.normal(size=3000))
    y = u + np.nan_to_num(v) * 20 > 45
    rows = [("a", i, bool(y[i]), float(u[i]), float(v[i])) for i in range(3000)]
    s = Settings(trees=3, depth=3, ratio=None)
    m = fit_all(spark.createDataFrame(rows, "k string, id long, y boolean, u double, v double").repartition(7), ["k"], ["u", "v"], "id", s).collect()[0]
    assert (m["used_pos"], m["used_neg"]) == (y.sum(), (~y).sum())
    x = np.stack([u, v], axis=1)
    assert np.allclose(probability(trees_of(m["nodes"]), x), probability(fit(x, y, s), x), atol=1e-9)


def test_odd_columns():
    rng = np.random.default_rng(1)
    x = np.stack([np.full(200, np.nan), np.full(200, 7.0), rng.integers(0, 2, 200).astype(float)], axis=1)
    y = x[:, 2] == 1
    assert ((probability(fit(x, y, SMALL), x) > 0.5) == y).all()
    assert (probability(fit(np.full((50, 1), np.nan), np.arange(50) % 5 == 0, SMALL), np.zeros((3, 1))) == pytest.approx(0.5, abs=1e-6))


def test_models_of_every_key(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(3000):
        section, action = int(rng.integers(0, 2)), "ab"[rng.integers(0, 2)]
        u, v = rng.normal(size=2)
        y = (u if action == "a" else -v) > (0.8 if section else -0.2)
        rows.append((section, "single", action, i, bool(y), None if rng.random() < 0.1 else float(u), float("nan") if rng.random() < 0.1 else float(v)))
    rows += [(9, "single", "a", i, True, 1.0, 1.0) for i in range(5)] + [(0, "single", "a", -1, None, 1.0, 1.0)]
    schema = "section int, branch string, action string, id long, y boolean, `u x` double, v double"
    df, keys, names = spark.createDataFrame(rows, schema), ["section", "branch", "action"], ["u x", "v"]
    s = Settings(trees=15, depth=3, step=0.3, ratio=0.5, most=400)
    models = fit_all(df.repartition(5), keys, names, "id", s)
    got = {tuple(m[k] for k in keys): m for m in models.collect()}
    assert set(got) == {(k, "single", a) for k in (0, 1) for a in "ab"}
    for key, m in got.items():
        y = [r[4] for r in rows if r[:3] == key and r[4] is not None]
        pos, neg = sum(y), len(y) - sum(y)
        assert (m["pos"], m["neg"]) == (pos, neg) and m["used_pos"] + m["used_neg"] == min(400, pos + (neg if pos >= neg else pos))
        assert len(trees_of(m["nodes"])) == 15
    again = {tuple(m[k] for k in keys): m for m in fit_all(df.repartition(2), keys, names, "id", s).collect()}
    assert all(again[k]["nodes"] == m["nodes"] for k, m in got.items())
    scored = score_all(df.drop("action"), models, ["section", "branch"], keys, names)
    assert scored.columns == ["section", "branch", "id", "y", "u x", "v", "action", "prob"] and scored.count() == 2 * 3001
    hit = scored.join(df.select("id", "action"), ["id", "action"]).filter("y is not null").selectExpr("avg(cast((prob > 0.5) = y as int))").first()[0]
    assert hit > 0.85
    assert fit_all(df.limit(0), keys, names, "id", s).count() == 0
    with pytest.raises(ValueError, match="nodes"):
        score_all(df, models, ["section", "branch"], keys, names, most=1)
