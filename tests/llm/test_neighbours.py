"""Neighbours where lengths differ wildly, ids are shared and rows repeat, against brute force."""

import numpy as np
import pytest

from kinetrail.llm.neighbours import nearest

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k=20):
    """{(query_id, place): [(vec_id, score), ...]} of rows whose id is divisible by 20, by all products."""
    out = {}
    for i, (q, v) in enumerate(rows):
        if q % 20 == 0:
            with np.errstate(over="ignore", invalid="ignore"):
                scores = [(float(np.dot(v, w)), w_id) for j, (w_id, w) in enumerate(rows) if j != i]
            out[q, i] = [(w_id, s) for s, w_id in sorted(scores, key=lambda x: (-x[0], x[1]))[:k]]
    return out


def recall(spark, rows, shard=300):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], SCHEMA).repartition(3)
    got = {}
    for r in nearest(df, df.filter("vec_id % 20 = 0"), k=20, shard=shard).collect():
        got.setdefault(r["query_id"], set()).add((r["vec_id"], r["rank"]))
    want = brute(rows)
    assert set(got) == {q for q, _ in want} and all(len(x) == 20 for x in got.values())
    return sum(len({v for v, _ in got[q]} & {v for v, _ in near}) for (q, _), near in want.items()) / sum(len({v for v, _ in near}) for near in want.values())


@pytest.mark.parametrize("factor", [1.0, 1e3, 1e5, 1e40])
def test_recall_with_very_long_vectors(spark, factor):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    rows = [(i, centres[i % 40] + rng.normal(size=16) * 0.4) for i in range(1500)]
    rows[7] = (7, rows[7][1] * factor)
    rows[40] = (40, rows[40][1] * factor)
    assert recall(spark, rows) >= 0.95


def test_lengths_over_many_bands(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8) * 10.0 ** rng.uniform(-150, 150)) for i in range(400)]
    assert recall(spark, rows) >= 0.95


def test_products_beyond_a_double(spark):
    """Three vectors near 1e200: every query keeps its 20 rows."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8) * (1e200 if i in (20, 21, 22) else 1.0)) for i in range(200)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], SCHEMA)
    got = nearest(df, df.filter("vec_id % 20 = 0"), k=20).collect()
    assert len(got) == 200 and all(r["score"] == r["score"] for r in got)


def test_shared_ids_and_repeats(spark):
    """Every row but the query's own is a candidate, also those of its id."""
    rows = [(0, [1.0, 0.0]), (0, [2.0, 0.0]), (5, [3.0, 0.0]), (5, [3.0, 0.0]), (7, [0.0, 1.0]), (20, [1.0, 1.0]), (20, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA + ", q string, band int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest(df, df.filter("vec_id % 20 = 0")).collect())
    want = [(q, n + 1, v, s) for (q, _), near in brute([(i, np.array(v)) for i, v in rows]).items() for n, (v, s) in enumerate(near)]
    assert got == sorted(want) and len(got) == 4 * 6
