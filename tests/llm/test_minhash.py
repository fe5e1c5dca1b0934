"""MinHash near-duplicates against all pairs."""

import brute
import numpy as np
import pytest

from kinetrail.llm.minhash import Bands, Sequential, least_matches, near_duplicates

WORDS = [f"w{i}" for i in range(400)]


@pytest.mark.parametrize("chunk, most", [(48 << 20, 400), (4000, 400), (48 << 20, 8)])
def test_near_and_nearly_near_copies(spark, chunk, most):
    """Many sets in one block, some linked, some just short of the bound; a few words, none, null; cut into chunks and not."""
    rng = np.random.default_rng(3)
    rows = [(900, None), (901, ""), (902, "a B"), (903, "A\tb"), (904, " \n"), (905, "a b c"), (906, "x " * 3000), (907, " ".join(WORDS * 20)), (908, " ".join(WORDS * 20) + " w1 w7 end")]
    for i in range(150):
        w = list(WORDS[:100])
        for j in rng.choice(100, rng.integers(0, 5), replace=False):
            w[j] = f"z{rng.integers(0, 9)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, kept string").repartition(4)
    want = brute.components(rows, 3, 85)
    assert 5 < len({c for _, c in want.values()}) < 100 and want[903][1] == 902 and want[908][1] == 907
    got = near_duplicates(df, chunk=chunk, most=most)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == {d: (n, c, c == d) for d, (n, c) in want.items()}


def test_null_and_shared_ids(spark):
    a, b = " ".join(WORDS[:30]), " ".join(WORDS[100:130])
    rows = [(None, a), (4, a), (1, a), (1, b), (7, b), (None, b), (None, "alone"), (4, a)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r[0], r[2], r[3]) for r in got.collect()), key=str) == sorted([(None, 1, False), (4, 1, False), (4, 1, False), (1, 1, True), (1, 1, True), (7, 1, False), (None, 1, False), (None, None, True)], key=str)
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_posterior_bound():
    """The bound is the exact tail of a binomial, and grows with what was seen."""
    from math import comb

    for n in (1, 20, 48):
        tail = [sum(comb(n + 1, k) * 0.85**k * 0.15 ** (n + 1 - k) for k in range(m + 1)) for m in range(n + 1)]
        assert least_matches(n, 85, 1e-4) == next(m for m, p in enumerate(tail) if p >= 1e-4)
    assert least_matches(30, 100, 1e-9) == 30


def test_pairs_of_known_similarity_survive_bands_and_batches():
    """2000 pairs at 0.85 and a bit more: each shares a band and passes every batch; pairs at 0.3 mostly don't."""
    rng, method = np.random.default_rng(8), Bands(85)
    draw = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    lost = met = 0
    for k in range(2000):
        both = draw(170 + 17 * (k % 10))
        other = len(both) * 3 // 17
        x, y = (np.unique(np.concatenate([both, part])) for part in (draw(other // 2), draw(other - other // 2)))
        block = Sequential(method)
        keys = [method.keys(s).view(np.int64).tolist() for s in (x, y)]
        for s, ks in zip((x, y), keys):
            block.add(s, ks)
        lost += block.find(1) != 0
        far = np.unique(np.concatenate([both[: len(both) // 2], draw(len(both) // 2)]))
        met += bool(set(method.keys(far).view(np.int64).tolist()) & set(keys[0]))
    assert lost == 0 and met < 400
