"""Periodic runs against a search of every period."""

import os

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.llm import queries
from kinetrail.llm.runs import find_runs, periodic_runs
from kinetrail.llm.words import mix

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert got == {i: brute.run_digest(i, t) for i, t in docs} and sum(v[0] > 0 for v in got.values()) > 10


@pytest.mark.parametrize("collide", [False, True])
def test_random_documents(collide):
    """Small alphabets, planted repeats that overlap, several documents at once; with every hash the same too."""
    rng = np.random.default_rng(5)
    for _ in range(60 if collide else 300):
        docs = []
        for _ in range(rng.integers(1, 6)):
            n = int(rng.integers(0, 160))
            w = rng.integers(0, rng.integers(1, 5), n)
            for _ in range(rng.integers(0, 3) if n > 40 else 0):
                a, p = int(rng.integers(0, n)), int(rng.integers(1, 20))
                b = min(n, a + p * int(rng.integers(2, 12)))
                w[a:b] = np.resize(w[a : a + p], b - a)
            docs.append(w)
        c, first = np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        hashes = np.ones(len(c), np.uint64) if collide else mix(c.astype(np.uint64) + np.uint64(7))
        got = find_runs(hashes, first, lambda a, b, k: bool((c[a : a + k] == c[b : b + k]).all()))
        assert list(map(tuple, got.tolist())) == [(a + int(f), b + int(f), p) for d, f in zip(docs, first) for a, b, p in brute.runs(d.tolist())]


def test_odd_rows(spark):
    long = " ".join(f"w{i % 9000}" for i in range(100_000))
    rows = [(None, "a b " * 30), (None, "a b " * 30), (1, None), (1, ""), (2, " \n\t"), (3, long), (4, "x" * 200_000), (5, "ab\xa0cd " * 24), (6, "ab " * 23), (7, "p q r " * 8 + "s " * 24 + "end")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, body string, length int").repartition(3)
    got = periodic_runs(df, "body", "length")
    assert got.columns == ["doc_id", "body", "length", "n_words", "runs", "text"]
    found = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["text"][:20], r["body"], r["length"]) for r in got.collect()), key=str)
    want = [
        (None, 60, [(0, 60, 2)], "a b"), (None, 60, [(0, 60, 2)], "a b"), (1, 0, [], ""), (1, 0, [], ""), (2, 0, [], ""), (3, 100_000, [(0, 100_000, 9000)], long[:20]), (4, 1, [], "x" * 20),
        (5, 24, [(0, 24, 1)], "ab\xa0cd"), (6, 23, [], "ab ab ab ab ab ab ab"), (7, 49, [(0, 24, 3), (24, 24, 1)], "p q r s end"),
    ]
    assert found == sorted(((*w, "k", 1) for w in want), key=str)
    assert periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="runs"):
        periodic_runs(df.withColumn("runs", F.lit(1)), "runs")


def test_digest_of_odd_ids(spark):
    rows = [(i, "one two three " * 9 + "four") for i in (None, 0, -7, 10, 26, 33)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.mode("overwrite").parquet(f"{spark.conf.get('spark.checkpoint.dir')}/odd-ids/documents.parquet")
    got = {r[0]: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, f"{spark.conf.get('spark.checkpoint.dir')}/odd-ids").collect()}
    assert got == {i: brute.run_digest(i, t) for i, t in rows}
