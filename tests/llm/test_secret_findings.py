"""Secret scans on findings written by hand: families of formats that training never saw, and literal texts."""

import os

import pytest

from kinetrail.llm import secrets

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def corpus(spark):
    return secrets.learn(spark.read.parquet(f"{SF}/documents.parquet"))


def test_families_left_out_of_training(spark, corpus):
    """Five forests, each fitted without a fifth of the families and judged on those."""
    kinds = sorted({(f, label) for f, label, *_ in secrets.written()})
    true, false = ([f for f, label in kinds if label == v] for v in (1.0, 0.0))
    made, tp, fp, fn = secrets.example_findings(spark, corpus).cache(), 0, 0, 0
    for k in range(5):
        out = frozenset(true[k::5] + false[k::5])
        model = secrets.train(made.unionByName(secrets.written_findings(spark, corpus, without=out)))
        for r in secrets.judge(secrets.written_findings(spark, corpus, only=out), model).collect():
            tp, fp, fn = tp + (r["is_secret"] and r["label"] == 1), fp + (r["is_secret"] and r["label"] == 0), fn + (not r["is_secret"] and r["label"] == 1)
    print("held-out families:", tp / (tp + fp), tp / (tp + fn))
    assert tp / (tp + fp) >= 0.75 and tp / (tp + fn) >= 0.8 and tp + fn > 45


def test_literal_texts(spark):
    rows = [
        (1, "password: hunter2secret", True), (2, "order 20240115-AB-99312-XKQ-11", False), (3, "see https://user:p4ssw0rdXY@host/db", True), (4, "run tool --password Qx7!marsh42 now", True), (5, "commit 9fceb02d0ae598e95dc970b74767f19372d61af8", False),
        (6, "password = os.environ.get('X')", False), (7, "the password policy and the secret garden", None), (8, "https://host/a:b", None),
    ]
    found = secrets.find_secrets(spark.createDataFrame([(i, t, "web") for i, t, _ in rows], "doc_id long, text string, source string")).collect()
    by = {r["doc_id"]: r["is_secret"] for r in found}
    assert by == {i: want for i, _, want in rows if want is not None}


def test_given_findings_are_learned(spark):
    """A table of labelled findings turns a format that the forest would pass over."""
    docs = spark.createDataFrame([(1, "badge ZZ-00-1234-5678-9012 was lost", "web")], "doc_id long, text string, source string")
    told = [(i, f"badge ZZ-00-{1000 + 7 * i}-{2000 + 13 * i}-{3000 + 17 * i} was lost", f"ZZ-00-{1000 + 7 * i}-{2000 + 13 * i}-{3000 + 17 * i}", "web", 1.0) for i in range(60)]
    plain = secrets.find_secrets(docs).first()
    taught = secrets.find_secrets(docs, spark.createDataFrame(told, "doc_id long, text string, value string, source string, label double")).first()
    assert not plain["is_secret"] and taught["is_secret"] and taught["score"] > plain["score"]


def test_corpus_model(spark, corpus):
    """Words of the corpus surprise less than random letters; one pass counts both."""
    assert corpus.surprise("garden") < corpus.surprise("xq9zkv7j") and corpus.surprise("a") == corpus.surprise("") == 0.0
    small = spark.createDataFrame([(1, "abc abc"), (2, "abc xyz"), (3, None), (4, "")], "doc_id long, text string")
    found = secrets.learn(small)
    assert "abc" in found.words and "xyz" not in found.words
    assert secrets.learn(small.limit(0)).words == frozenset(secrets.PLACEHOLDERS)
