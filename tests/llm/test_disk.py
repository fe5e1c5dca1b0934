"""What operators leave on the disk while they run, and that slices change nothing."""

import glob
import os
import random
import time

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinetrail.llm import common, ngram_join
from kinetrail.llm.ngram_join import linked, meetings, one_of_each, with_ids


def shuffled(spark):
    local = spark.sparkContext.getConf().get("spark.local.dir")
    return {f for f in glob.glob(f"{local}/**/shuffle_*", recursive=True) if os.path.getsize(f)}


def test_a_stored_table_leaves_no_shuffle(spark):
    before = shuffled(spark)
    setting = spark.conf.get(common.CLEANUP)
    got = common.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    until = time.time() + 20
    while (left := shuffled(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and got.count() == 7 and spark.conf.get(common.CLEANUP) == setting


@pytest.mark.parametrize("slice_keys, sent", [(1, 1), (1, 20), (10**9, 10**9)])
def test_slices_link_alike(spark, slice_keys, sent):
    r = random.Random(4)
    base = [" ".join(r.choice("abcdefghij") + str(r.randrange(40)) for _ in range(60)) for _ in range(25)]
    near = [t.rsplit(" ", k + 1)[0] + " x" * (k + 1) for k, t in enumerate(base)]
    rows = list(enumerate([*base, *near, base[0], "two words", "two words", "", None]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in with_ids(linked(df.repartition(3), slice_keys=slice_keys, sent=sent)).collect()}
    assert got == brute.components(rows)
    assert {x["doc_id"] for x in one_of_each(df).collect()} == {k for k, (_, c) in got.items() if k == c}


def test_the_pipeline_keeps_one_stage(spark, monkeypatch, tmp_path):
    held = []
    stages = [(name, lambda s, docs, d, f=f: (held.append(len(glob.glob(f"{folder}/stage*"))), docs)[1]) for name, f in corpus_pipeline.STAGES]
    folder = common.scratch(spark).removeprefix("file://")
    before = len(glob.glob(f"{folder}/stage*"))
    spark.createDataFrame([(1, "a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 1
    assert [n - before for n in held] == [0, 1, 1, 1, 1]


def test_a_common_passage_makes_no_large_block(spark, monkeypatch):
    r, names = random.Random(5), []
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(i, f"{passage} " + " ".join(f"w{r.randrange(10**6)}" for _ in range(20))) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " x") for i in range(0, 12, 2)]
    monkeypatch.setattr(ngram_join, "stored", lambda df, name: (names.append(name), common.stored(df, name))[1])
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in with_ids(linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), most=8)).collect()}
    assert got == brute.components(rows) and len({c for _, c in got.values()}) == 60
    assert names.count("blocks") == 2 and "large" not in names


def test_large_blocks_meet_in_turns(spark, monkeypatch):
    r, names = random.Random(6), []
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for j in r.sample(range(60), r.randrange(2, 5)):
            w[j] = f"z{r.randrange(9)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(ngram_join, "stored", lambda df, name: (names.append(name), common.stored(df, name))[1])
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in with_ids(linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), most=8, met=1)).collect()}
    assert got == brute.components(rows) and len({c for _, c in got.values()}) > 5
    assert names.count("met") > 2


def test_each_query_chunk_has_one_turn(spark):
    rows = [(b, s, s % 3, 0, s % 4, 4, 3 + b) for b in (0, 1) for s in range(40)]
    rest = spark.createDataFrame(rows, "block long, sid long, label long, main long, q int, c int, r long").selectExpr("*", "binary('') items", "array(1L) keys", "1L weight")
    of = lambda turns: [[(x["block"], x["ask"], x["to"], x["sid"], x["asks"]) for x in meetings(rest, turns, k).collect()] for k in range(turns)]
    whole, cut = of(1)[0], of(3)
    assert sorted(x for turn in cut for x in turn) == sorted(whole) and all(cut)
    assert [sum(not x[4] for x in whole), sum(x[4] for x in whole)] == [40 * 3 + 40 * 4, 2 * 26 * 4]
    seen = [{x[:2] for x in turn} for turn in cut]
    assert sum(map(len, seen)) == len(set().union(*seen)) == 7


def test_the_pipeline_cuts_a_large_block(spark, monkeypatch):
    r, names = random.Random(7), []
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(i, f"{passage} " + " ".join(f"w{r.randrange(10**6)}" for _ in range(20)), "en", "s", 1) for i in range(420)]
    rows += [(1000 + i, rows[i][1] + " x", "en", "s", 1) for i in range(3)]
    monkeypatch.setattr(ngram_join, "stored", lambda df, name: (names.append(name), common.stored(df, name))[1])
    kept = corpus_pipeline.groups(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert sorted(x["doc_id"] for x in kept.collect()) == list(range(420)) and "large" not in names
