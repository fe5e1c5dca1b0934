"""Null and shared ids, repeated rows, very long and empty texts, ties and clashing column names, for every operator and
pipeline stage; the registered queries and the pipeline against plain versions."""

import hashlib
import os
import zlib

import brute
import corpus_pipeline
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.llm import queries
from kinetrail.llm.bpe import digests
from kinetrail.llm.contamination import contamination, decontaminate, judged
from kinetrail.llm.language import fit, identify
from kinetrail.llm.lines import dedup_lines
from kinetrail.llm.ngram_join import ngram_groups, one_of_each
from kinetrail.llm.records import read_records, write_records
from kinetrail.llm.secrets import find_secrets
from kinetrail.llm.sharding import shard
from kinetrail.llm.substrings import dedup_substrings

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
A = " ".join(f"alpha{i}" for i in range(30))
LONG = " ".join(f"w{i % 50_000}" for i in range(1_600_000))  # about 10 MB
ROWS = [(None, A), (None, A), (1, A), (1, A), (1, "other words\nthan those"), (2, None), (2, ""), (3, LONG), (4, A + " end"), (None, None), (5, "\n\n \n"), (6, "x" * 100_000)]
CLASH = ("lang", "source", "_id", "_th", "_gone", "_n_words", "_spans", "_items", "lang_pred", "whole_text", "_text", "_rest", "kept_id", "kept_text", "key", "label", "features", "digest", "size")


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    return df.select("*", *(F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASH), F.lit(7).cast("long").alias("n_chars")).cache()


def test_outputs_hold_every_row(spark, odd, tmp_path):
    n, bench = len(ROWS), spark.createDataFrame([(1, A), (None, "w7 w8")], "item_id long, text string")
    tok = queries.tokenizer()
    found = {
        "shards": shard(odd, 3), "lines": dedup_lines(odd, least=1), "substrings": dedup_substrings(odd), "groups": ngram_groups(odd), "languages": identify(odd, fit(odd), "doc_id", "lang_pred", "whole_text"),
        "judged": judged(odd, bench), "digests": digests(odd, tok),
    }
    for name, df in found.items():
        assert df.count() == n, name
    write_records(odd, tok, f"file://{tmp_path}/r", files=2)
    assert read_records(spark, f"file://{tmp_path}/r").count() == n
    assert find_secrets(odd).count() >= 0
    with pytest.raises(ValueError, match="_items"):
        contamination(odd, bench)


def test_stages_keep_columns_and_values(spark, odd):
    bench = spark.createDataFrame([(1, A)], "item_id long, text string")
    mark = lambda df: sorted(tuple(str(r[c]) for c in ("doc_id", *CLASH, "n_chars")) for r in df.collect())
    lined = dedup_lines(odd, least=1)
    assert mark(lined) == mark(odd) and lined.columns[: len(odd.columns)] == odd.columns
    clean = decontaminate(odd, bench)
    assert clean.columns == odd.columns and mark(clean) == mark(odd.filter(~F.coalesce(F.col("text").startswith(A), F.lit(False))))
    one = one_of_each(odd)
    assert one.columns == odd.columns and one.filter(F.col("text") == A).select("doc_id").distinct().collect()[0][0] == 1
    assert corpus_pipeline.language(spark, odd, "").columns == list(corpus_pipeline.COLUMNS)


def test_lines_and_substrings_with_ties(spark, odd):
    gone = {(r["doc_id"], r["text"] or "") for r in dedup_lines(odd, least=1).collect()}
    assert (None, A) in gone and (1, "") in gone and (1, "other words\nthan those") in gone and (4, "") in gone and (3, LONG) in gone
    kept = [(r["doc_id"], r["n_words"], r["n_removed"]) for r in dedup_substrings(odd).collect()]
    assert kept.count((None, 30, 0)) == 2 and kept.count((1, 30, 30)) == 2 and (4, 31, 30) in kept and [x[1:] for x in kept if x[0] == 3] == [(1_600_000, 1_550_000)]


def test_languages_of_tied_rows(spark):
    rows = [(None, f"{w} der die das und nicht {i % 3}", "de") for i, w in enumerate(["ja"] * 900)] + [(None, f"the and of was {i}", "en") for i in range(900)] + [(i, f"mot{i} les des est pas", f"l{i % 230}") for i in range(460)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(df, per_lang=20)
    assert len(model.langs) == 232 and "de" in model.langs
    assert {r["lang_pred"] for r in identify(df.filter("lang = 'en'"), model).collect()} == {"en"}


def test_shards_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "t" * int(rng.integers(0, 900)) + str(i % 211)) for i in range(400)] + [(1000 + i, "copies") for i in range(60)] + [(2000, "g" * 40_000)] + [(7, None), (7, None), (None, "copies")]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 9).collect()
    size = lambda t: len((t or "").encode()) + 16
    groups: dict[str, int] = {}
    for _, t in rows:
        key = hashlib.sha256((t if t is not None else "null text").encode()).hexdigest()
        groups[key] = groups.get(key, 0) + size(t)
    # groups above the mean of what is left stand alone, the others are cut at the smallest feasible capacity
    left, alone = sum(groups.values()), []
    for key, s in sorted(groups.items(), key=lambda x: (-x[1], x[0])):
        if len(alone) < 8 and s * (9 - len(alone)) > left:
            alone.append(key)
            left -= s
    sizes = [s for k, s in sorted(groups.items()) if k not in alone]

    def shards_at(c):
        n, room = 1, c
        for s in sizes:
            if s > room:
                n, room = n + 1, c
            room -= s
        return n

    capacity = max(sizes)
    while shards_at(capacity) > 9 - len(alone):
        capacity += 1
    loads: dict[int, int] = {}
    for r in got:
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
    assert len(got) == len(rows) and max(v for k, v in loads.items() if k >= len(alone)) == capacity and {loads[k] for k in range(len(alone))} == {groups[k] for k in alone}
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted((i is None, i or 0, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    for k in loads:
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    assert sorted(map(tuple, queries.QUERIES[name](spark, SF).select(*want.columns).collect())) == sorted(want.fetchall())


def test_pipeline_against_plain_versions(spark):
    """Each stage of run() on what plain versions of the stages before it leave."""
    from tokenizers import Tokenizer

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [(d, t) for d, t in docs if t and any(c.isalpha() for c in t)]
    gone = brute.lines(docs, least=1)
    docs = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in set(gone[d][1]))) for d, t in docs]
    groups = brute.components(docs)
    docs = [(d, t) for d, t in docs if groups[d][1] == d]
    judge = {b[0]: b for b in brute.contamination(docs, items)}
    docs = [(d, t) for d, t in docs if not judge[d][5]]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == {d for d, _ in docs} and len(docs) > 100
    t = Tokenizer.from_file(queries.tokenizer())
    for d, text in docs:
        if not judge[d][2]:  # nothing was cut out
            ids = t.encode(text, add_special_tokens=False).ids
            assert (got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["decoded_sha256"]) == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(text))


def test_large_benchmark_reads_documents_once(spark, odd):
    """Fifty blocks of items: equal to one block; the documents are scanned once, each block reads stretches alone."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"v{x}" for x in rng.integers(0, 300, 60)) for _ in range(200)]
    items = [(i, " ".join(texts[i].split()[5 : 5 + (1 if i % 50 == 49 else 30)])) for i in range(100)] + [(None, " ".join(texts[150].split()[:20])), (900, None), (901, "")]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(None, texts[3], 0), (None, None, 0)], "doc_id long, text string, _row long").repartition(4)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    mark = lambda d, **kw: sorted((str(tuple(r)) for r in contamination(d, bench, **kw).collect()))
    want = mark(docs)
    got = mark(docs.mapInArrow(counted, docs.schema), block=60)
    assert got == want and seen.value == 202
    few = spark.createDataFrame([(i, t) for i, t in items if t is None or len(t.split()) != 1], "item_id long, text string")
    one, many = (sorted(str(tuple(r)) for r in contamination(docs, few, block=b, cut=True).collect()) for b in (200_000, 45))
    assert one == many and any("[Row(" in x for x in one)
