"""One registered query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrail.llm.oracles import ORACLES  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinetrail.llm.records import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer(), end_id=0)


def op2_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinetrail.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"), shards=40)


def op3_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinetrail.llm.neighbours import nearest

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinetrail.llm.lines import dedup_lines

    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), least=1)
    return found.select("doc_id", F.col("_n_lines").alias("n_lines"), F.size("_removed").alias("n_removed"), F.array_join(F.col("_removed").cast("array<string>"), ",").alias("removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinetrail.llm.substrings import dedup_substrings

    found = dedup_substrings(table(spark, sf_dir, "documents"), size=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinetrail.llm.ngram_join import ngram_groups

    return ngram_groups(table(spark, sf_dir, "documents"), n=5, percent=80)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinetrail.llm.language import fit, held_out, identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, fit(docs.filter(~held_out())), "doc_id").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinetrail.llm.contamination import judged

    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinetrail.llm.bpe import digests

    return digests(table(spark, sf_dir, "documents"), tokenizer())


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinetrail.llm.secrets import digest, find_secrets

    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "stop", "form", digest(F.col("candidate")).alias("candidate_sha256"), "score", "is_secret")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinetrail.llm.runs import run_digests

    return run_digests(table(spark, sf_dir, "documents"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinetrail.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinetrail.llm.codes import code_table

    return code_table(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


QUERIES = {f.__name__: f for f in (op1_token_records, op2_minimax_shards, op3_graph_neighbours, op4_line_dedup, op5_substring_dedup, op6_ngram_join, op7_language_id, op8_decontamination, op9_bpe_round_trip, op10_secret_scan, op11_periodic_runs, op12_minhash_dedup, op13_vector_codes)}
