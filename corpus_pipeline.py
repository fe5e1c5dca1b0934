"""A corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrail.llm.bpe import digests
from kinetrail.llm.common import discard, stored
from kinetrail.llm.contamination import decontaminate
from kinetrail.llm.language import fit, held_out, identify
from kinetrail.llm.lines import dedup_lines
from kinetrail.llm.ngram_join import one_of_each
from kinetrail.llm.queries import table, tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (`und`: null text or no letter) go; lang becomes the predicted one."""
    found = identify(docs, fit(docs.filter(~held_out())), *COLUMNS)
    return found.filter("lang_pred <> 'und'").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go; n_chars counts what is left. A document none of whose words are left stays,
    empty."""
    return dedup_lines(docs, least=1).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays, that with the smallest doc_id."""
    return one_of_each(docs).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; hit spans are cut out of the others."""
    kept = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document, encoded and decoded."""
    return digests(docs, tokenizer())


STAGES = [("language ID", language), ("line dedup", lines), ("n-gram Jaccard join", groups), ("benchmark decontamination", benchmark), ("BPE encoding and decoding", tokens)]

#: SQL can express neither the language models nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage{k}")
        discard(before)  # the disk holds one stage's documents, and while the next is written two
    return STAGES[-1][1](spark, docs, sf_dir)
