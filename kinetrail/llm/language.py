"""Language identification by hierarchical discrimination: the language family first, then one-versus-one linear support
vector machines for the languages within it.

Features are hashed byte 1- to 3-grams of the lower-cased text, scaled by the square root of their share. The models
are fitted on at most PER_LANG labelled documents of each language, those with the smallest hash, and on at most ROWS of
all: this bounds what comes to the driver at ROWS * DIMS numbers. Every language is learned. Prediction reads every whole
text, in one narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kinetrail.llm.common import bounded, fresh, frugal
from kinetrail.llm.words import groups

DIMS = 1 << 12
#: Most labelled documents of a language that the models are fitted on.
PER_LANG = 300
#: Most labelled documents of all languages together; with more than ROWS / PER_LANG languages each gets an equal share.
ROWS = 20_000
#: Families of language codes; a code not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "be", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}
LETTER = regex.compile(r"\p{L}")


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from row, to row, matrix) over a string column; a row's feature vector has length 1, or 0 for an empty text."""
    lowered = pa.array([(t or "").lower() for t in column.to_pylist()], pa.large_string())
    for a, b, data, offsets in groups(lowered):
        n = b - a
        x = data.astype(np.int64)
        doc = np.repeat(np.arange(n) * DIMS, np.diff(offsets))
        total = np.zeros(n * DIMS, np.int64)
        mixed = x + 1
        for k in range(3):
            if len(x) <= k:
                break
            if k:
                mixed = mixed[:-1] * 263 + x[k:] + 1
            slot = (mixed * 2654435761 + k * 97 >> 7) & (DIMS - 1)
            same = doc[: len(slot)] == doc[k:]
            total += np.bincount((doc[: len(slot)] + slot)[same], minlength=n * DIMS)
        m = np.sqrt(total.reshape(n, DIMS).astype(np.float32))
        size = np.linalg.norm(m, axis=1, keepdims=True)
        yield a, b, m / np.maximum(size, 1e-9)


def hinge(x: np.ndarray, y: np.ndarray, rounds: int = 60, c: float = 1e-4) -> np.ndarray:
    """Weights (last: bias) of a linear support vector machine for y in -1, 1: averaged subgradient steps over all rows,
    classes weighted to equal sums. Deterministic."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = np.zeros(x.shape[1])
    mean = np.zeros_like(w)
    for t in range(1, rounds * 10 + 1):
        miss = y * (x @ w.astype(x.dtype)) < 1
        w += (8.0 / (1 + 0.02 * t)) * ((y * weight * miss).astype(x.dtype) @ x - c * w)
        mean += w * t
    return mean / (rounds * 10 * (rounds * 10 + 1) / 2)


class Model:
    """Families, languages and the machines that tell them apart."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        y = np.array(langs)
        family = np.array([FAMILY.get(v, v) for v in langs])
        self.families = sorted(set(family))
        self.members = {f: [v for v in self.langs if FAMILY.get(v, v) == f] for f in self.families}
        self.top = np.array([hinge(x, np.where(family == f, 1.0, -1.0)) for f in self.families]) if len(self.families) > 1 else None
        self.pairs = {}
        for f, codes in self.members.items():
            for a, b in combinations(codes, 2):
                rows = (y == a) | (y == b)
                self.pairs[a, b] = hinge(x[rows], np.where(y[rows] == a, 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each row: the family's share times the language's share of its pairs."""
        n = len(x)
        if not self.langs:
            return np.full(n, "und", object), np.zeros(n)
        xb = np.hstack([x, np.ones((n, 1), x.dtype)])
        sigmoid = lambda m: 1 / (1 + np.exp(-np.clip(4 * m, -30, 30)))
        if self.top is None:
            best, share = np.zeros(n, int), np.ones(n)
        else:
            margins = xb @ self.top.T
            best = margins.argmax(axis=1)
            share = sigmoid(margins[np.arange(n), best])
        lang, score = np.empty(n, object), np.zeros(n)
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(best == k)
            codes = self.members[f]
            votes = np.zeros((len(rows), len(codes)))
            for (a, b), w in self.pairs.items():
                if a in codes:
                    p = sigmoid(xb[rows] @ w)
                    votes[:, codes.index(a)] += p
                    votes[:, codes.index(b)] += 1 - p
            if len(codes) == 1:
                lang[rows], score[rows] = codes[0], share[rows]
            elif len(rows):
                top = votes.argmax(axis=1)
                lang[rows] = np.array(codes, object)[top]
                score[rows] = share[rows] * votes[np.arange(len(rows)), top] / (len(codes) - 1)
        return lang, np.clip(score, 0, 1)


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """The models learned from docs (doc_id, text, lang): rows with a null text, no letter or null lang don't count, rows
    that repeat in full count once. Other columns play no part."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, m in features(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(a, b - a), pa.array([r.tobytes() for r in m], pa.binary())], ["lang", "x"])

    # the order depends on all of a row, so only rows that repeat in full share a place
    order = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    labelled = bounded(docs).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    places = labelled.select("lang", order.alias("o"))
    n = places.select("lang").distinct().count()
    per_lang = min(per_lang, max(1, ROWS // max(1, n)))
    # the smallest of each language and of 64 slots, without repeats, then of those
    slots = places.withColumn("s", F.pmod("o", F.lit(64))).distinct()
    for by in (["lang", "s"], ["lang"]):
        slots = slots.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("o"))).filter(F.col("n") <= per_lang).drop("n")
    most = slots.groupBy("lang").agg(F.max("o").alias("most"))  # a row a language
    picked = labelled.withColumn("o", order).join(F.broadcast(most), "lang").filter(F.col("o") <= F.col("most")).dropDuplicates(["lang", "o"])
    rows = picked.select("lang", "text").mapInArrow(run, "lang string, x binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["x"]))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows]).reshape(len(rows), DIMS)
    return Model(x, [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """docs' columns `keep` and (lang_pred, score) of each row; score is 0 to 1. Null text or one without a letter: `und`,
    score 0. Nothing learned: always `und`. Rows that repeat fare alike; very long texts are read whole, one after
    another. lang, source and doc_id play no part. Kept columns named like the added ones are replaced by them."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a machine for each family and pair of a family's languages
    keep = [c for c in keep if c.lower() not in ("lang_pred", "score")]
    (name,) = fresh(docs, "whole_text")
    once = "text" in keep and docs.schema["text"].dataType == StringType()  # a kept text travels once
    slim = bounded(docs).select(*[F.col(f"`{c}`") for c in keep], *([] if once else [F.col("text").cast("string").alias(name)]))
    at = keep.index("text") if once else len(keep)
    out = slim.drop(name).schema.add("lang_pred", "string").add("score", "double")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts = batch.column(at)
            lettered = np.array([bool(t and LETTER.search(t)) for t in texts.to_pylist()], bool)
            lang, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            for a, b, x in features(texts):
                lang[a:b], score[a:b] = m.predict(x)
            lang[~lettered], score[~lettered] = "und", 0.0
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(lang, pa.string()), pa.array(score)], names=[*batch.schema.names[: len(keep)], "lang_pred", "score"])

    return slim.mapInArrow(run, out)


def held_out(folds: int = 5) -> Column:
    """Whether a row is kept from learning: crc32 of doc_id as text leaves 0 modulo folds."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == 0
