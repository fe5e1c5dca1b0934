"""Secret scanning: pattern candidates over whole texts, and a random forest that removes false positives.

The forest looks at a candidate's length, its transitions between characters (against those of the corpus' words) and
kinds of them, how much of it words of the corpus cover, the path it was found under and paths around it, and the
neighbouring words, hashed. It is trained from labelled findings: those of findings.tsv, which were written by hand and
not by this module, a table of more where one is given, and examples(), which are made from formats.
"""

from __future__ import annotations

import math
import pathlib
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrail.llm.common import bounded, discard, stored
from kinetrail.llm.words import LOWER, texts

#: Most labelled findings of a class the forest is fitted on (those with the smallest hashes).
MOST = 5000
#: How much a finding of findings.tsv or of a given table counts, in examples.
WEIGHT = 20.0
#: Hash buckets of the words before and after a candidate.
BEFORE, AFTER = 32, 12
#: Candidates: an assigned value, a known prefix, a long run that mixes in digits, a password within an address, an option.
CANDIDATE = re.compile(
    r"(?:(?<=password)|(?<=passwd)|(?<=secret)|(?<=token)|(?<=key))[\"']?\s{0,2}[=:]\s{0,2}[\"']?([A-Za-z0-9+/_\-.$!@#%^&*]{6,})"
    r"|((?:AKIA|ASIA)[A-Z0-9]{12,}|gh[pousr]_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9\-_]{16,}|xox[abprs]-[A-Za-z0-9\-]{10,}|-----BEGIN [A-Z ]*PRIVATE KEY-----)"
    r"|(?<![A-Za-z0-9+/_\-])((?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{16,})"
    r"|(?<=://)[A-Za-z0-9_.\-]{1,32}:([^\s@/:\"']{4,64})(?=@)"
    r"|(?<=--)(?:password|token|secret|api-key)\s([^\s\"'=\-][^\s\"']{5,})",
    re.IGNORECASE,
)
FORMS = ("assigned", "prefix", "run", "address", "option")
#: Quick test that a text may hold a candidate: nothing that CANDIDATE takes fails it.
MAYBE = re.compile(r"[A-Za-z0-9+/_\-]{15}|[=:]|--", re.IGNORECASE)
#: Words of placeholders, for dictionary coverage beside those counted in the corpus.
PLACEHOLDERS = "example sample test dummy password passwd secret token key user admin name value default change changeme your here null none true false string data file path index version hash public private placeholder".split()
WORD = re.compile(r"[a-z]{3,20}")
HINTS = ("password", "passwd", "secret", "token", "key", "auth", "credential", "aws", "login")
OTHERS = ("card", "phone", "iban", "order", "uuid", "sha", "md5", "commit", "digest", "isbn", "version")
FEATURES = ("length", "digits", "upper", "lower", "marks", "transitions", "entropy", "coverage", "longest_letters", "longest_digits", "assigned", "hint", "other", "in_path", "path_test", "path_config", "quoted", "surprise", "called", "prefix", *(f"before{k}" for k in range(BEFORE)), *(f"after{k}" for k in range(AFTER)))
#: Kinds of characters of the transition model: a to z, digits, all others.
KINDS = np.full(256, 27)
KINDS[97:123], KINDS[65:91], KINDS[48:58] = np.arange(26), np.arange(26), 26
NEAR = re.compile(r"[A-Z]?[a-z]+|[A-Z]{2,}")


class Corpus:
    """What the corpus' own texts tell: words that many documents have, and how often one character follows another in
    them (counts over KINDS)."""

    def __init__(self, words: frozenset[str] = frozenset(), pairs: np.ndarray | None = None):
        self.words = words | frozenset(PLACEHOLDERS)
        counts = (np.zeros((28, 28)) if pairs is None else pairs) + 1.0
        self.bits = -np.log2(counts / counts.sum(axis=1, keepdims=True))

    def surprise(self, candidate: str) -> float:
        """Mean bits of a character given the one before it."""
        k = KINDS[np.frombuffer(candidate.encode(), np.uint8)]
        return float(self.bits[k[:-1], k[1:]].mean()) if len(k) > 1 else 0.0


def hashed_near(text: str, size: int, last: int) -> list[int]:
    """Which buckets the `last` last words of text (split at case and marks) fall in; negative: the first ones."""
    found = [w.lower() for w in NEAR.findall(text)]
    return [zlib.crc32(w.encode()) % size for w in (found[-last:] if last > 0 else found[:-last])]


def covered(candidate: str, words: frozenset[str]) -> int:
    """Characters of candidate that words of at least 3 characters cover, longest first from left to right."""
    low, at, total = candidate.lower(), 0, 0
    while at < len(low) - 2:
        for k in range(min(12, len(low) - at), 2, -1):
            if low[at : at + k] in words:
                total, at = total + k, at + k
                break
        else:
            at += 1
    return total


def measure(candidate: str, before: str, after: str, path: str, form: str, corpus: Corpus) -> list[float]:
    """FEATURES of a candidate between the texts before and after it."""
    n = len(candidate)
    kinds = "".join("d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "m" for c in candidate)
    count = Counter(candidate)
    near = (before[-48:] + " " + after[:24]).lower()
    beside = [0.0] * (BEFORE + AFTER)
    for k in hashed_near(before, BEFORE, 5):
        beside[k] = 1.0
    for k in hashed_near(after, AFTER, -2):
        beside[BEFORE + k] = 1.0
    longest = lambda k: max((len(m) for m in re.findall(k, kinds)), default=0)
    return [float(x) for x in (
        n, kinds.count("d") / n, kinds.count("u") / n, kinds.count("l") / n, kinds.count("m") / n, sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1),
        -sum(c / n * math.log2(c / n) for c in count.values()), covered(candidate[:200], corpus.words) / min(n, 200), longest("[ul]+"), longest("d+"), form in ("assigned", "address", "option"),
        any(h in near for h in HINTS), any(h in near for h in OTHERS), before[-1:] in ("/", "\\") or after[:1] in ("/", "\\") or "://" in before[-24:] or candidate.count("/") > 1,
        bool(re.search(r"test|example|doc|sample", path, re.I)), bool(re.search(r"conf|env|secret|key|\.ya?ml|\.ini", path, re.I)), before[-1:] in "\"'" and before[-1:] != "" and after[:1] in ("\"", "'"),
        corpus.surprise(candidate[:200]), after[:1] == "(" or candidate.startswith("$"), form == "prefix", *beside,
    )]


def learn(docs: DataFrame, share: int = 1000) -> Corpus:
    """The Corpus of docs, in one pass: words (lower-cased runs of 3 to 20 letters a-z) that at least one in `share`
    documents has, and two at least (so at most share times the mean number of different words in a document, however
    many documents there are), and the 28 x 28 counts of characters that follow each other."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[str] = Counter()
            for t in batch.column("text").to_pylist():
                seen.update(set(WORD.findall(t.lower())))
            kinds = KINDS[LOWER[texts(batch.column("text"))[0]]]
            follow = np.bincount(kinds[:-1] * 28 + kinds[1:], minlength=784) if len(kinds) else np.zeros(784, int)
            names = [*seen, "0", *(f"1 {k}" for k in np.flatnonzero(follow))]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([*seen.values(), batch.num_rows, *follow[follow > 0].tolist()], pa.int64())], ["word", "n"])

    read = bounded(docs).select(F.col("text").cast("string").alias("text")).filter("text is not null")
    rows = stored(read.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    told = {r["word"]: r["n"] for r in rows.filter("word = '0' or word like '1 %'").collect()}
    least = max(2, -(-told.get("0", 0) // share))
    pairs = np.zeros(784)
    for name, n in told.items():
        if name != "0":
            pairs[int(name[2:])] = n
    words = frozenset(r["word"] for r in rows.filter((F.col("n") >= least) & (F.col("word") >= "a")).select("word").collect())
    discard(rows)
    return Corpus(words, pairs.reshape(28, 28))


def scan(docs: DataFrame, path: str = "source", corpus: Corpus | None = None) -> DataFrame:
    """(doc_id, start, stop, form, candidate, before, after, path, features): the candidates of each row of docs (doc_id, text,
    and a column that names the path, where there is one); start and stop count characters. Null text: none. corpus:
    what learn() found."""
    where = F.col(f"`{path}`").cast("string") if path in docs.columns else F.lit(None).cast("string")
    sent = docs.sparkSession.sparkContext.broadcast(corpus or Corpus())  # bounded as learn() says

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [], [], [])
            for i, t, p in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "path"))):
                if not t or not MAYBE.search(t):
                    continue
                for m in CANDIDATE.finditer(t):
                    g = m.lastindex
                    a, b = m.span(g)
                    before, after = t[max(0, a - 64) : a], t[b : b + 32]
                    for c, v in zip(out, (i, a, b, FORMS[g - 1], m[g], before, after, p, measure(m[g], before, after, p or "", FORMS[g - 1], known))):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "start", "stop", "form", "candidate", "before", "after", "path", "features"])

    slim = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), where.alias("path"))
    return slim.mapInArrow(run, "doc_id long, start long, stop long, form string, candidate string, before string, after string, path string, features array<double>")


def examples(n: int = 4000, seed: int = 11) -> list[tuple[str, str, str, float]]:
    """(text, candidate, path, label) made from formats: secrets are keys of public formats and random values that are
    assigned to a secret's name; the others are card and order numbers, digests and ids named as such, placeholders,
    paths, versions, long words and identifiers. Texts beside them are random letters. The same for every corpus."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    upper, lower, digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    both, base, hexa = upper + lower, upper + lower + digit, "0123456789abcdef"
    filler = lambda k: " ".join(pick(lower, r.randint(2, 9)) for _ in range(k))
    word = lambda: r.choice(PLACEHOLDERS + ["model", "server", "build", "report", "image", "north", "result", "table"])
    name = lambda: r.choice(["password", "passwd", "secret", "token", "api_key", "auth_token", "client_secret"])
    sign = lambda: r.choice(["=", ": ", " = ", '="', ' = "'])
    spoken = lambda k: "".join(r.choice("bcdfghklmnprstvwz") + r.choice("aeiou") + r.choice(["", "n", "r", "s", "t"]) for _ in range(k))
    secret = [
        lambda: (name() + sign(), spoken(r.randint(2, 3)) + pick(digit, r.randint(1, 4)) + spoken(r.randint(0, 2))),
        lambda: ("", r.choice(("AKIA", "ASIA")) + pick(upper + "234567", 16)), lambda: ("", f"gh{r.choice('pousr')}_" + pick(base, 36)), lambda: ("", "sk-" + pick(base, r.randint(20, 48))), lambda: ("", f"xox{r.choice('abprs')}-" + pick(digit, 11) + "-" + pick(base, 12)),
        lambda: (name() + sign(), pick(hexa, r.choice((16, 18, 24, 32, 40)))), lambda: (name() + sign(), pick(base, r.randint(8, 40))), lambda: (name() + sign(), pick(base + "!@#$%^&*", r.randint(8, 20))), lambda: (name() + sign(), pick(both, 5) + pick(digit, 3) + pick(both, 4)),
    ]
    plain = [
        lambda: (r.choice(["", "card ", "order ", "isbn ", "phone "]), r.choice("3456") + pick(digit, 15)), lambda: (r.choice(["commit ", "sha1 ", "sha256:", "md5 ", "digest: ", "etag "]), pick(hexa, r.choice((32, 40, 64)))), lambda: ("", "/".join([word(), word(), word() + pick(digit, 2), word()])),
        lambda: (r.choice(["uuid ", "id: ", ""]), "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))), lambda: (name() + sign(), r.choice(("your_", "my", "example_", "test_")) + word() + pick(digit, 2)), lambda: (name() + sign(), word() + "_" + word()), lambda: (name() + sign(), word()[:6].ljust(6, "x")),
        lambda: ("version ", ".".join([pick(digit, 2)] * 2) + "-" + word() + pick(digit, 8)), lambda: ("", "_".join([word(), word(), word()]) + pick(digit, 2)), lambda: (r.choice(["", "https://host/"]), word() + "-" + word() + "-" + word() + "-" + pick(digit, 4)), lambda: ("", pick(digit, r.randint(16, 24))), lambda: (name() + sign(), "x" * r.randint(6, 16)),
    ]
    out = []
    for k in range(n):
        label = float(k % 2)
        lead, value = r.choice(secret if label else plain)()
        path = r.choice(["web", "forum", "book", "news"])
        close = '"' if lead.endswith('"') else ""
        out.append((f"{filler(r.randint(1, 8))} {lead}{value}{close} {filler(r.randint(1, 6))}", value, path, label))
    return out


def _about(rows: DataFrame, corpus: Corpus | None, path: str = "source") -> DataFrame:
    """scan()'s rows of rows (doc_id, text, value, label, weight, and the path) that are what a row is about."""
    of = rows.select(F.col("doc_id").cast("long").alias("_doc"), "value", F.col("label").cast("double").alias("label"), "weight")
    found = scan(rows, path, corpus)
    return found.join(of, (F.col("doc_id") == F.col("_doc")) & F.col("value").contains(F.col("candidate"))).drop("_doc", "value")


def example_findings(spark: SparkSession, corpus: Corpus | None = None, n: int = 4000, seed: int = 11) -> DataFrame:
    """Findings of examples(), with label and weight."""
    rows = [(i, *x, 1.0) for i, x in enumerate(examples(n, seed))]
    return _about(spark.createDataFrame(rows, "doc_id long, text string, value string, source string, label double, weight double"), corpus)


def written() -> list[tuple[str, float, str, str, str]]:
    """(family, label, path, text, value) of findings.tsv."""
    out = []
    for line in (pathlib.Path(__file__).parent / "findings.tsv").read_text(encoding="utf-8").splitlines():
        if line and not line.startswith("#"):
            family, label, path, marked = line.split("\t")
            marked = marked.replace("\\n", "\n")
            out.append((family, float(label), path, marked.replace("⟦", "").replace("⟧", ""), marked[marked.index("⟦") + 1 : marked.index("⟧")]))
    return out


def written_findings(spark: SparkSession, corpus: Corpus | None = None, without: frozenset[str] = frozenset(), only: frozenset[str] | None = None) -> DataFrame:
    """Findings of written(), with label and weight: those of families that are not left out, or of the named ones only."""
    rows = [(i, t, v, p, label, WEIGHT) for i, (f, label, p, t, v) in enumerate(written()) if f not in without and (only is None or f in only)]
    return _about(spark.createDataFrame(rows, "doc_id long, text string, value string, source string, label double, weight double"), corpus)


def train(labelled: DataFrame, most: int = MOST, seed: int = 7) -> RandomForestClassificationModel | None:
    """A forest fitted on labelled findings (features, candidate, weight, label 0 or 1; null labels don't count): at most
    `most` distinct candidates of each class, those of smallest hash. None if a class has no finding."""
    rows = labelled.filter("label is not null").groupBy("label", "candidate").agg(F.min("features").alias("features"), F.max("weight").alias("weight"))
    parts = [rows.filter(F.col("label") == v).orderBy(F.desc("weight"), F.xxhash64("candidate"), "candidate").limit(most) for v in (0.0, 1.0)]
    chosen = sorted((r["label"], r["candidate"], r["features"], r["weight"]) for r in parts[0].union(parts[1]).collect())  # at most 2 * most short rows
    if len({c[0] for c in chosen}) < 2:
        return None
    data = labelled.sparkSession.createDataFrame([(c[0], c[2], c[3]) for c in chosen], "label double, features array<double>, weight double").coalesce(1)
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="weight", numTrees=60, maxDepth=9, seed=seed)
    return forest.fit(data.select(array_to_vector("features").alias("x"), "label", "weight"))


def judge(findings: DataFrame, model: RandomForestClassificationModel, floor: float = 0.5) -> DataFrame:
    """findings with score (the forest's probability of a secret) and is_secret (score >= floor)."""
    scored = model.transform(findings.withColumn("x", array_to_vector("features")))
    scored = scored.withColumn("score", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")
    return scored.withColumn("is_secret", F.col("score") >= floor)


def find_secrets(docs: DataFrame, labelled: DataFrame | None = None, path: str = "source", floor: float = 0.5) -> DataFrame:
    """Every candidate of docs with its score: learn() from docs, scan(), train() on written_findings(), examples() and
    `labelled` (doc_id, text, value, label, and the path column: texts with the finding they are about), judge(). Texts
    are read whole, twice; no finding is stored.

    Null or empty text: no finding. Null doc_id: kept. Rows that repeat: findings repeat. Equal candidates (ties) get
    scores by their own surroundings. Empty table: no findings. Columns of docs other than the three read are left out,
    whatever their names.
    """
    spark, corpus = docs.sparkSession, learn(docs)
    known = example_findings(spark, corpus).unionByName(written_findings(spark, corpus))
    if labelled is not None:
        known = known.unionByName(_about(labelled.withColumn("weight", F.lit(WEIGHT)), corpus, path))
    return judge(scan(docs, path, corpus), train(known), floor)


def digest(candidate: Column) -> Column:
    """A candidate's SHA-256, so that results don't spread secrets."""
    return F.sha2(candidate, 256)
