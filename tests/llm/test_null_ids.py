"""Many rows without an id: each is a document of its own, and costs what one with an id costs."""

import hashlib
import time

import numpy as np
import pytest

from kinetrail.llm.lines import dedup_lines
from kinetrail.llm.minhash import near_duplicates
from kinetrail.llm.ngram_join import ngram_groups
from kinetrail.llm.substrings import dedup_substrings

RUNS = {"lines": lambda d: dedup_lines(d, least=1), "substrings": dedup_substrings, "groups": ngram_groups, "minhash": near_duplicates}


def texts(n):
    """Documents of ten lines, some of them shared."""
    rng = np.random.default_rng(4)
    line = lambda k: " ".join(f"w{x}" for x in np.random.default_rng(k).integers(0, 5000, 24))
    return ["\n".join(line(int(k)) for k in np.concatenate([rng.integers(0, 400, 3), 10**6 + 10 * i + np.arange(7)])) for i in range(n)]


@pytest.mark.parametrize("name", sorted(RUNS))
def test_null_ids_cost_no_more(spark, name):
    rows, took, found = texts(2000), {}, {}
    for kind in ("warm", "ids", "null"):
        df = spark.createDataFrame([(None if kind == "null" else i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(4)
        began = time.time()
        found[kind] = RUNS[name](df).collect()
        took[kind] = time.time() - began
    assert len(found["null"]) == len(rows) and took["null"] < 2 * took["ids"] + 5
    if name == "lines":  # which of two equal lines stays depends on the order of ids; how many go doesn't
        gone = [sum(len(r["_removed"]) for r in found[kind]) for kind in ("null", "ids")]
        assert gone[0] == gone[1] > 1000
    if name == "substrings":  # here the order shifts a span's ends where words before it happen to agree
        gone = [sum(r["n_removed"] for r in found[kind]) for kind in ("null", "ids")]
        assert abs(gone[0] - gone[1]) <= 24 < gone[1]


def test_lines_of_null_ids_in_order(spark):
    """Rows that share an id (or have none) come in the order of a hash of the text."""
    rows = [(None, f"own {i} line\nshared line of all") for i in range(50)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), least=1).collect()
    assert sum("shared line of all" in r["text"] for r in got) == 1 and len({hashlib.md5(r["text"].encode()).hexdigest() for r in got}) == 50
