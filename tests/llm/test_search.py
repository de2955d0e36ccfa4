import math
import random
import re
from collections import Counter

import pytest

from ledgerloom.llm import lexical_search, queries

from .fixtures import docs, odd_texts, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(rows, items, k):
    """Every document scored for every item."""
    counts = [(i, Counter(terms(t))) for i, t in rows]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    whole, length, df = len(counts), sum(n for _, _, n in counts), Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in counts:
            m = 100 - 25 + (25 * n * whole) // length
            score = sum(math.floor(1000 * math.log((2 * whole + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank + 1, None if no_id else i, -score) for rank, (score, no_id, i) in enumerate(sorted(scored)[:k])]
    return out


def texts():
    rng = random.Random(3)
    vocabulary = [f"w{int(2000 * rng.random() ** 3)}" for _ in range(3000)] + ["Zürich", "ÉA", "x_y", "a-b"]
    return odd_texts() + [prose(rng, rng.choice([1, 5, 50, 300]), vocabulary) for _ in range(400)]


@pytest.mark.parametrize("k, shard, depth, block", [(20, 1 << 15, 32, 4096), (3, 7, 1, 3), (1, 50, 4, 5)])
def test_equals_scoring_all(spark, k, shard, depth, block):
    d = docs(spark, texts())
    d = d.unionByName(d.filter("doc_id between 30 and 40").selectExpr("doc_id + 1000 AS doc_id", *d.columns[1:]))  # ties
    rng = random.Random(5)
    held = [r["text"] for r in d.filter("length(text) > 20").collect()]
    items = [(i, " ".join(rng.choice(held).split()[:40])) for i in range(12)] + [(12, None), (13, ""), (14, "unheard of-terms"), (15, "the the THE light"), (15, "dog dog moon"), (None, "river stone")]
    found = lexical_search.search(d, spark.createDataFrame(items, "item_id long, text string"), k=k, shard=shard, depth=depth, block=block)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(brute([(r["doc_id"], r["text"]) for r in d.collect()], items, k), key=key)


def test_stops_before_the_lists_end():
    """A document that holds a rare query whole ends the search long before the frequent term's list does."""
    import numpy as np

    n = 10_000
    bounds = np.concatenate(([0, 2], np.arange(3, n + 2)))
    all_terms = np.concatenate(([0, 1], np.zeros(n - 1, np.int64)))
    shard = lexical_search.Shard(np.arange(n), np.zeros(n, bool), bounds, all_terms, np.concatenate(([50, 900], np.full(n - 1, 40))))
    best = lexical_search.Best(1)
    assert lexical_search.threshold_search(shard, {0: 1, 1: 1}, np.array([1, 1]), best, 4) < 20 and best.ids.tolist() == [0] and best.score.tolist() == [950]
    ties = lexical_search.Best(3)  # equal scores: the threshold isn't strictly below, so all are looked up
    assert lexical_search.threshold_search(shard, {0: 1}, np.array([1, 0]), ties, 4) == n and ties.ids.tolist() == [0, 1, 2]


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert lexical_search.search(docs(spark).limit(0), items).isEmpty() and lexical_search.search(docs(spark), items.limit(0)).isEmpty()
    assert lexical_search.search(docs(spark, ["", None, "..."]), items).isEmpty()
    assert lexical_search.search(docs(spark).limit(0), items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_query(spark, tmp_path):
    d = docs(spark, texts())
    d.write.parquet(str(tmp_path / "documents.parquet"))
    items = [(i, t) for i, t in enumerate(texts()[30:40])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, queries.op12_lexical_search(spark, str(tmp_path)).collect()), key=key) == sorted(brute([(r["doc_id"], r["text"]) for r in d.collect()], items, 20), key=key)
