import os
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from ledgerloom.llm import preference, quality_rules, queries

from . import fixtures
from .fixtures import prose
from .test_copies_and_mix import brute_targets
from .test_shared_shingles import groups
from .test_text_models import brute_statistics

WORD = re.compile(r"[^\x20\x09-\x0D]+")

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_stages_one_after_another(spark, tmp_path):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    size = lambda t: len(WORD.findall(t or ""))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == first.columns, name
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        given, kept = {r["doc_id"]: r for r in before.collect()} if name != "byte_bpe" else {}, docs.collect()
        if name in ("quality_rules", "quality_classifier", "near_copies"):  # rows are untouched, each at most once
            assert all(r == given[r["doc_id"]] for r in kept) and len({r["doc_id"] for r in kept}) == len(kept)
            ids = {r["doc_id"] for r in kept}
        if name == "quality_rules":
            stats = {i: brute_statistics(r["text"]) for i, r in given.items()}
            failed = {i for i, x in stats.items() if x[0] < 20 or 100 * x[4] > 30 * x[0]}
            judged = {r["doc_id"] for r in quality_rules.quality_rules(before, labels).filter("anomaly > 0").collect() if r["kept"]}
            assert failed and not failed & ids and ids == judged and len(ids) > 0.8 * (len(given) - len(failed))
        if name == "quality_classifier":
            ranked = {r["doc_id"]: r["score"] for r in preference.rank_quality(before, labels).collect()}
            assert ids == {i for i, s in ranked.items() if s >= 0.5} and len(ids) > 0.8 * len(given)
        if name == "near_copies":
            order = sorted(given)
            group = groups([given[i]["text"] for i in order])
            least = {}
            for i, g in zip(order, group, strict=True):
                least.setdefault(g, i)
            assert ids <= set(order) and set(least.values()) <= ids and len(ids) <= len(least) + 2  # all groups stay; a pair far in words may stay, too
        if name == "mix":
            sizes, longest, got = {}, {}, {}
            for r in given.values():
                sizes[r["source"]] = sizes.get(r["source"], 0) + size(r["text"])
                longest[r["source"]] = max(size(r["text"]), longest.get(r["source"], 0))
            for r in kept:
                assert r == given[r["doc_id"]]
                got[r["source"]] = got.get(r["source"], 0) + size(r["text"])
            want = brute_targets(sizes)
            assert all(abs(got.get(s, 0) - want[s]) <= longest[s] / 2 + 1 for s in sizes)
        if name == "byte_bpe":
            assert len(kept) == before.count() and all(r["lossless"] and len(r["ids"]) == 4 * r["n_tokens"] for r in kept)


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_odd_rows(spark, tmp_path, empty):
    rng = random.Random(21)
    good = [prose(rng, rng.randrange(30, 90)) for _ in range(40)]
    d = fixtures.docs(spark, fixtures.odd_texts() + good + good[:5] + [t.upper() for t in good[5:8]])
    for c in ("__row", "__kept", "__raw", "__text", "__c", "__cut", "ids", "n_tokens", "node", "first", "root", "rank", "target", "end"):
        d = d.withColumn(c, F.lit(f"own {c}"))
    d = d.limit(0) if empty else d.unionByName(d.filter("doc_id in (30, 31)"))
    fixtures.labels(spark, [] if empty else [(i, int(i % 4 > 0), 0) for i in range(20, 60)] + [(None, 1, 0), (21, None, None)]).write.parquet(str(tmp_path / "labels.parquet"))
    d.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == d.columns
    assert all(r[c] == f"own {c}" for r in now.collect() for c in ("__row", "__kept", "__cut", "ids", "node", "rank"))
    assert bool(out) != empty and all(r["lossless"] for r in out)


def test_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL) or ["none"])
def test_queries_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if name == "none":
        pytest.skip("no query has SQL")
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    found = queries.QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(found.columns)
    canon = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    assert sorted(tuple(map(canon, r)) for r in cursor.fetchall()) == sorted(tuple(canon(r[c]) for c in columns) for r in found.collect())
