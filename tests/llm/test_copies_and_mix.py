import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import curriculum, near_copies, queries

from .fixtures import docs, odd_texts, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(t):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(values, radius=2):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(root), 2):
        if bin((a ^ b) & (2**64 - 1)).count("1") <= radius:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {v: find(v) for v in root}


def test_masks_cover_every_pair_of_bits():
    for radius in (1, 2):
        masks = near_copies.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for bits in itertools.combinations(range(64), radius):
            assert any(all(not (m >> b) & 1 for b in bits) for m in masks)


def signed(v):
    return v - 2**64 if v >> 63 else v


@pytest.mark.parametrize("small_bucket,radius", [(24, 2), (3, 2), (3, 1)])
def test_links_connect_what_brute_force_connects(spark, small_bucket, radius):
    rng = random.Random(5)
    values = set()
    for _ in range(12):  # clusters of near fingerprints, chains among them, and far ones
        at = rng.getrandbits(64)
        for _ in range(60):
            values.add(signed(at))
            at = at ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) if rng.random() < 0.8 else at ^ rng.getrandbits(64)
        centre = rng.getrandbits(64)
        values |= {signed(centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))) for _ in range(40)}
    found = near_copies.components(near_copies.links(spark.createDataFrame([(v,) for v in values], "fp long"), radius, small_bucket))
    got = {r["node"]: r["root"] for r in found.collect()}
    want = brute_roots(values, radius)
    assert {v: got.get(v, v) for v in values} == want


def test_masks_of_wide_radii():
    rng = random.Random(4)
    for radius in (3, 4, 5, 6):
        masks = [m % 2**64 for m in near_copies.covering_masks(radius)]
        assert len(masks) == 2 ** (radius + 1) - 1 and all(16 <= m.bit_count() for m in masks)
        for _ in range(5000):
            bits = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not m & bits for m in masks)
    assert sorted(m.bit_count() for m in masks) == [32] * 126 + [64]


@pytest.mark.parametrize("small_bucket,radius", [(24, 3), (2, 4)])
def test_leaders_connect_what_brute_force_connects(spark, small_bucket, radius):
    rng, values = random.Random(7), set()
    flip = lambda v, n: signed(v ^ sum(1 << b for b in rng.sample(range(64), n)))
    for _ in range(6):  # groups of one centre, chains, and groups some bits farther apart
        at = rng.getrandbits(64)
        values |= {flip(at, rng.randrange(radius)) for _ in range(60)}
        for _ in range(12):
            values.add(signed(at))
            at = flip(at, rng.choice([radius - 1, radius, radius + 1])) % 2**64
    found = near_copies._within(spark.createDataFrame([(v, v) for v in values], "node long, sim long"), radius, small_bucket)
    got = {r["node"]: r["root"] for r in found.collect()}
    assert {v: got.get(v, v) for v in values} == brute_roots(values, radius)


def test_component_of_a_long_path(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in near_copies.components(edges).collect()} == {0}
    assert near_copies.components(edges.limit(0)).isEmpty()


def test_query_equals_brute_force(spark):
    rng = random.Random(6)
    base = [prose(rng, 120) for _ in range(8)]
    texts = odd_texts() + base + [t.replace("fox", "FOX") for t in base] + [t + " tail" for t in base] + [" ".join(t.split()) for t in base]
    got = near_copies.near_copies(docs(spark, texts)).collect()
    assert len(got) == len(texts) + 4
    own = {r["doc_id"]: texts[r["doc_id"]] if (r["doc_id"] or 0) >= 0 and r["doc_id"] is not None else None for r in got}
    fps = {i: brute_fingerprint(t) for i, t in own.items() if i is not None}
    fps[None] = brute_fingerprint("no id")
    roots = brute_roots(set(fps.values()))
    least = {}
    for i, v in fps.items():
        if i is not None:
            least[roots[v]] = min(i, least.get(roots[v], i))
    for r in got:
        assert r["fp"] % 2**64 == fps[r["doc_id"]] and r["component_id"] == least.get(roots[fps[r["doc_id"]]])
    kept = near_copies.keep_one(docs(spark, texts)).collect()
    ids = [r["doc_id"] for r in kept if r["doc_id"] is not None]
    assert sorted(ids) == sorted(least.values()) and kept[0].asDict().keys() == set(docs(spark).columns)
    assert near_copies.near_copies(docs(spark).limit(0)).isEmpty() and near_copies.keep_one(docs(spark).limit(0)).isEmpty()


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        left, weight = total - sum(capped.values()), sum(w[s] for s in order if s not in capped)
        over = [s for s in order if s not in capped and left * w[s] / weight >= most * sizes[s]]
        if not over:
            return {s: float(capped[s]) if s in capped else left * w[s] / weight for s in order}
        capped |= {s: most * sizes[s] for s in over}


def mix_docs(spark):
    rng = random.Random(8)
    texts = [prose(rng, rng.choice([1, 5, 50, 400])) for _ in range(300)] + odd_texts()
    return texts, docs(spark, texts, sources=("b", "b", "b", "b", "b", "b", "a", None, "é", "B", "b", "z", "zz", "b"))


@pytest.mark.parametrize("bucket", [1 << 14, 16])
def test_mix_takes_its_targets(spark, monkeypatch, bucket):
    monkeypatch.setattr(curriculum, "_OF_BUCKET", bucket)
    texts, d = mix_docs(spark)
    rows = curriculum.mix(d).collect()
    assert len(rows) == d.count()
    source = {}
    for r in d.collect():
        source.setdefault(r["doc_id"], []).append((r["source"], len(WORD.findall(r["text"] or ""))))
    sizes = {}
    for each in source.values():
        for s, n in each:
            sizes[s] = sizes.get(s, 0) + n
    want, taken = brute_targets(sizes), {}
    assert any(want[s] == 3 * sizes[s] for s in sizes) and any(want[s] < 3 * sizes[s] for s in sizes)
    for r in rows:
        s, n = source[r["doc_id"]][0]
        assert r["size"] == n and r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 3 * n
        assert len(r["positions"]) == (-(-r["taken"] // n) if n else 0) and all(0 <= x <= 1 for x in r["positions"]) and sorted(r["positions"]) == r["positions"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)
    assert sorted(map(str, rows)) == sorted(map(str, curriculum.mix(d.repartition(7)).collect()))


def test_positions_follow_the_schedule(spark):
    for shape in curriculum.SHAPES + ((0.0, 2.0, 1.0), (1.0, 0.0, 1.0)):
        spans = curriculum._spans(F.lit(0), curriculum.KNOTS, [shape])
        got = spark.range(201).select((F.col("id") / 200).alias("u"), curriculum.when_reached(spans, F.col("id") / 200).alias("t")).collect()
        at = np.linspace(0, 1, 20001)
        weight = np.interp(at, curriculum.KNOTS, shape)
        demand = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
        demand /= demand[-1]
        for r in got:
            assert np.interp(r["t"], at, demand) == pytest.approx(r["u"], abs=2e-4)


def test_training_order(spark):
    _, d = mix_docs(spark)
    out = curriculum.training_order(d)
    assert out.columns == d.columns
    words = sum(len(WORD.findall(r["text"])) for r in out.collect())
    assert words == sum(r["taken"] for r in curriculum.mix(d).collect())
    named = d.withColumn("__cut", F.lit("own")).withColumn("__row", F.lit(1)).withColumn("__copy", F.lit(2)).withColumn("rank", F.lit(3)).withColumn("__order", F.lit(4))
    for whole in (False, True):
        clashing = curriculum.training_order(named, whole_texts=whole)
        assert clashing.columns == named.columns and {(r["__cut"], r["__row"], r["__copy"], r["rank"], r["__order"]) for r in clashing.collect()} == {("own", 1, 2, 3, 4)}
    assert curriculum.mix(d.limit(0)).isEmpty() and curriculum.training_order(d.limit(0)).isEmpty()
    nothing = docs(spark, [None, "", " "])
    assert {(r["taken"], r["target"]) for r in curriculum.mix(nothing).collect()} == {(0, 0.0)} and curriculum.training_order(nothing).isEmpty()


def test_training_order_of_whole_texts(spark):
    _, d = mix_docs(spark)
    rows = d.collect()
    size = lambda t: len(WORD.findall(t or ""))
    sizes, longest, texts = {}, {}, {}
    for r in rows:
        s, n = r["source"], size(r["text"])
        sizes[s], longest[s] = sizes.get(s, 0) + n, max(n, longest.get(s, 0))
        texts[r["doc_id"]] = r["text"]
    want, got, copies = brute_targets(sizes), {}, {}
    for r in curriculum.training_order(d, whole_texts=True).collect():
        assert r["text"] == texts[r["doc_id"]]  # no text is cut or rewritten
        got[r["source"]] = got.get(r["source"], 0) + size(r["text"])
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert all(abs(got.get(s, 0) - want[s]) <= longest[s] / 2 + 1 for s in sizes)
    repeats = {i: sum(r["doc_id"] == i for r in rows) for i in copies}
    for m in curriculum.mix(d).collect():
        i, n, taken = m["doc_id"], m["size"], m["taken"]
        if n and repeats[i] == 1 if i in repeats else n:
            assert copies.get(i, 0) == taken // n + (taken % n > 0 and 2 * (taken % n) >= n)


def test_mix_query_is_in_training_order(spark, tmp_path):
    rng = random.Random(14)
    texts = [prose(rng, rng.choice([1, 5, 50, 400])) for _ in range(200)]
    d = docs(spark, texts, sources=("a", "b", "b", "c", "c", "c", "c")).filter("doc_id >= 0").dropDuplicates(["doc_id"])
    d.write.parquet(str(tmp_path / "documents.parquet"))
    rows = d.select("doc_id", "source", "text").collect()
    got = queries.op5_curriculum_mix(spark, str(tmp_path)).collect()
    sizes = {s: sum(len(WORD.findall(r["text"])) for r in rows if r["source"] == s) for s in "abc"}
    want, place, grid = brute_targets(sizes), {}, np.linspace(0, 1, 20001)
    for s, shape in zip("abc", curriculum.SHAPES, strict=True):
        weight = np.interp(grid, curriculum.KNOTS, shape)
        demand = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
        ahead = 0
        for r in sorted((r for r in rows if r["source"] == s), key=lambda r: hashlib.md5(f"{r['doc_id']}:{hashlib.md5((r['text'] or '').encode()).hexdigest()}".encode()).hexdigest()):
            place[r["doc_id"]] = np.interp(ahead / want[s], demand / demand[-1], grid)
            ahead += len(WORD.findall(r["text"]))
    taken = [r["taken"] > 0 for r in got]
    assert len(got) == len(rows) and taken == sorted(taken) and len({r["source_size"] for r in got if r["taken"]}) == 3
    assert all(r["first_position"] == pytest.approx(place[r["doc_id"]], abs=2e-4) and r["copies"] == -(-r["taken"] // r["size"]) for r in got if r["taken"])
    assert all(r["first_position"] is None and r["copies"] == 0 for r in got if not r["taken"])
    again = queries.op5_curriculum_mix(spark.newSession(), str(tmp_path)).collect()
    assert again == got  # reruns agree, in order too
    plan = spark._jvm.PythonSQLUtils.explainString(queries.op5_curriculum_mix(spark, str(tmp_path))._jdf.queryExecution(), "extended")
    assert "sqrt" in plan.lower() and "rangepartitioning" in plan
    at = [place[r["doc_id"]] for r in got if r["taken"]]
    assert all(b >= a - 2e-4 for a, b in zip(at, at[1:], strict=False))
