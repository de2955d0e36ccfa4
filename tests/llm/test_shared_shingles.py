import itertools
import os
import random
import re
from collections import Counter, defaultdict

import pytest

from ledgerloom.llm import near_copies

from .fixtures import docs, odd_texts, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def groups(texts):
    """Group of each text by exact Jaccard >= 0.8, from all pairs."""
    sets, group = [shingles(t) for t in texts], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        common, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
        if group[i] != group[j] and (not either or common / either >= 0.8):
            group = [group[i] if g == group[j] else g for g in group]
    return group


def changed(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def copies():
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = odd_texts()
    for n in (1, 2, 3, 4, 5, 6, 8):  # about the bound: some copies above 0.8, some below, some by a chain only
        base = prose(rng, 200, vocabulary)
        texts += [base] + [changed(rng, base, n) for _ in range(6)]
    base = prose(rng, 300, vocabulary)
    texts += [changed(rng, base, 3) for _ in range(60)] + [base.upper(), base.replace(" ", "\n")]
    return texts


@pytest.mark.parametrize("small_bucket", [24, 4])
def test_stage_keeps_one_of_each_exact_group(spark, small_bucket):
    texts = copies()
    group = groups(texts)
    least = {}
    for i, g in enumerate(group):
        least.setdefault(g, i)
    rows = near_copies.keep_similar_once(docs(spark, texts), small_bucket=small_bucket).collect()
    # docs() adds two equal rows, a text without an id and a text without words; the latter is in the group of the empty texts
    empty = group[texts.index("")]
    want = {i for g, i in least.items() if g != empty} | {-3, None}
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == sorted(want - {None}) and sum(r["doc_id"] is None for r in rows) == 1
    assert near_copies.keep_similar_once(docs(spark).limit(0)).isEmpty()


@pytest.mark.parametrize("keep_one", [near_copies.keep_one, near_copies.keep_similar_once])
def test_null_and_repeated_ids_leave_one_row(spark, keep_one):
    rng = random.Random(13)
    a, b, c = (prose(rng, 200, [f"{x}{k}" for k in range(2000)]) for x in "abc")
    rows = [(None, a), (None, a.upper()), (4, a.replace(" ", "\n")), (None, b), (None, b.upper()), (7, c), (7, c.upper()), (7, c)]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"][0].lower()) for r in kept) == [(False, 4, "a"), (False, 7, "c"), (True, 0, "b")]


SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_recall_on_pairs_that_differ(spark):
    """Of all pairs of different texts at 0.8 or more, found by an exact prefix filter, the fingerprints of at least 0.9 are within the radius."""
    read = spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()
    texts = sorted({" ".join(near_copies.as_bytes((r["text"] or "").encode()).lower().decode().split()) for r in read})
    sets = [set(near_copies.shingle_set(t.encode()).tolist()) for t in texts]
    held = Counter(x for s in sets for x in s)
    by_shingle, candidates = defaultdict(list), set()
    for i in sorted(range(len(texts)), key=lambda i: len(sets[i])):
        rare = sorted(sets[i], key=lambda x: (held[x], x))
        for x in rare[: len(rare) - -(-4 * len(rare) // 5) + 1]:
            candidates.update((i, j) for j in by_shingle[x])
            by_shingle[x].append(i)
    pairs = [(i, j) for i, j in candidates if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0]
    prints = {i: near_copies.word_prints(texts[i].encode().split()) for p in pairs for i in p}
    found = sum(any(bin(a ^ b).count("1") <= 6 for a, b in zip(prints[i], prints[j], strict=True)) for i, j in pairs)
    assert len(pairs) > 30 and found >= 0.9 * len(pairs)


def test_texts_within_the_radius_that_share_too_little_are_no_rows(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words[:k] + words[k + 1 :][::-1] + [words[k]]) for k in range(0, 60, 5)] + [" ".join(rng.sample(words, 60)) for _ in range(8)]
    texts += [changed(rng, " ".join(words * 3), 1) for _ in range(4)]
    made = []
    whole = near_copies._pairs_in_small
    monkeypatch.setattr(near_copies, "_pairs_in_small", lambda *args: made.append(whole(*args).cache()) or made[-1])
    kept = near_copies.keep_similar_once(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert kept.count() == len(set(groups(texts)))  # the texts of the same words in other orders have equal fingerprints
    assert sum(p.count() for p in made) <= 10
