import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import packing, queries

from .fixtures import docs, odd_texts, prose
from .test_tokens import words

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_words_have_the_ids_of_the_library(library):
    own = packing.WordIds(packing.read_vocabulary(PATH), most=50)  # so small that words are forgotten and found again
    texts = words(3000, 5) + [t for t in odd_texts() if t] + ["a<|endoftext|>b <|startoftext|> <|endof text|>", "é é x ́y ΑΣ ΑΣ. İI", "it's 'S 'LL don't", "１２ ² ½ 12"]
    for s in texts * 2:
        assert np.frombuffer(own.packed(s.encode("utf-8", "replace")), "<u4").tolist() == library.encode(s, add_special_tokens=False).ids, repr(s)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        packing.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def piece(i, n):
    return i, 0, bytes(4 * n), n


@pytest.mark.parametrize("most, slack", [(1, 0), (3, 0), (4, 10), (16, 5)])
def test_windows_are_bounded_and_lose_nothing(most, slack):
    rng = random.Random(most)
    lengths = [rng.choice([1, 2, 30, 60, 99, 100, 101, 250]) for _ in range(3000)]
    space, done = packing.OpenWindows(100, most, slack, 0), []
    for i, n in enumerate(lengths):
        done += space.put(piece(i, n))
        assert len(space.windows) == len(space.by_fill) <= most and all(0 < w.fill < 100 for w in space.windows.values())
    assert all(100 - slack <= w.fill <= 100 for w in done)
    merged = packing.merge_windows(space.rest(), 100, slack, 10**6)
    assert all(100 - slack <= w.fill <= 100 or w.fill & (w.fill - 1) == 0 for w in merged)
    spans = defaultdict(list)
    for w in done + merged:
        offset = 0
        for doc, start, length, ids, of, number, at in w.rows():
            assert at == offset and number == w.number and len(ids) == 4 * length > 0 and of == lengths[doc]
            spans[doc].append((start, length))
            offset += length
    assert len({w.number for w in done + merged}) == len(done + merged)
    for doc, n in enumerate(lengths):
        at = 0
        for start, length in sorted(spans[doc]):
            assert start == at
            at += length
        assert at == n


def test_best_fit_and_fullest_first():
    space = packing.OpenWindows(100, 2, 0, 0)
    assert not list(space.put(piece("a", 60))) and not list(space.put(piece("b", 50)))
    assert not list(space.put(piece("c", 35)))  # fits in both, the fuller one takes it
    assert {w.number: [p[0] for p in w.pieces] for w in space.rest()} == {0: ["a", "c"], 1: ["b"]}
    (closed,) = space.put(piece("d", 70))  # fits in none: the fullest is filled up with its head
    assert [(p[0], p[1], len(p[2]) // 4) for p in closed.pieces] == [("a", 0, 60), ("c", 0, 35), ("d", 0, 5)]
    assert {w.number: [p[:2] for p in w.pieces] for w in space.rest()} == {1: [("b", 0)], 2: [("d", 5)]}


def check(rows, texts, library, capacity, slack):
    """Every id of every document in one piece; sequences gapless; little padding."""
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in texts.items():
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            own = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert r["start"] == at and r["doc_tokens"] == len(ids) and (zlib.crc32(own) == r["ids_crc32"] if "ids_crc32" in r else own == bytes(r["ids"]))
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding <= slack * len(sequences)


@pytest.mark.parametrize("capacity, most, fan_in", [(64, 2, 2), (4096, 16, 16)])
def test_pack(spark, library, capacity, most, fan_in):
    rng = random.Random(4)
    texts = odd_texts() + [prose(rng, rng.randrange(200)) for _ in range(200)]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), PATH, capacity=capacity, open_windows=most, slack=2, fan_in=fan_in).collect()
    check([r.asDict() for r in rows], dict(enumerate(texts)), library, capacity, 2)


def test_pack_odd_rows(spark, library):
    d = docs(spark)
    rows = packing.pack(d, PATH).groupBy("doc_id").sum("length").collect()
    assert {r[0] for r in rows} == {r[0] for r in d.select("doc_id").collect()}
    assert sum(r[1] for r in rows) == sum(len(library.encode(r[0] or "", add_special_tokens=False).ids) + 1 for r in d.select("text").collect())
    assert packing.pack(docs(spark).limit(0), PATH).isEmpty()


def test_query(spark, library, tmp_path):
    d = docs(spark, odd_texts()).filter("doc_id >= 0 and doc_id != 5")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op11_packing(spark, str(tmp_path)).collect()
    check([r.asDict() for r in rows], {r["doc_id"]: r["text"] for r in d.collect()}, library, 4096, 32)
