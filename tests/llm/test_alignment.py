import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import alignment, common, queries

from .fixtures import docs, odd_texts
from .test_tokens import words

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def groups(text, both):
    """Groups by walking both token lists byte by byte, ids from the libraries; None for texts without tokens."""
    a_lib, b_lib = both
    if not text:
        return None
    byte = {chr(c): b for b, c in common.BYTE_LEVEL.items()} | {chr(b): b for b in range(256) if b not in common.BYTE_LEVEL}
    a = a_lib.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(byte[c] for c in t)) for i, t in zip(a.ids, a.tokens, strict=True)]
    right = []
    for i in b_lib.encode(text):
        p = b_lib.id_to_piece(i)
        right.append((i, bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if b"".join(x for _, x in left) != whole or b"".join(x for _, x in right) != whole:
        return None
    out, i, j, at_a, at_b, now = [], 0, 0, 0, 0, ([], [])
    while i < len(left) or j < len(right):
        if at_a <= at_b:
            now[0].append(left[i][0])
            at_a += len(left[i][1])
            i += 1
        else:
            now[1].append(right[j][0])
            at_b += len(right[j][1])
            j += 1
        if at_a == at_b:
            out.append(now)
            now = ([], [])
    return out


def brute(rows, both):
    found = [(i, groups(t, both)) for i, t in rows]
    held = Counter()
    for _, gs in found:
        held.update({(x, y) for a, b in gs or [] for x in a for y in b})
    most = {}
    for (x, _), n in held.items():
        most[x] = max(n, most.get(x, 0))
    out = []
    for i, gs in found:
        pairs = [(x, y) for a, b in gs or [] for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs or [])
        out.append((i, sum(len(a) for a, _ in gs or []), sum(len(b) for _, b in gs or []), len(gs or []), len(pairs), sum(held[p] == most[p[0]] for p in pairs), sum(held[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if gs else ""))
    return out


def texts():
    return odd_texts()[:10] + odd_texts()[12:] + words(150, 8) + ["▁ lower one", "<s> </s> <|endoftext|> <unk>", " leading", "trailing ", "á é", "=" * 700, "日本語の文章です。" * 30, "the same", "the same", "x" * 3000]


key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)


@pytest.mark.parametrize("broadcast, direct, short", [(1 << 20, 1024, 32), (0, 1, 0)])
def test_equals_walking_both_lists(spark, both, monkeypatch, broadcast, direct, short):
    monkeypatch.setattr(alignment, "_SHORT", short)
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", broadcast)
    monkeypatch.setattr(alignment, "_DIRECT", direct)
    d = docs(spark, texts())
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    got = alignment.align(d, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows, both), key=key)


def test_groups_and_links_are_columns(spark, both):
    d = spark.createDataFrame([(1, "Straßenbahn fährt"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in alignment.groups(d, A, B).collect()}
    assert [(list(g["a"]), list(g["b"])) for g in rows[1]["groups"]] == groups("Straßenbahn fährt", both) and rows[2]["groups"] == []
    links = {r["__id"]: r["small"] for r in alignment.linked(d, A, B).collect()}
    want = Counter((x, y) for a, b in groups("Straßenbahn fährt", both) for x in a for y in b)
    assert Counter((x >> 31, x & ((1 << 31) - 1)) for x in links[1]) == want and links[2] == []


def test_chunks_have_the_ids_of_the_libraries(both):
    own = alignment.BothTokenizers(alignment.read_byte_level(A), open(B, "rb").read(), most=40)
    for t in (words(2000, 9) + [t for t in odd_texts() if t] + ["it's I'LL, (well) -a- \"q\" a\u0301 ŉ ǅ İ", "a\n b", "a  b", " a", "a ", "ⅷ ² x²"]) * 2:
        want, block = groups(t, both), alignment.Block(own)
        block.put(0, 0, t)
        numbers = block.docs[0][2].tolist()
        assert (not numbers) == (want is None), repr(t)
        if want is not None:
            ids = [[i for n in numbers for i in np.frombuffer(block.ids[n][side], "<i4").tolist()] for side in (0, 1)]
            assert ids == [[x for a, _ in want for x in a], [x for _, b in want for x in b]], repr(t)


def test_one_long_group(spark):
    """A group of many tokens on both sides counts its distinct ids instead of writing out its pairs."""
    g = spark.range(1).select(F.array(F.struct(F.array_repeat(F.lit(7), 40_000).alias("a"), F.array_repeat(F.lit(9), 50_000).alias("b"))).alias("groups"))
    (row,) = g.select(alignment.large_links(F.col("groups")).alias("links")).collect()
    assert [(x["pair"], x["times"]) for x in row["links"]] == [((7 << 31) + 9, 2_000_000_000)]


def test_empty_table(spark):
    assert alignment.align(docs(spark).limit(0), A, B).isEmpty()


def test_query(spark, both, tmp_path):
    d = docs(spark, texts())
    d.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_token_alignment(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute([(r["doc_id"], r["text"]) for r in d.collect()], both), key=key)


def test_rows_hold_each_pair_once(spark, both, monkeypatch):
    """What tasks hand on follows a document's distinct pairs, not its words."""
    kept, own = {}, alignment.settle
    monkeypatch.setattr(alignment, "settle", lambda df, name: kept.setdefault(name, own(df, name)))
    d = docs(spark, ["the cat's unhappiest " * 4000 + "end", "the cat", ""])
    got = alignment.align(d, A, B)
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows, both), key=key)
    pairs = len({(x, y) for a, b in groups(rows[0][1], both) for x in a for y in b})
    arrays = [c for c, kind in kept["align-links"].dtypes if kind.startswith("array")]
    longest = kept["align-links"].select(*[F.max(F.size(c)).alias(c) for c in arrays]).first().asDict()
    assert max(longest.values()) == pairs, longest


def test_words_at_once_have_the_ids_that_each_has_alone(both):
    """Words of several documents that meet in a block: those that end or begin in white space change what stands beside them."""
    odd = ["a\n", "\nb", "\n", "\t", "c\u3000", "\u3000d", "\x85", "'s", "it's", "e\r\n", "12", "3,4", "\u0301", "\x1c", "f\x1c", "g"]
    own = alignment.BothTokenizers(alignment.read_byte_level(A), open(B, "rb").read(), most=5)
    block = alignment.Block(own)
    for first in odd:
        for second in odd:
            block.put(0, 0, first)
            block.put(0, 0, second)
    alone = {t: groups(t, both) for t in odd}
    for (_, _, numbers), t in zip(block.docs, [t for x in odd for y in odd for t in (x, y)], strict=True):
        got = [[i for n in numbers for i in np.frombuffer(block.ids[n][side], "<i4").tolist()] for side in (0, 1)]
        assert got == [[x for g in alone[t] or [] for x in g[side]] for side in (0, 1)], repr(t)
