import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer, models, pre_tokenizers

from ledgerloom.llm import byte_bpe, unigram_count

from .fixtures import docs, odd_texts

ALPHABETS = ["ab", "abcdefghijklmnopqrstuvwxyz", "ethanois ", "éäñß▁ ", "01 ", "-=_*#", "日本語 中文𐍈☃", "aé日😀 ", "\n \t a", "\x1c a\x85\xa0  ", "'s 'll a", "<unk> <0x0A>\n"]


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(rng.choice(ALPHABETS)) if k % 5 else rng.choice(al) for k in range(rng.choice([0, 1, 3, 10, 60, 200]))) for al in (rng.choice(ALPHABETS) for _ in range(n))]


@pytest.fixture(scope="module")
def bpe():
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(bpe):
    own, theirs = bpe
    for s in words(3000, 1) + [t for t in odd_texts() if t]:
        ids = own.encode(s)
        assert ids == theirs.encode_ordinary(s) and own.decode(ids) == s.encode()


def test_bpe_pieces_of_the_vocabulary(bpe):
    own, theirs = bpe
    rng, tokens = random.Random(2), list(own.ranks)
    for _ in range(4000):
        data = b"".join(rng.choice(tokens) for _ in range(rng.choice([1, 2, 3, 5])))
        assert own.encode_match(data) == theirs._encode_single_piece(data)


def test_bpe_another_vocabulary_and_pattern():
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    pattern = r"\w+|\W"
    own, theirs = byte_bpe.ByteBpe(ranks, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    assert not own.cuttable and all(own.encode(s) == theirs.encode_ordinary(s) for s in words(500, 3))


def test_bpe_query(spark, bpe):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = odd_texts()
    got = byte_bpe.round_trip(docs(spark), path, public_tokenizers.PATTERN).collect()
    assert len(got) == len(texts) + 4
    for r in got:
        if r["doc_id"] is not None:
            t = texts[r["doc_id"]] or "" if r["doc_id"] >= 0 else ""
            ids = bpe[1].encode_ordinary(t)
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    both = byte_bpe.decode(byte_bpe.encode(docs(spark), path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert both.filter("decoded != cast(coalesce(text, '') as binary)").isEmpty()
    checked = byte_bpe.encode_checked(docs(spark), path, public_tokenizers.PATTERN)
    assert checked.filter("not lossless").isEmpty() and checked.count() == len(texts) + 4 and checked.filter("n_tokens * 4 != octet_length(ids)").isEmpty()
    named = docs(spark).selectExpr("*", "'own' AS ids", "'own' AS __c", "'own' AS __row", "7 AS n_tokens")
    clashing = byte_bpe.encode_checked(named, path, public_tokenizers.PATTERN)
    assert len(clashing.columns) == len(set(clashing.columns)) and clashing.filter("__c != 'own' or __row != 'own' or not lossless or n_tokens * 4 != octet_length(ids)").isEmpty()
    assert byte_bpe.round_trip(docs(spark).limit(0), path, public_tokenizers.PATTERN).isEmpty()


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_unigram_counts_equal_the_library(byte_fallback):
    pieces = unigram_count.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    theirs = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=byte_fallback))
    theirs.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    own = unigram_count.UnigramCounter(pieces, byte_fallback=byte_fallback)
    for s in words(3000, 4) + [t for t in odd_texts() if t]:
        assert own.count(s)[0] == len(theirs.encode(s, add_special_tokens=False).ids), repr(s)


def test_unigram_ties_and_fused_unknowns():
    own = unigram_count.UnigramCounter([("<unk>", 0.0), ("▁", -1.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("▁a", -3.0)], byte_fallback=False)
    assert own.count("ab")[0] == 2 and own.count("xyz a") == (4 - 1, 2, 1, own.count("xyz a")[3])


def test_unigram_query(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    own = unigram_count.UnigramCounter(unigram_count.read_pieces(path))
    got = unigram_count.count_tokens(docs(spark), path).collect()
    texts = odd_texts()
    assert len(got) == len(texts) + 4
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] >= 0:
            assert (r["n_tokens"], r["n_words"], r["n_unknown"], r["score"]) == own.count(texts[r["doc_id"]] or "")
    assert unigram_count.count_tokens(docs(spark).limit(0), path).isEmpty()
