"""Byte-level BPE encoding and decoding in linear time.

The text is cut by the vocabulary's pattern and each match is encoded alone.  A token sequence is what
greedy merging would give if and only if every adjacent pair is compatible: merging the two tokens' bytes
would not cross their border.  So a match is encoded left to right by its longest vocabulary entries
(looked up in the automaton's trie over the bytes mapped to Latin-1, no further than the longest entry),
taking the next shorter entry, or stepping back, when a pair is not compatible; positions found to be dead
ends are never entered again.  Compatibility of pairs is memoised.

A rank file is read on the driver and broadcast (its size is checked against ``MAX_VOCABULARY_BYTES``);
each Python worker builds its tables once.

Defined results: a null or empty text has no tokens, digests of nothing; text is taken whole, special
tokens are ordinary text; equal texts have equal ids, repeated rows each have theirs; there are no ties, as
greedy merging takes the leftmost of equal merges; bytes that aren't UTF-8 become U+FFFD; an empty table gives
no rows; columns that are appended replace input columns of the same name.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, as_bytes, text_bytes

MAX_VOCABULARY_BYTES = 64 << 20
_PAIRS = 1 << 17
# Fixed value: the pattern for which cutting at single blanks is known not to change matches; texts are matched whole under any other.
CUTTABLE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A blank that no other blank precedes: the pattern always begins a match there, so texts may be cut before it.
_CUT = re.compile(r"(?<!\s) ")
_DOUBLE = re.compile(r"\s ")


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.matches = regex.compile(pattern).findall
        self.cuttable = pattern == CUTTABLE
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.rank_of = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.most = max(map(len, ranks))
        self.compatible: dict[int, bool] = {}
        self.match_ids = Memo(self._packed_match, 1 << 16)
        self.chunk_ids = Memo(self._packed_chunk)
        self._parts()
        self.by_rank = [self.token.get(r) for r in range(max(self.token) + 1)]
        self.size = [len(t or b"") for t in self.by_rank]

    def _parts(self) -> None:
        """For each token the pair it is merged from, and its longest proper prefix in the vocabulary."""
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.shorter = [-1] * (max(self.token) + 1)
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            prefixes = [self.ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in self.ranks]
            if prefixes:
                self.shorter[rank] = prefixes[0]
            for a in prefixes:
                b = self.ranks.get(token[len(self.token[a]) :])
                if b is not None and a < rank and b < rank and self._fits(a, b):
                    self.left[rank], self.right[rank], self.merged[a, b] = a, b, rank
                    break

    def _fits(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a`` then ``b`` leaves the border between them.

        Both tokens are taken apart from the latest merge back; at each stage the tokens that touch the
        border would have been merged, had that merge come before the ones undone so far.
        """
        limit = 1 << 62
        while True:
            if self.merged.get((a, b), limit) < limit:
                return False
            inner_a, inner_b = self.right.get(a), self.left.get(b)
            if inner_a is None and inner_b is None:
                return True
            # a merge on the left side comes before an equal one on the right side
            if inner_b is None or (inner_a is not None and a > b):
                a, limit = inner_a, a
            else:
                b, limit = inner_b, b + 1

    def fits(self, a: int, b: int) -> bool:
        known = self.compatible.get(a << 32 | b)
        if known is None:
            if len(self.compatible) >= _PAIRS:
                self.compatible.clear()
            known = self.compatible[a << 32 | b] = self._fits(a, b)
        return known

    def encode_match(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n, text = len(data), data.decode("latin-1")
        rank, span, size, shorter, known = self.rank_of, self.automaton.longest_prefix, self.size, self.shorter, self.compatible
        dead: set[int] = set()
        out: list[int] = []
        at, last, candidate = 0, -1, -2
        while at < n:
            if candidate == -2:  # the longest entry that begins here
                ahead = text[at : at + self.most]
                k = span(ahead)
                candidate = rank.get(ahead[:k], -1)
                while candidate < 0 < k:
                    k -= 1
                    candidate = rank.get(ahead[:k], -1)
            while candidate >= 0:
                end = at + size[candidate]
                if end not in dead:
                    if last < 0:
                        break
                    fits = known.get(last << 32 | candidate)
                    if fits or (fits is None and self.fits(last, candidate)):
                        break
                candidate = shorter[candidate]
            if candidate >= 0:
                out.append(candidate)
                at, last, candidate = end, candidate, -2
            elif out:
                dead.add(at)
                out.pop()
                at -= size[last]
                candidate, last = shorter[last], out[-1] if out else -1
            else:
                raise ValueError("the vocabulary has no token for some byte")
        return out

    def _packed_match(self, match: str) -> bytes:
        ids = self.encode_match(match.encode("utf-8", "replace"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def _packed_chunk(self, chunk: str) -> bytes:
        of = self.match_ids.of
        return b"".join([of(m) for m in self.matches(chunk)])

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers.

        The text is cut before single blanks, where a match always begins and none looks ahead across; so the
        ids of a piece don't depend on its neighbours, and pieces seen before aren't matched again.
        """
        first, *rest = _CUT.split(text) if self.cuttable and _DOUBLE.search(text) else text.split(" ") if self.cuttable else [text]
        young, of = self.chunk_ids.young.get, self.chunk_ids.of
        return b"".join([of(first), *[young(c) or of(c) for c in map(" ".__add__, rest)]])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids; an id outside the vocabulary raises IndexError."""
        return b"".join(map(self.by_rank.__getitem__, ids))


_built: dict[str, ByteBpe] = {}


def _tokenizer(key: str, ranks: dict[bytes, int], pattern: str) -> ByteBpe:
    if key not in _built:
        _built.clear()
        _built[key] = ByteBpe(ranks, pattern)
    return _built[key]


def _shared(spark, path: str, pattern: str):
    ranks = read_ranks(path)
    key = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    return spark.sparkContext.broadcast((key, ranks, pattern))


def _slices(batches: Iterator[pa.Array], rows: int = 256) -> Iterator[pa.Array]:
    """Parts of the batches, so that results of a whole batch are never held at once."""
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.slice(i, rows)


def encode(df: DataFrame, path: str, pattern: str, text_column: str = "text", into: str = "ids") -> DataFrame:
    """Append the ids of each whole text as packed little-endian 32-bit integers."""
    shared = _shared(df.sparkSession, path, pattern)

    @F.arrow_udf("binary")
    def ids(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = _tokenizer(*shared.value)
        for part in _slices(texts):
            yield pa.array([bpe.encode_packed(as_bytes(x.as_py()).decode("utf-8", "replace")) for x in part], pa.binary())

    return df.withColumn(into, ids.asNondeterministic()(text_bytes(text_column)))


def encode_checked(df: DataFrame, path: str, pattern: str, text_column: str = "text") -> DataFrame:
    """Append ``n_tokens``, ``ids`` (packed) and ``lossless``: whether decoding gives the text's bytes back.

    One worker per task does both, a few texts at a time, so neither vocabulary tables nor batches are held twice.
    """
    shared = _shared(df.sparkSession, path, pattern)
    kind = pa.struct([("n_tokens", pa.int64()), ("ids", pa.binary()), ("lossless", pa.bool_())])

    @F.arrow_udf("struct<n_tokens:bigint,ids:binary,lossless:boolean>")
    def checked(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = _tokenizer(*shared.value)
        for part in _slices(texts):
            rows = []
            for x in part:
                data = as_bytes(x.as_py())
                ids = bpe.encode_packed(data.decode("utf-8", "replace"))
                rows.append({"n_tokens": len(ids) // 4, "ids": ids, "lossless": bpe.decode(np.frombuffer(ids, "<u4").tolist()) == data})
            yield pa.array(rows, kind)

    made = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), checked.asNondeterministic()(text_bytes(text_column)).alias("__c"))
    return made.select(*[F.col("__row").getField(c).alias(c) for c in df.columns if c not in kind.names], "__c.*")


def decode(df: DataFrame, path: str, pattern: str, ids_column: str = "ids", into: str = "decoded") -> DataFrame:
    """Append the bytes that packed ids stand for."""
    shared = _shared(df.sparkSession, path, pattern)

    @F.arrow_udf("binary")
    def data(packed: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = _tokenizer(*shared.value)
        for part in _slices(packed):
            yield pa.array([bpe.decode(np.frombuffer(as_bytes(x.as_py()), "<u4").tolist()) for x in part], pa.binary())

    return df.withColumn(into, data.asNondeterministic()(F.col(ids_column)))


def round_trip(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: id, ``n_tokens`` and digests of the ids and of the bytes decoded from them.

    Ids and bytes are digested where they are made, a text at a time, so no batch of either is held.
    """
    shared = _shared(docs.sparkSession, path, pattern)

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def digests(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = _tokenizer(*shared.value)
        kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        for batch in texts:
            rows = []
            for x in batch:
                ids = bpe.encode_packed(as_bytes(x.as_py()).decode("utf-8", "replace"))
                back = bpe.decode(np.frombuffer(ids, "<u4").tolist())
                rows.append({"n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256(back).hexdigest()})
            yield pa.array(rows, kind)

    return docs.select(id_column, digests.asNondeterministic()(text_bytes(text_column)).alias("__d")).select(id_column, "__d.*")
