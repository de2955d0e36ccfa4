"""Aligning the tokens of two tokenizers by the byte offsets where tokens of both end.

A is a byte-level BPE of space + text, B a sentencepiece model of text, which adds the space itself.  A blank after
something that isn't white space ends a token of both, so groups never cross it; documents are cut there into words, and
a block of documents tokenises and aligns each of its words once.  Inside a block, which is a few documents of one task,
the work is on arrays of numbers, linear in the tokens but for sorts:

* A byte where tokens of both end is the end of a group; the ids between are the groups, all pairs inside are links.
* A document's groups are those of its words, one after the other; its pairs are those of its distinct words, each as
  often as the words are there, and are distinct inside its row.

What concerns the corpus is Spark's: a pair of ids counts in how many documents it is linked; counts are summed before
the exchange, and nothing holds a pair's documents.  The counts meet the documents by broadcast while
there are at most ``BROADCAST_PAIRS`` of them, and by a shuffled join beyond.  A group of more than ``_DIRECT`` links
counts its distinct ids instead of writing out its pairs.

Defined results: null and empty texts have no tokens, nor have texts that either tokenizer doesn't give back byte by
byte; then all numbers are 0 and there are no groups; texts are taken whole; special tokens are plain text;
repeated rows are documents of their own, null ids too; pairs of equal counts are all best; bytes that aren't UTF-8
become U+FFFD; an empty table gives no rows; of the input's columns only the id is returned.
"""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .byte_bpe import _DOUBLE, CUTTABLE, MAX_VOCABULARY_BYTES
from .common import as_bytes, settle, text_bytes

BROADCAST_PAIRS = 1 << 20
_DIRECT = 1024
_SHIFT_BITS = 31
#: Characters of the longest word that is remembered from block to block.
_SHORT = 48
#: Words that the byte-level BPE takes at once.
_AT_ONCE = 1024


def read_byte_level(path: str) -> str:
    """A byte-level BPE's JSON file, if it is cut by the pattern ``CUTTABLE`` alone."""
    with open(path, encoding="utf-8") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} characters")
    made = json.loads(data)
    cut = made.get("pre_tokenizer") or {}
    if made.get("normalizer") or cut.get("type") != "ByteLevel" or not cut.get("use_regex") or cut.get("add_prefix_space") or made["model"]["type"] != "BPE":
        raise ValueError(f"{path}: a byte-level BPE with its own pattern, without normaliser and added blank is needed")
    return data


def piece_bytes(piece: str) -> bytes:
    return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">") else piece.replace("▁", " ").encode("utf-8")


def _bounds(counts) -> np.ndarray:
    """Where runs of so many begin, and where the last one ends."""
    return np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))


def _packed(ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    whole, at = ids.astype("<i4").tobytes(), (bounds * 4).tolist()
    return [whole[x:y] for x, y in zip(at, at[1:], strict=False)]


class BothTokenizers:
    """Both tokenizers' ids of texts and of words, which are remembered in two generations."""

    def __init__(self, vocabulary: str, model: bytes, most: int = 1 << 17, longest: int = _SHORT):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(vocabulary)
        self.a.encode_special_tokens = True
        sizes = {i: len(token) for token, i in self.a.get_vocab().items()}  # a character a byte
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.b.id_to_piece(i) for i in range(len(self.b))]
        self.cuttable = not any("▁" in p.lstrip("▁") for p in pieces)
        self.a_size = np.array([sizes.get(i, 0) for i in range(max(sizes) + 1)], np.int64)
        self.b_bytes = list(map(piece_bytes, pieces))
        self.b_size = np.array(list(map(len, self.b_bytes)), np.int64)
        self.most, self.longest, self.young, self.old = most, longest, {}, {}
        #: Each id with what follows it in a group's text: the next id, the other side or the next group.
        self.spelt = [f"{i}{sign}" for i in range(max(len(self.a_size), len(self.b_size))) for sign in ",|;"]
        self.spelt_size = np.array(list(map(len, self.spelt)), np.int64)

    def _a(self, texts: list[str], sizes: np.ndarray) -> list[bytes | None]:
        """Packed ids of A of a blank and each text; texts of which none ends in white space have the same ids one after the other as alone."""
        ids = np.array(self.a.encode(f" {' '.join(texts)}", add_special_tokens=False).ids, np.int64)
        ends, wanted = np.cumsum(self.a_size[ids]), np.cumsum(sizes)
        at = np.searchsorted(ends, wanted)
        if len(ends) and at[-1] == len(ends) - 1 and np.array_equal(ends[at], wanted):
            return _packed(ids, np.concatenate(([0], at + 1)))
        return [None] if len(texts) == 1 else [x for t, n in zip(texts, sizes, strict=True) for x in self._a([t], np.array([n]))]

    def _b(self, texts: list[str], spaced: list[bytes]) -> list[bytes | None]:
        """Packed ids of B, None where they don't give the text back."""
        lists = self.b.encode(texts, num_threads=1)
        ids, bounds = np.array([i for x in lists for i in x], np.int64), _bounds(list(map(len, lists)))
        made, at = b"".join(map(self.b_bytes.__getitem__, ids.tolist())), _bounds(self.b_size[ids])[bounds].tolist()
        return [x if made[u:v] == t else None for x, t, u, v in zip(_packed(ids, bounds), spaced, at, at[1:], strict=False)]

    def _tokenised(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        if not texts:
            return []
        spaced = [f" {t}".encode() for t in texts]
        sizes = np.array(list(map(len, spaced)), np.int64)
        a = [x for k in range(0, len(texts), _AT_ONCE) for x in self._a(texts[k : k + _AT_ONCE], sizes[k : k + _AT_ONCE])]
        return [None if x is None or y is None else (x, y) for x, y in zip(a, self._b(texts, spaced), strict=True)]

    def ids(self, parts: list[str | tuple[str]]) -> list[tuple[bytes, bytes] | None]:
        """Packed ids of A and B of words that a blank stands before, and of whole texts, which are tuples of one; None where one doesn't give the text back."""
        found = list(map(self.young.get, parts, repeat(0)))
        late = [k for k, ids in enumerate(found) if ids == 0]
        words, alone = [], []
        for k in late:
            p = parts[k]
            found[k] = ids = self.old.get(p, 0)
            if ids == 0:
                (alone if isinstance(p, tuple) or p[-1:].isspace() else words).append(k)
        for k, ids in zip(words, self._tokenised([parts[k] for k in words]), strict=True):
            found[k] = ids
        for k in alone:
            found[k] = self._tokenised([parts[k][0] if isinstance(parts[k], tuple) else parts[k]])[0]
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young.update((parts[k], found[k]) for k in late if isinstance(parts[k], str) and len(parts[k]) <= self.longest)
        return found


class Groups:
    """The groups of a block's words: all ids ``a`` and ``b``, which of them each group has, and which groups each word has."""

    def __init__(self, both: BothTokenizers, ids: list[tuple[bytes, bytes] | None], direct: int):
        packed = [[b"" if x is None else x[side] for x in ids] for side in (0, 1)]
        self.a, self.b = (np.frombuffer(b"".join(x), "<i4").astype(np.int64) for x in packed)
        self.a_bounds, self.b_bounds = (_bounds(np.array(list(map(len, x)), np.int64) // 4) for x in packed)
        a_ends, b_ends = np.cumsum(both.a_size[self.a]), np.cumsum(both.b_size[self.b])  # a word has as many bytes on both sides
        a_last, b_last = (np.flatnonzero(self._marks(other)[own]) for own, other in ((a_ends, b_ends), (b_ends, a_ends)))
        self.a_start, self.b_start = (np.concatenate(([0], x + 1)) for x in (a_last, b_last))
        self.n_a, self.n_b = np.diff(self.a_start), np.diff(self.b_start)
        self.bounds = np.searchsorted(a_last, self.a_bounds - 1, side="right")
        self.links, self.both = self.n_a * self.n_b, both
        self.few = self.links <= direct

    @staticmethod
    def _marks(ends: np.ndarray) -> np.ndarray:
        marks = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, bool)
        marks[ends] = True
        return marks

    def per_word(self, of_group: np.ndarray) -> np.ndarray:
        return np.diff(_bounds(of_group)[self.bounds])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Each linked pair of the groups of at most ``direct`` links, as often as it is there, and where each word's begin."""
        n = np.where(self.few, self.links, 0)
        bounds, g = _bounds(n), np.repeat(np.arange(len(n)), n)
        k = np.arange(len(g)) - bounds[g]
        i = k // self.n_b[g]
        return self.a[self.a_start[g] + i] << _SHIFT_BITS | self.b[self.b_start[g] + k - i * self.n_b[g]], bounds[self.bounds]

    def texts(self) -> list[str]:
        """Each word's groups as ``a1,a2|b1;a3|b2,b3;``"""
        code = np.empty(len(self.a) + len(self.b), np.int64)
        a_code, b_code = self.a * 3, self.b * 3
        a_code[self.a_start[1:] - 1] += 1
        b_code[self.b_start[1:] - 1] += 2
        code[np.arange(len(self.a)) + np.repeat(self.b_start[:-1], self.n_a)] = a_code
        code[np.arange(len(self.b)) + np.repeat(self.a_start[1:], self.n_b)] = b_code
        whole, at = "".join(map(self.both.spelt.__getitem__, code.tolist())), _bounds(self.both.spelt_size[code])[self.a_bounds + self.b_bounds].tolist()
        return [whole[x:y] for x, y in zip(at, at[1:], strict=False)]

    def large(self) -> dict[int, list[dict[str, np.ndarray]]]:
        """By the word's number, its groups of more than ``direct`` links."""
        out: dict[int, list[dict[str, np.ndarray]]] = {}
        for g in np.flatnonzero(~self.few).tolist():
            group = {"a": self.a[self.a_start[g] : self.a_start[g + 1]], "b": self.b[self.b_start[g] : self.b_start[g + 1]]}
            out.setdefault(int(np.searchsorted(self.bounds, g, side="right")) - 1, []).append(group)
        return out


class Block:
    """Documents and their distinct words."""

    def __init__(self, both: BothTokenizers):
        self.both, self.number, self.rows, self.size, self._ids = both, defaultdict(count().__next__), [], 0, []

    def put(self, row: int, doc, text: str) -> None:
        self.size += len(text)
        if not text:
            parts = []
        elif not self.both.cuttable or text[0] == " " or text[-1] == " " or _DOUBLE.search(text):
            parts = [(text,)]
        else:
            parts = text.split(" ")
        self.rows.append((row, doc, np.array(list(map(self.number.__getitem__, parts)), np.int64)))

    @property
    def ids(self) -> list[tuple[bytes, bytes] | None]:
        if len(self._ids) < len(self.number):
            self._ids = self.both.ids(list(self.number))
        return self._ids

    @property
    def docs(self) -> list[tuple]:
        """Each row with its id and the numbers of its words, none if a tokenizer doesn't give one of them back."""
        lost = np.array([x is None for x in self.ids], bool)
        return [(row, doc, words[:0] if lost[words].any() else words) for row, doc, words in self.rows]

    def batch(self, kind: pa.Schema, direct: int) -> pa.RecordBatch:
        docs, groups = self.docs, Groups(self.both, self.ids, direct)
        n = list(map(len, [w for _, _, w in docs]))
        words, at = np.concatenate([w for _, _, w in docs]), _bounds(n)
        numbers = [np.diff(_bounds(x[words])[at]) for x in (np.diff(groups.a_bounds), np.diff(groups.b_bounds), np.diff(groups.bounds), groups.per_word(groups.links))]
        texts, large = groups.texts(), groups.large()
        spelt = ["".join(map(texts.__getitem__, w.tolist()))[:-1] for _, _, w in docs]
        bounds, pairs, times = self._links(groups, np.repeat(np.arange(len(docs)), n), words)
        lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x)) for x in (pairs, times)]
        of_large = [[g for i in w.tolist() for g in large.get(i, ())] for _, _, w in docs] if large else [[]] * len(docs)
        columns = [[row for row, _, _ in docs], [doc for _, doc, _ in docs], *numbers, spelt, *lists, of_large]
        return pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

    def _links(self, groups: Groups, docs: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each document's pairs begin; the distinct pairs of each, and how often it has them."""
        (of_words, begin), n_words = groups.pairs(), max(len(self.number), 1)
        held, times = np.unique(docs * n_words + words, return_counts=True)
        docs, words = np.divmod(held, n_words)
        n = begin[words + 1] - begin[words]
        known, place = np.unique(of_words, return_inverse=True)
        place = place[np.repeat(begin[words] - _bounds(n)[:-1], n) + np.arange(n.sum())]
        keys, times = np.repeat(docs, n) * max(len(known), 1) + place, np.repeat(times, n)
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.array([], np.int64)
        times = np.add.reduceat(times[order], first) if len(keys) else times
        docs, place = np.divmod(keys[first], max(len(known), 1))
        return np.searchsorted(docs, np.arange(len(self.rows) + 1)), known[place], times


_built: dict[tuple[str, int], BothTokenizers] = {}


def _both(key: str, vocabulary: str, model: bytes, longest: int) -> BothTokenizers:
    if (key, longest) not in _built:
        _built.clear()
        _built[key, longest] = BothTokenizers(vocabulary, model, longest=longest)
    return _built[key, longest]


def aligned(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text", block_chars: int = 1 << 20) -> DataFrame:
    """Per row: ``row``, ``__id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_text`` (``a1,a2|b1;a3|b2,b3``), its distinct ``pairs``, how many ``times`` it has each, and its groups with more links (``large_groups``)."""
    vocabulary = read_byte_level(path_a)
    with open(path_b, "rb") as f:
        model = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(model) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path_b} is larger than {MAX_VOCABULARY_BYTES} bytes")
    key = hashlib.sha256(vocabulary.encode() + model).hexdigest()
    shared, direct = docs.sparkSession.sparkContext.broadcast((key, vocabulary, model, _SHORT)), _DIRECT
    numbers = ", ".join(f"{c} bigint" for c in ("n_a", "n_b", "n_groups", "n_links"))
    schema = StructType.fromDDL(f"row bigint, __id {docs.schema[id_column].dataType.simpleString()}, {numbers}, groups_text string, pairs array<bigint>, times array<bigint>, large_groups array<struct<a:array<int>,b:array<int>>>")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind, both = to_arrow_schema(schema), _both(*shared.value)
        block = Block(both)
        for batch in batches:
            for row, doc, text in zip(*batch.columns, strict=True):
                block.put(row.as_py(), doc.as_py(), as_bytes(text.as_py()).decode("utf-8", "replace"))
                if block.size >= block_chars:
                    yield block.batch(kind, direct)
                    block = Block(both)
        if block.rows:
            yield block.batch(kind, direct)

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("__id"), text_bytes(text_column).alias("__t")).mapInArrow(links, schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` and its functions name it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pair(a: Column, b: Column) -> Column:
    return a.cast("bigint") * F.lit(1 << _SHIFT_BITS) + b


def repeats(values: Column) -> Column:
    """Distinct values of an array with how often each is there: structs of ``pair`` and ``times``."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (s[i] != s[F.greatest(i, F.lit(1)) - 1]))
        return let(starts, lambda at: F.transform(at, lambda p, k: F.struct(s[p].alias("pair"), (F.when(k + 1 < F.size(at), at[F.least(k + 1, F.size(at) - 1)]).otherwise(F.size(s)) - p).cast("bigint").alias("times"))))

    return F.when(F.size(values) > 0, let(F.sort_array(values), runs)).otherwise(F.array().cast(_NO_LINKS))


def _links(g: Column) -> Column:
    return F.size(g["a"]).cast("bigint") * F.size(g["b"])


def large_links(groups: Column) -> Column:
    """The pairs of larger groups as structs of ``pair`` and ``times``."""
    ids = lambda x: repeats(x.cast("array<bigint>"))
    counted = lambda g: F.flatten(F.transform(ids(g["a"]), lambda x: F.transform(ids(g["b"]), lambda y: F.struct(_pair(x["pair"], y["pair"]).alias("pair"), (x["times"] * y["times"]).alias("times")))))
    return F.flatten(F.transform(F.filter(groups, lambda g: _links(g) > _DIRECT), counted))


_NO_LINKS = "array<struct<pair:bigint,times:bigint>>"


def groups(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: id, ``n_a``, ``n_b`` and ``groups``, the ids of both tokenizers between common ends."""
    ids = lambda side: F.split(side, ",").cast("array<int>")
    of = lambda g: let(F.split(g, "[|]"), lambda sides: F.struct(ids(sides[0]).alias("a"), ids(sides[1]).alias("b")))
    found = F.when(F.col("groups_text") == "", F.array().cast("array<struct<a:array<int>,b:array<int>>>")).otherwise(F.transform(F.split("groups_text", ";"), of))
    return aligned(docs, path_a, path_b, id_column, text_column).select(F.col("__id").alias(id_column), "n_a", "n_b", found.alias("groups"))


def linked(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row ``row``, ``__id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_text``, and its links: ``small`` (a pair as often as it is there) and ``large``."""
    small = F.flatten(F.zip_with("pairs", "times", lambda p, n: F.array_repeat(p, n.cast("int"))))
    rows = aligned(docs, path_a, path_b, id_column, text_column)
    return rows.select("row", "__id", "n_a", "n_b", "n_groups", "n_links", "groups_text", small.alias("small"), large_links(F.col("large_groups")).alias("large"))


def pair_counts(links: DataFrame) -> DataFrame:
    """Of each linked pair ``n``, the rows that hold it, and ``best``: whether no pair of its A id is held by more."""
    held = F.when(F.size("large") == 0, F.col("pairs")).otherwise(F.array_distinct(F.concat("pairs", "large.pair")))
    n = links.select(F.explode(held).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = settle(n.withColumn("a", F.shiftright("pair", _SHIFT_BITS)), "align-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def score_links(links: DataFrame) -> DataFrame:
    """Per ``row`` with links: ``n_best`` and ``count_sum``, over all its links."""
    counts = settle(pair_counts(links), "align-pairs")
    if counts.count() <= BROADCAST_PAIRS:
        counts = F.broadcast(counts)
    each = links.select("row", "times", F.posexplode("pairs").alias("k", "pair")).select("row", "pair", F.col("times")[F.col("k")].alias("times"))
    each = each.unionByName(links.filter(F.size("large") > 0).select("row", F.explode("large").alias("l")).select("row", "l.pair", "l.times"))
    return each.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))


def align(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256``."""
    rows = aligned(docs, path_a, path_b, id_column, text_column)
    digest = F.when(F.col("groups_text") == "", "").otherwise(F.sha2(F.col("groups_text").cast("binary"), 256))
    large = F.when(F.size("large_groups") == 0, F.array().cast(_NO_LINKS)).otherwise(large_links(F.col("large_groups")))
    rows = settle(rows.select("row", "__id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "pairs", "times", large.alias("large")), "align-links")
    scored = rows.drop("pairs", "times", "large").join(score_links(rows.select("row", "pairs", "times", "large")), "row", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return scored.select(F.col("__id").alias(id_column), "n_a", "n_b", "n_groups", "n_links", none("n_best"), none("count_sum"), "groups_sha256")
