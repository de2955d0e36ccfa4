r"""Ranked lexical search by Fagin's threshold algorithm.

Terms are maximal runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased.  A term that
``df`` of ``N`` documents hold weighs w = floor(1000 * ln((2 N + 2) / (2 df + 1))); in a document with ``tf`` of its
``n`` terms it has the impact w * ((10^9 tf) div (1000 tf + 12 m)), m = 75 + ((25 n N) div L), L being all terms.  A
document's score sums the impacts of a query's terms, repeats included.

Queries come in blocks of at most ``block`` (only a block's terms are broadcast), each answered over all documents:

1. One scan of the texts keeps of each document its length and its counts of the block's terms: the forward index, a
   table in the shared folder.  ``N``, ``L`` and ``df`` are sums over it, combined before the shuffle.
2. Each task takes its part of the forward index in shards of at most ``shard`` documents and lists each term's
   documents by falling impact.  A query reads its terms' lists in turn, ``depth`` entries of each in the first round
   and twice as many in each further one, so at most twice what a finer round-robin reads; each
   document met first is scored whole from the forward index; after a round, a document that no list has shown yet
   scores at most the sum of the impacts at which the lists stand.  When that threshold is strictly below the k-th best
   score, no such document can enter, not even by a tie.  The k best are carried from shard to shard of a task, so
   later shards stop earlier.
3. The tasks' k best of each query are ranked; rows beyond k are dropped before the shuffle.

No postings are shuffled, nothing grows with a term's frequency but the lists of one shard, and a lost executor costs
its own shards.

Defined results: null texts and texts without terms are no documents; texts are taken whole; a query without known
terms has no rows; queries and documents that are repeated count each; a null id of a document comes last among equal
scores; equal ids with equal scores are ranked in turn; an empty table gives no rows; columns of the input may have
any names, those of the result are the operator's own.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import as_bytes, settle, text_bytes

# What separates terms, ASCII but for digits and letters.
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
_FOLD = bytes(0x20 if b in SEPARATORS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_FORWARD = "__id bigint, n bigint, terms array<int>, tfs array<int>"
_FOUND = "query int, no_id boolean, doc_id bigint, score bigint"


def terms_of(text: bytes) -> list[bytes]:
    return [t for t in text.translate(_FOLD).split(b" ") if t]


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(w: np.ndarray, tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    m = 100 - 25 + (25 * n * docs) // max(length, 1)
    return w * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Of each document with terms its id, number of terms, and numbers and counts of those in ``vocabulary`` (ascending)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        kinds = [("__id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))]
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                counts = Counter(as_bytes(text.as_py()).translate(_FOLD).split(b" "))
                n = counts.total() - counts.pop(b"", 0)
                if n:
                    held = sorted((known[t], tf) for t, tf in counts.items() if t in known)
                    rows.append((doc.as_py(), n, [t for t, _ in held], [tf for _, tf in held]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], names=[name for name, _ in kinds])

    return docs.select(F.col(id_column).cast("bigint").alias("__id"), text_bytes(text_column).alias("__t")).mapInArrow(count, _FORWARD)


class Shard:
    """A bounded number of documents: rows of the forward index, and each term's documents by falling impact."""

    def __init__(self, ids: np.ndarray, no_id: np.ndarray, bounds: np.ndarray, terms: np.ndarray, impact: np.ndarray):
        self.ids, self.no_id, self.bounds, self.terms, self.impact = ids, no_id, bounds, terms, impact
        order = np.lexsort((-impact, terms))
        self.listed = np.repeat(np.arange(len(ids)), np.diff(bounds))[order]
        self.listed_impact = impact[order]
        self.starts = np.searchsorted(terms[order], np.arange(int(terms.max()) + 2 if len(terms) else 1))

    def span(self, term: int) -> tuple[int, int]:
        return (int(self.starts[term]), int(self.starts[term + 1])) if term + 1 < len(self.starts) else (0, 0)

    def scores(self, rows: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Whole scores of documents, looked up in the forward index; ``times``: how often the query has each term."""
        begin, size = self.bounds[rows], self.bounds[rows + 1] - self.bounds[rows]
        at = np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        return np.add.reduceat(times[self.terms[at]] * self.impact[at], np.concatenate(([0], np.cumsum(size)[:-1])))


class Best:
    """The k best of one query so far: score descending, missing ids last, id ascending."""

    def __init__(self, k: int):
        self.k, self.score, self.no_id, self.ids = k, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, no_id: np.ndarray, ids: np.ndarray) -> None:
        if len(self.score) == self.k:
            able = score >= self.score[-1]
            score, no_id, ids = score[able], no_id[able], ids[able]
        score, no_id, ids = np.concatenate((self.score, score)), np.concatenate((self.no_id, no_id)), np.concatenate((self.ids, ids))
        kept = np.lexsort((ids, no_id, -score))[: self.k]
        self.score, self.no_id, self.ids = score[kept], no_id[kept], ids[kept]

    def beyond(self, threshold: int) -> bool:
        """Whether nothing that scores at most ``threshold`` can enter."""
        return len(self.score) == self.k and threshold < self.score[-1]


def threshold_search(shard: Shard, query: dict[int, int], times: np.ndarray, best: Best, depth: int) -> int:
    """Add to ``best`` what the shard has for ``query`` (term: repeats; ``times`` holds the same by term); the number of documents looked up."""
    lists = [(*shard.span(t), repeats) for t, repeats in query.items()]
    at, ends, repeats = (np.array([x[k] for x in lists], np.int64) for k in range(3))
    looked, seen = 0, np.zeros(len(shard.ids), bool)
    while True:
        reading = at < ends
        stands = np.where(reading, shard.listed_impact[np.minimum(at, max(len(shard.listed_impact) - 1, 0))], 0) if len(shard.listed_impact) else np.zeros(len(at), np.int64)
        threshold = int((repeats * stands).sum())
        if not threshold or best.beyond(threshold):
            return looked
        until = np.minimum(at + depth, ends)
        met = np.unique(np.concatenate([shard.listed[a:b] for a, b in zip(at[reading].tolist(), until[reading].tolist(), strict=True)]))
        met, at, depth = met[~seen[met]], until, 2 * depth
        if len(met):
            seen[met] = True
            looked += len(met)
            score = shard.scores(met, times)
            above = score > 0
            best.add(score[above], shard.no_id[met[above]], shard.ids[met[above]])


def _shards(batches: Iterator[pa.RecordBatch], most: int, weights: np.ndarray, docs: int, length: int) -> Iterator[Shard]:
    """The rows of a task in shards of ``most`` documents at most."""

    def made(parts: list[pa.RecordBatch]) -> Shard:
        table = pa.Table.from_batches(parts).combine_chunks()
        ids, n, terms, tfs = (table.column(k).combine_chunks() for k in range(4))
        size = np.diff(terms.offsets.to_numpy().astype(np.int64))
        flat, tf = terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64)
        impact = impacts(weights[flat], tf, np.repeat(n.to_numpy(), size), docs, length)
        return Shard(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(size))), flat, impact)

    held, rows = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, most - rows)
            held.append(part)
            rows, batch = rows + part.num_rows, batch.slice(part.num_rows)
            if rows == most:
                yield made(held)
                held, rows = [], 0
    if held:
        yield made(held)


def _answer(docs: DataFrame, queries: list[Row], k: int, shard: int, depth: int, id_column: str, text_column: str) -> DataFrame:
    """(``query``: place in ``queries``, rank, doc_id, score) for one block."""
    spark = docs.sparkSession
    counts = [Counter(terms_of((r["text"] or "").encode("utf-8", "replace"))) for r in queries]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
    index = settle(forward_index(docs, vocabulary, id_column, text_column), "search-forward")
    whole = index.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    held = {r["term"]: r["df"] for r in index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}  # a number for each term of the block
    weights = np.array([weight(whole["docs"], held[i]) if i in held else 0 for i in range(len(vocabulary))], np.int64)
    shared = spark.sparkContext.broadcast(([{vocabulary[t]: n for t, n in c.items()} for c in counts], weights))

    def best_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, of_term = shared.value
        best = [Best(k) for _ in asked]
        times = np.zeros(len(of_term), np.int64)
        # a document without any term of the block can't be met
        some = (b.filter(pc.greater(pc.list_value_length(b.column(2)), 0)) for b in batches)
        for part in _shards(some, shard, of_term, whole["docs"], whole["length"]):
            for query, top in zip(asked, best, strict=True):
                terms = list(query)
                times[terms] = list(query.values())
                threshold_search(part, query, times, top, depth)
                times[terms] = 0
        columns = [np.repeat(np.arange(len(best), dtype=np.int32), [len(b.ids) for b in best])] + [np.concatenate([getattr(b, c) for b in best]) if best else np.zeros(0) for c in ("no_id", "ids", "score")]
        ids = pa.array(columns[2].astype(np.int64), mask=columns[1].astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1].astype(bool)), ids, pa.array(columns[3].astype(np.int64))], names=["query", "no_id", "doc_id", "score"])

    found = index.mapInArrow(best_of_task, _FOUND)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "no_id", "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, block: int = 4096, shard: int = 1 << 15, depth: int = 32, id_column: str = "doc_id", text_column: str = "text",
           item_column: str = "item_id", query_column: str = "text") -> DataFrame:
    """The ``k`` best documents of each item: ``item_id``, ``rank`` (from 1), ``doc_id``, ``score``."""
    spark = docs.sparkSession
    kind = f"query int, item_id {items.schema[item_column].dataType.simpleString()}"
    answers: list[DataFrame] = []
    for rows in _blocks(items.select(F.col(item_column).alias("item"), F.col(query_column).cast("string").alias("text")), block):
        named = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(rows)], kind)
        answers.append(settle(_answer(docs, rows, k, shard, depth, id_column, text_column).join(F.broadcast(named), "query").select("item_id", "rank", "doc_id", "score"), "search-found"))
    whole = spark.createDataFrame([], kind).selectExpr("item_id", "1 AS rank", "1L AS doc_id", "1L AS score") if not answers else answers[0]
    for more in answers[1:]:
        whole = whole.unionByName(more)
    return whole


def _blocks(items: DataFrame, block: int) -> Iterator[list[Row]]:
    """Rows by blocks; the driver holds one block and one partition's rows."""
    held: list[Row] = []
    for row in items.toLocalIterator():
        held.append(row)
        if len(held) == block:
            yield held
            held = []
    if held:
        yield held
