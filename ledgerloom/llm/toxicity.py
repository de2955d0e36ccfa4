"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

The text is lower-cased and taken as code points between two blanks; n-grams of 3 to 6 are hashed to
``2 ** bits`` features, present or absent.  With p and q the smoothed shares of toxic and clean training
documents that have a feature, its value is r = log(p / q) where present; logistic regression with an L2
term is fitted on the ``selected`` features of largest |r| that at least ``min_documents`` training documents
have, and score = sigmoid(bias + sum of w * r).

Training takes at most ``rows_per_class`` labelled rows of each class (smallest hashes of ids), one text for each
id (the one with the smallest digest).  Counts are summed inside tasks before they are shuffled and the feature
space is fixed, so neither grows with the corpus; the driver gets a bit for each training row and selected
feature, 3 MB at most, and fits on the 100 MB matrix made of them.

Defined results: null texts count as empty and get the bias alone, near zero; equal texts get equal scores;
null ids are scored, never trained on; rows that repeat an id are scored each; ties of |r| go to the smaller
feature; without labels of both kinds the score is the constant share of toxic labels (0 without labels); an
empty table gives no rows; columns of the input may have any names, the result has only its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, fold_of, settle, text_bytes

BITS = 20
ORDERS = (3, 4, 5, 6)
_PRIME = np.uint32(0x9E3779B1)
_PIECE = 1 << 16


def _code_points(text: bytes) -> np.ndarray:
    points = np.frombuffer(f" {text.decode('utf-8', 'replace').lower()} ".encode("utf-32-le", "replace"), np.uint32)
    return np.where(points <= 32, np.uint32(32), points)


def _hashes(points: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Hashed n-grams of each order, over pieces of the text that overlap, so memory stays small."""
    longest = max(ORDERS)
    for start in range(0, len(points), _PIECE):
        piece = points[start : start + _PIECE + longest - 1]
        rolled = np.zeros(len(piece), np.uint32)
        for n in range(1, longest + 1):
            if len(piece) < n:
                break
            rolled = rolled[: len(piece) - n + 1] * _PRIME + piece[n - 1 :]
            if n in ORDERS:
                h = rolled[: max(0, min(len(rolled), _PIECE))]
                h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                yield (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - bits)


def features_in(text: bytes, bits: int = BITS, among: np.ndarray | None = None) -> np.ndarray:
    """Sorted ids of the features that the whole text has; only those that ``among`` marks, if given."""
    found = [h if among is None else h[among[h]] for h in _hashes(_code_points(text), bits)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)


@dataclass(frozen=True)
class NbLinear:
    bits: int
    value: np.ndarray  # w * r by feature, zero where not selected
    bias: float

    def score(self, text: bytes, among: np.ndarray) -> float:
        z = self.bias + float(self.value[features_in(text, self.bits, among)].sum(dtype=np.float64))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def labelled(labels: DataFrame, id_column: str = "doc_id", folds: int = 4, held_out: int = 2) -> DataFrame:
    """Ids and labels that may be learned from; an id labelled more than once is toxic if any label says so."""
    rows = labels.filter(F.col("toxic").isin(0, 1) & (fold_of(id_column, folds) != held_out))
    return rows.groupBy(id_column).agg(F.max("toxic").alias("__label"))


def _counted(rows: DataFrame, bits: int) -> DataFrame:
    """Documents of each class by feature; each task sums its own before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << bits), np.int32)
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                seen[label, features_in(as_bytes(text.as_py()), bits)] += 1
        at = np.flatnonzero(seen.any(0))
        for i in range(0, len(at), 1 << 16):
            k = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(seen[1, k], pa.int64()), pa.array(seen[0, k], pa.int64())], names=["f", "toxic", "clean"])

    return rows.mapInArrow(count, "f int, toxic long, clean long").groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_ratios(toxic: Column, clean: Column, n_toxic: int, n_clean: int, alpha: float) -> Column:
    """log(p / q) of the smoothed shares of toxic and clean documents that have a feature."""
    return F.log((toxic + alpha) / F.lit(n_toxic + 2 * alpha)) - F.log((clean + alpha) / F.lit(n_clean + 2 * alpha))


def logistic(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic loss by full-batch Adam; classes weigh the same."""
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    w, b = np.zeros(x.shape[1]), 0.0
    m1, m2 = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        z = x @ w.astype(x.dtype) + b
        error = weight * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y)
        g = np.append(error.astype(x.dtype) @ x + l2 * w, error.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", folds: int = 4, held_out: int = 2,
        rows_per_class: int = 3000, selected: int = 4096, min_documents: int = 5, alpha: float = 0.5, l2: float = 2e-3, bits: int = BITS) -> NbLinear:
    known = labelled(labels, id_column, folds, held_out)
    share = known.agg(F.avg("__label").alias("p")).first()["p"]
    order = (F.xxhash64(id_column), F.col(id_column))
    chosen = known.filter("__label = 1").orderBy(*order).limit(rows_per_class).unionByName(known.filter("__label = 0").orderBy(*order).limit(rows_per_class))
    of_chosen = docs.select(F.col(id_column), text_bytes(text_column).alias("__text")).join(F.broadcast(chosen), id_column)  # at most 2 * rows_per_class ids
    rows = settle(of_chosen.groupBy(id_column, "__label").agg(F.min_by("__text", F.md5("__text")).alias("__text")), "toxicity-sample").select("__label", "__text")
    n = {r["__label"]: r["count"] for r in rows.groupBy("__label").count().collect()}
    if not n.get(0) or not n.get(1):
        p = float(share or 0.0)
        return NbLinear(bits, np.zeros(1 << bits, np.float32), float(np.log(max(p, 1e-9) / max(1 - p, 1e-9))))
    top = (
        _counted(rows, bits).filter(F.col("toxic") + F.col("clean") >= min_documents).withColumn("r", log_ratios(F.col("toxic"), F.col("clean"), n[1], n[0], alpha))
        .orderBy(F.abs("r").desc(), "f").limit(selected).toPandas()
    )
    place = np.full(1 << bits, -1, np.int32)
    place[top["f"].to_numpy()] = np.arange(len(top))
    shared = docs.sparkSession.sparkContext.broadcast(place)  # 4 bytes for each of 2 ** bits features

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among, width = shared.value >= 0, int(shared.value.max()) + 1
        for b in batches:
            rows = []
            for x in b.column(1):
                has = np.zeros(width, bool)
                has[shared.value[features_in(as_bytes(x.as_py()), bits, among)]] = True
                rows.append(np.packbits(has).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), pa.array(rows, pa.binary())], names=["y", "has"])

    found = rows.mapInArrow(marked, "y int, has binary").toArrow().sort_by([("y", "ascending"), ("has", "ascending")])  # a bit for each selected feature and training row
    y = found["y"].to_numpy().astype(np.float64)
    r = top["r"].to_numpy().astype(np.float32)
    x = np.stack([np.unpackbits(np.frombuffer(h.as_py(), np.uint8), count=len(r)) for h in found["has"]]).astype(np.float32) * r
    w, bias = logistic(x, y, l2)
    value = np.zeros(1 << bits, np.float32)
    value[top["f"].to_numpy()] = w * r
    return NbLinear(bits, value, bias)


def with_score(df: DataFrame, model: NbLinear, text_column: str = "text", into: str = "score") -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)  # 4 bytes for each of 2 ** bits features

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        among = shared.value.value != 0
        for batch in texts:
            yield pa.array([round(shared.value.score(as_bytes(x.as_py()), among), 9) for x in batch], pa.float64())

    return df.withColumn(into, score.asNondeterministic()(text_bytes(text_column)))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", folds: int = 4, held_out: int = 2, threshold: float = 0.3, **how) -> DataFrame:
    """One row per document: id, ``held_out``, ``score`` in 0..1, ``predicted``."""
    model = fit(docs, labels, id_column, text_column, folds, held_out, **how)
    out = with_score(docs.select(id_column, text_column), model, text_column)
    return out.select(id_column, F.coalesce(fold_of(id_column, folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
