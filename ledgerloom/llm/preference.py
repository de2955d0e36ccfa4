"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

A labelled good document is preferred to a labelled bad one.  With features x, the model says
P(a preferred to b) = sigmoid(w . (x_a - x_b)); w minimises the mean logistic loss over all pairs of a good and
a bad row plus an L2 term, by Newton's method.  Gradient and curvature are sums over rows and one product of
matrices, so pairs are never listed.  w . x then ranks all documents, and a quantile of the labelled training
rows' scores (the share of bad ones, refined by balanced accuracy) is the cut: score = sigmoid(w . x - cut).

The fit is the only bounded part: at most ``rows_per_class`` good and as many bad labelled documents, those with
the smallest hashes of ids, one row of features for each id, are sent to the driver.  The cut is over all
labelled training rows.

Defined results: null texts count as empty and are scored like any other; equal texts get equal scores;
null ids are scored, never trained on; rows that repeat an id are scored each, and the least of their features
is learned from; ties at the cut are bad; without labels of both kinds every score is 0.5; an empty table gives
no rows; columns of the input may have any names: results have only their own or, from ``keep_preferred``, only
the input's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, as_bytes, fold_of, settle, text_bytes

FEATURES = (
    "upper", "digit", "blank", "newline", "mark", "symbol", "pipe", "exclaim", "length",
    "word_length", "distinct", "echo", "line_repeat", "trigram_repeat", "capitals", "short",
)
_KINDS = (bytes(range(65, 91)), b"0123456789", BLANKS.replace(b"\n", b""), b"\n", b".,;:?'\"()-", b"#*$%&<>@^~_=+", b"|", b"!")


def _kind_table() -> bytes:
    out = bytearray(256)
    for k, members in enumerate(_KINDS, 1):
        for b in members:
            out[b] = k
    return bytes(out)


_KIND_OF = _kind_table()


def features_of(text: bytes) -> list[float]:
    """Surface features of one whole text, each bounded so that long texts don't dominate."""
    kinds, size, words = text.translate(_KIND_OF), max(len(text), 1), text.split()
    n = max(len(words), 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    trigrams = len(set(zip(words, words[1:], words[2:], strict=False)))
    shares = [np.sqrt(kinds.count(k) / size) for k in range(1, len(_KINDS) + 1)]
    return shares + [
        np.log1p(len(words)) / 10, min(sum(map(len, words)) / n, 40) / 10, len(set(words)) / n,
        np.sqrt(sum(a == b for a, b in zip(words, words[1:], strict=False)) / n),
        np.sqrt((len(lines) - len(set(lines))) / max(len(lines), 1)),
        np.sqrt(max(len(words) - 2 - trigrams, 0) / n), sum(map(bytes.isupper, words)) / n, float(len(words) < 20),
    ]


def featurise(df: DataFrame, text_column: str = "text", into: str = "x") -> DataFrame:
    @F.arrow_udf("array<double>")
    def features(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([[float(v) for v in features_of(as_bytes(x.as_py()))] for x in batch], pa.list_(pa.float64()))

    return df.withColumn(into, features.asNondeterministic()(text_bytes(text_column)))


@dataclass(frozen=True)
class Ranker:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    cut: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights


def pair_sums(w: np.ndarray, better: np.ndarray, worse: np.ndarray, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the mean of log(1 + exp(-w . (a - b))) over all rows a of ``better`` and b of ``worse``."""
    up, down = better @ w, worse @ w
    gradient, curvature = np.zeros(len(w)), np.zeros((len(w), len(w)))
    for i in range(0, len(up), block):
        a = better[i : i + block]
        wrong = 1 / (1 + np.exp(np.clip(up[i : i + block, None] - down, -30, 30)))  # probability of the wrong order
        gradient += wrong.sum(0) @ worse - wrong.sum(1) @ a
        q = wrong * (1 - wrong)
        cross = a.T @ q @ worse
        curvature += (a * q.sum(1)[:, None]).T @ a + (worse * q.sum(0)[:, None]).T @ worse - cross - cross.T
    n = len(better) * len(worse)
    return gradient / n, curvature / n


def fit_pairs(better: np.ndarray, worse: np.ndarray, l2: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Newton's method on the loss over all pairs."""
    w = np.zeros(better.shape[1])
    for _ in range(steps):
        gradient, curvature = pair_sums(w, better, worse)
        step = np.linalg.solve(curvature + l2 * np.eye(len(w)), gradient + l2 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled(labels: DataFrame, id_column: str = "doc_id", folds: int = 3, held_out: int = 1) -> DataFrame:
    """Ids and labels that may be learned from; an id labelled more than once counts as bad if any label says so."""
    rows = labels.filter(F.col("quality").isin(0, 1) & (fold_of(id_column, folds) != held_out))
    return rows.groupBy(id_column).agg(F.min("quality").alias("__label"))


def fit_ranker(docs: DataFrame, known: DataFrame, id_column: str = "doc_id", text_column: str = "text", rows_per_class: int = 3000) -> Ranker:
    """Fit on at most ``rows_per_class`` good and as many bad labelled documents, those with the smallest hashes of ids."""
    order = (F.xxhash64(id_column), F.col(id_column))
    chosen = known.filter("__label = 1").orderBy(*order).limit(rows_per_class).unionByName(known.filter("__label = 0").orderBy(*order).limit(rows_per_class))
    found = docs.select(F.col(id_column), F.col(text_column)).join(F.broadcast(chosen), id_column)  # at most 2 * rows_per_class ids
    rows = featurise(found, text_column).groupBy(id_column, "__label").agg(F.min("x").alias("x")).toPandas()  # a row for each id, repeated or not
    d = len(FEATURES)
    x = np.array(rows["x"].tolist(), np.float64).reshape(len(rows), d)
    y = rows["__label"].to_numpy()
    if not (y == 1).any() or not (y == 0).any():
        return Ranker(np.zeros(d), np.zeros(d), np.ones(d))
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    order = np.lexsort(x.T)  # rows come in any order; the fit must not depend on it
    z, y = ((x - mean) / scale)[order], y[order]
    return Ranker(fit_pairs(z[y == 1], z[y == 0]), mean, scale)


def raw_scores(df: DataFrame, ranker: Ranker, text_column: str = "text", into: str = "__raw") -> DataFrame:
    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            x = np.array([features_of(as_bytes(t.as_py())) for t in batch], np.float64).reshape(len(batch), len(FEATURES))
            yield pa.array(np.round(ranker.raw(x), 9), pa.float64())

    return df.withColumn(into, score.asNondeterministic()(text_bytes(text_column)))


def quantile_cut(scored: DataFrame, known: DataFrame, id_column: str = "doc_id") -> float:
    """The score at a quantile of all labelled training rows.

    Levels around the share of bad rows are tried; the one with the best balanced accuracy is taken.
    ``scored`` is narrow (id, ``__raw``); a quantile sketch of fixed size serves any number of rows.
    """
    rows = settle(scored.join(known, id_column).select("__raw", "__label"), "preference-labelled")
    share = rows.agg(F.avg(1 - F.col("__label")).alias("bad"), F.count("*").alias("n")).first()
    if not share["n"] or share["bad"] in (0.0, 1.0):
        return 0.0
    levels = sorted({min(max(share["bad"] * m, 0.0), 1.0) for m in (0.8, 0.9, 0.95, 0.98, 0.99, 1.0, 1.01, 1.02, 1.05, 1.1)})
    cuts = rows.agg(F.percentile_approx("__raw", levels, 100_000).alias("c")).first()["c"]
    hit = rows.groupBy("__label").agg(*[F.avg((F.col("__raw") > F.lit(c)).cast("double")).alias(f"c{i}") for i, c in enumerate(cuts)]).collect()
    above = {r["__label"]: r for r in hit}
    best = max(range(len(cuts)), key=lambda i: (above[1][f"c{i}"] - above[0][f"c{i}"], -i))
    upper = rows.filter(F.col("__raw") > F.lit(cuts[best])).agg(F.min("__raw").alias("m")).first()["m"]
    return float(cuts[best]) if upper is None else (float(cuts[best]) + float(upper)) / 2


def with_score(df: DataFrame, cut: float, raw: str = "__raw", into: str = "score", verdict: str = "predicted") -> DataFrame:
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(cut) - F.col(raw)))
    return df.withColumn(into, p).withColumn(verdict, (F.col(into) >= 0.5).cast("int"))


def rank_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", folds: int = 3, held_out: int = 1, rows_per_class: int = 3000) -> DataFrame:
    """One row per document: id, ``held_out``, ``score`` in 0..1, ``predicted``."""
    known = labelled(labels, id_column, folds, held_out)
    ranker = fit_ranker(docs, known, id_column, text_column, rows_per_class)
    scored = settle(raw_scores(docs.select(id_column, text_column), ranker, text_column).select(id_column, "__raw"), "preference")
    out = with_score(scored, quantile_cut(scored, known, id_column))
    return out.select(id_column, F.coalesce(fold_of(id_column, folds) == held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_preferred(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", folds: int = 3, held_out: int = 1, rows_per_class: int = 3000) -> DataFrame:
    """The documents predicted good, with all their own columns; texts are scored again rather than shuffled."""
    known = labelled(labels, id_column, folds, held_out)
    ranker = fit_ranker(docs, known, id_column, text_column, rows_per_class)
    scored = settle(raw_scores(docs.select(id_column, text_column), ranker, text_column).select(id_column, "__raw"), "preference")
    cut = quantile_cut(scored, known, id_column)
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(text_column).alias("__text"))
    return with_score(raw_scores(carried, ranker, "__text"), cut).filter("predicted = 1").select("__row.*")
