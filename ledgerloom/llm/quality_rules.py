"""Quality rules: an isolation forest over per-document rule statistics.

``rule_statistics`` makes one pass over each whole text and yields counts.  ``fit_forest`` grows random
split trees on a bounded sample of labelled rows; a row's anomaly score is ``2 ** (-mean path length
/ c(n))``.  ``calibrate`` sets the score above which a document is rejected so that at most
``max_loss`` of *all* labelled good rows are lost (a mergeable quantile sketch over the narrow table of
statistics, so the threshold covers all labelled rows at any size).

Defined results: a null text counts as empty; an empty text has zero for every count, fails the base rules
(fewer than 20 words) and is rejected.  Repeated rows are judged row by row and equal texts get equal
verdicts.  Without labelled good rows the forest is not applied and the base rules decide alone; an anomaly
just at the threshold is kept; an id labelled more than once counts as bad if any label says so; an empty table
gives no rows.  ``quality_rules`` returns only its own columns and ``keep_documents`` only the input's, whatever
their names; columns that ``rule_statistics``, ``anomaly`` and ``judge`` append replace input columns of the
same name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, as_bytes, settle, text_bytes

WINDOW = 8
STATISTICS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_upper", "n_marks",
)
_STAT_TYPE = "struct<" + ",".join(f"{c}:bigint" for c in STATISTICS) + ">"

#: Classes of bytes; each byte has one class.
_OTHER, _TAIL, _BLANK, _SYMBOL, _UPPER, _MARK = range(6)


def _byte_classes() -> bytes:
    out = bytearray(256)
    for b in range(256):
        if 0x80 <= b < 0xC0:
            out[b] = _TAIL
        elif b in BLANKS:
            out[b] = _BLANK
        elif b in b"#*$%&|<>":
            out[b] = _SYMBOL
        elif 65 <= b <= 90:
            out[b] = _UPPER
        elif 33 <= b < 127 and not chr(b).isalnum():
            out[b] = _MARK
    return bytes(out)


_CLASSES = _byte_classes()


def _window_weights(seed: int = 20) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_WEIGHTS = _window_weights()


def repeated_window_words(words: list[bytes], width: int = WINDOW) -> int:
    """How many words stand in a window of ``width`` words that occurs at least twice.

    Equal windows have equal hash sums, so a text whose sums are all different has none; where sums are
    equal, the windows themselves are compared.
    """
    n = len(words)
    if n <= width:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    sums = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        sums += h[k : n - width + 1 + k] * _WEIGHTS[k % WINDOW]
    ordered = np.sort(sums)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    twice = np.unique(twice)
    at = np.minimum(np.searchsorted(twice, sums), len(twice) - 1)
    starts = np.flatnonzero(twice[at] == sums)
    found = Counter(tuple(words[i : i + width]) for i in starts.tolist())
    starts = [i for i in starts.tolist() if found[tuple(words[i : i + width])] > 1]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.asarray(starts, np.int64) + width, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def statistics_of(text: bytes) -> tuple[int, ...]:
    """The counts named in ``STATISTICS`` for one text."""
    words = text.split()
    n = len(words)
    kinds = text.translate(_CLASSES)
    tails, blanks, symbols, upper, marks = (kinds.count(k) for k in (_TAIL, _BLANK, _SYMBOL, _UPPER, _MARK))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        n, len(text) - tails - blanks, symbols, len(lines) - len(set(lines)), repeated_window_words(words),
        upper, marks,
    )


def rule_statistics(df: DataFrame, text_column: str = "text", into: str = "rule_statistics") -> DataFrame:
    """Append the struct of counts; all other columns stay in the JVM."""

    @F.arrow_udf(_STAT_TYPE)
    def statistics(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            rows = np.array([statistics_of(as_bytes(x.as_py())) for x in batch], np.int64).reshape(len(batch), len(STATISTICS))
            yield pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(STATISTICS))], names=list(STATISTICS))

    # nondeterministic: else a filter on the result is pushed below it and the text is counted twice
    return df.withColumn(into, statistics.asNondeterministic()(text_bytes(text_column)))


def base_failed(s: str | None = None) -> Column:
    c = (lambda n: F.col(f"{s}.{n}")) if s else F.col
    return (c("n_words") < 20) | (100 * c("n_repeat_words") > 30 * c("n_words"))


def _features(counts: np.ndarray) -> np.ndarray:
    """Shares of symbols, capitals and marks, and the mean length of words.

    250 characters, or 20 words of five, are added to each text so that short ones don't stand out by chance.
    Repeated lines and windows are left to the base rules: good texts have them too, and splits on them hide
    what sets junk apart (the README has the figures).
    """
    x = {k: counts[:, i].astype(np.float64) for i, k in enumerate(STATISTICS)}
    shares = [x[k] / (x["word_chars"] + 250) for k in ("n_symbols", "n_upper", "n_marks")]
    return np.stack([*shares, (x["word_chars"] + 100) / (x["n_words"] + 20)], axis=1)


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary search tree of ``n`` keys: 2 H(n - 1) - 2 (n - 1) / n, with the series of the harmonic number."""
    n = np.asarray(n, np.float64)
    m = np.maximum(n, 2) - 1
    harmonic = np.log(m) + np.euler_gamma + 1 / (2 * m) - 1 / (12 * m * m)
    return np.where(n > 2, 2 * harmonic - 2 * m / (m + 1), np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: ``feature`` is -1 at leaves; children of node k are 2k+1 and 2k+2."""

    feature: np.ndarray
    split: np.ndarray
    depth: np.ndarray  # path length that a row gets which ends at this node
    scale: float
    threshold: float = 2.0  # no score is above 1

    def scores(self, counts: np.ndarray) -> np.ndarray:
        x = _features(counts)
        rows, total = np.arange(len(x)), np.zeros(len(x))
        for feature, split, depth in zip(self.feature, self.split, self.depth, strict=True):
            node = np.zeros(len(x), np.int64)
            while (inner := feature[node] >= 0).any():
                right = x[rows, np.maximum(feature[node], 0)] >= split[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += depth[node]
        return 2.0 ** (-total / (len(self.feature) * self.scale))


def grow_forest(counts: np.ndarray, trees: int = 200, sample: int = 64, seed: int = 8) -> Forest:
    """Isolation trees: each splits a random sample at random values of random features, to depth log2(sample)."""
    x, rng = _features(counts), np.random.default_rng(seed)
    sample = min(sample, len(x))
    levels = max(1, int(np.ceil(np.log2(max(sample, 2)))))
    size = 2 ** (levels + 1) - 1
    feature, split, depth = np.full((trees, size), -1, np.int64), np.zeros((trees, size)), np.zeros((trees, size))
    for t in range(trees):
        todo = [(0, rng.choice(len(x), sample, replace=False), 0)]
        while todo:
            node, rows, level = todo.pop()
            low, high = (x[rows].min(0), x[rows].max(0)) if len(rows) else (np.zeros(x.shape[1]),) * 2
            usable = np.flatnonzero(high > low)
            if level == levels or not len(usable):
                depth[t, node] = level + float(_mean_path(len(rows)))
                continue
            k = int(rng.choice(usable))
            at = rng.uniform(low[k], high[k])
            feature[t, node], split[t, node] = k, at
            right = x[rows, k] >= at
            todo += [(2 * node + 1, rows[~right], level + 1), (2 * node + 2, rows[right], level + 1)]
    return Forest(feature, split, depth, max(float(_mean_path(sample)), 1e-9))


def _score_udf(forest: Forest):
    @F.arrow_udf("double")
    def score(stats: pa.Array) -> pa.Array:
        counts = np.stack([np.asarray(stats.field(k)) for k in range(len(STATISTICS))], axis=1) if len(stats) else np.zeros((0, len(STATISTICS)))
        return pa.array(forest.scores(counts), pa.float64())

    return score.asNondeterministic()


def anomaly(df: DataFrame, forest: Forest, stats: str = "rule_statistics", into: str = "anomaly") -> DataFrame:
    return df.withColumn(into, _score_udf(forest)(F.col(stats)))


def fit_forest(stats: DataFrame, labels: DataFrame, id_column: str = "doc_id", rows: int = 4096, max_loss: float = 0.002, trees: int = 200, seed: int = 8) -> Forest:
    """Fit on at most ``rows`` labelled rows, then calibrate on every labelled good row.

    ``stats`` is a narrow settled table (id, ``rule_statistics``).  The sample holds the labelled rows, good
    or bad, with the smallest hashes of their ids; the trees don't see the labels.  Rows that the base rules
    fail take no part: the forest never judges them.  With fewer than 8 labelled rows left, or none of them good,
    there is nothing to fit or to calibrate by: then no forest is applied, and the base rules alone decide.
    """
    marked = labels.filter(F.col("quality").isin(0, 1)).groupBy(id_column).agg(F.min("quality").alias("__label"))
    known = stats.select(id_column, "rule_statistics").filter(~base_failed("rule_statistics")).join(marked, id_column)
    known = settle(known, "rules-labelled")
    sample = known.orderBy(F.xxhash64(id_column), id_column).limit(rows).select("rule_statistics.*").toPandas()
    if len(sample) < 8 or known.filter("__label = 1").isEmpty():
        return Forest(np.full((1, 1), -1), np.zeros((1, 1)), np.zeros((1, 1)), 1.0)
    forest = grow_forest(sample[list(STATISTICS)].to_numpy(), trees=trees, seed=seed)
    cut = anomaly(known.filter("__label = 1"), forest).agg(F.percentile_approx("anomaly", 1 - max_loss, 100_000).alias("cut")).first()["cut"]
    return Forest(forest.feature, forest.split, forest.depth, forest.scale, float(cut))


def judge(df: DataFrame, forest: Forest, stats: str = "rule_statistics") -> DataFrame:
    """Append ``anomaly``, ``base_failed`` and ``kept``."""
    out = anomaly(df, forest, stats)
    return out.withColumn("base_failed", base_failed(stats)).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= F.lit(forest.threshold)))


def quality_rules(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", **fit) -> DataFrame:
    """One row per document: id, the counts, ``anomaly``, ``base_failed``, ``kept``; texts are read once."""
    narrow = settle(rule_statistics(docs.select(id_column, text_column), text_column).select(id_column, "rule_statistics"), "rules")
    return judge(narrow, fit_forest(narrow, labels, id_column, **fit)).select(id_column, "rule_statistics.*", "anomaly", "base_failed", "kept")


def keep_documents(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", **fit) -> DataFrame:
    """The documents that pass, with all their own columns.

    Texts are read twice (once to calibrate, once to judge), which is cheaper than shuffling them to meet
    a table of verdicts.
    """
    narrow = settle(rule_statistics(docs.select(id_column, text_column), text_column).select(id_column, "rule_statistics"), "rules")
    forest = fit_forest(narrow, labels, id_column, **fit)
    cut = forest.threshold

    @F.arrow_udf("boolean")
    def kept(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            for i in range(0, len(batch), 256):
                counts = np.array([statistics_of(as_bytes(x.as_py())) for x in batch.slice(i, 256)], np.int64).reshape(-1, len(STATISTICS))
                failed = (counts[:, 0] < 20) | (100 * counts[:, 4] > 30 * counts[:, 0])
                yield pa.array(~failed & (forest.scores(counts) <= cut), pa.bool_())

    # one column of verdicts: texts cross to Python once and wait for one worker, not two
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), kept.asNondeterministic()(text_bytes(text_column)).alias("__kept"))
    return carried.filter("__kept").select("__row.*")
