"""Quality classifier: regularised quadratic discriminant over document statistics.

Statistics are computed once per document, on its whole text. Class moments (count,
sum, sum of products) are summed on the executors over every labelled training row;
the driver sees one row per class and pair of statistics. Covariances are shrunk
towards their diagonal and floored, and a document's score comes from the difference
of the classes' Mahalanobis log-densities through Cholesky factors computed once.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiepoint.llm.common import bound_batches, materialise, remainder

#: Weight of the diagonal in a class covariance.
SHRINKAGE = 0.1
#: Standard deviations are this share of the pooled one at least.
FLOOR = 0.3
THRESHOLD = 0.3
_SYMBOLS = "".join(c for c in string.punctuation if c not in ".,'-").encode()
_STOPS = b".,;:?"
STATISTICS = ("words", "word_chars", "upper", "symbols", "symbol_words", "stops", "digits", "distinct", "commonest", "adjacent", "repeats", "short", "lines", "line_words", "repeated_lines", "longest")


def statistics_of(text: str) -> list[float]:
    """The transformed statistics of one whole text: logarithms of counts, square roots of smoothed shares."""
    raw = text.encode("utf-8", "replace")
    size = len(raw) + 20
    words = text.split()
    n = len(words)
    counts = Counter(words)
    share = lambda x, of, prior=0.0: math.sqrt((x + prior) / (of + 20))
    left = lambda drop: len(raw) - len(raw.translate(None, drop))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    pairs = Counter(zip(words, words[1:], strict=False))
    return [
        math.log1p(n),
        math.log((sum(map(len, words)) + 100) / (n + 20)),
        share(left(string.ascii_uppercase.encode()), size, 1),
        share(left(_SYMBOLS), size),
        share(sum(not w[-1].isalnum() and w[-1] not in ".,;:" for w in words), n),
        share(left(_STOPS), n, 2),
        share(left(string.digits.encode()), size),
        math.log((len(counts) + 20) / (n + 20)),
        share(max(counts.values(), default=0), n, 1),
        share(sum(a == b for a, b in zip(words, words[1:], strict=False)), n),
        share(max(0, n - 1) - len(pairs), n),
        share(sum(len(w) <= 3 for w in words), n, 6),
        math.log1p(len(lines)) - 0.5 * math.log1p(n),
        math.log((n + 20) / (len(lines) + 1)),
        share(len(lines) - len(set(lines)), len(lines)),
        math.log(max(map(len, words), default=0) + 10),
    ]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, stats)`` for every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics_of(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "stats"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, stats array<double>")


@dataclass(frozen=True)
class Model:
    means: np.ndarray
    #: inverse Cholesky factors
    whiten: np.ndarray
    constants: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of label 1 for each row."""
        density = [c - 0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) for m, w, c in zip(self.means, self.whiten, self.constants, strict=True)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(labelled: DataFrame, shrinkage: float = SHRINKAGE, floor: float = FLOOR) -> Model:
    """``labelled`` has ``stats`` and ``label`` (0 or 1; other and null labels are left out), all rows are used."""
    d = len(STATISTICS)
    known = labelled.where("label in (0, 1)").select(F.col("label").cast("int"), "stats")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, d)
            y = batch.column(0).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                one = np.hstack([np.ones((int((y == c).sum()), 1)), x[y == c]])
                sums[c] = sums.get(c, 0) + one.T @ one
        for c, s in sums.items():
            n = s.size
            yield pa.RecordBatch.from_arrays([pa.array([c] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(s.ravel())], ["label", "at", "value"])

    parts = known.mapInArrow(moments, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((2, (d + 1) ** 2))
    for r in parts:
        total[r["label"], r["at"]] = r["value"]
    total = total.reshape(2, d + 1, d + 1)
    return fit_moments(total, shrinkage, floor)


def fit_moments(total: np.ndarray, shrinkage: float = SHRINKAGE, floor: float = FLOOR) -> Model:
    """From each class's matrix of ``sum([1, x]^T [1, x])``; a class without rows gets the pooled moments."""
    d = total.shape[1] - 1
    counts, pooled = total[:, 0, 0], total.sum(axis=0)
    if pooled[0, 0] == 0:
        pooled = np.zeros_like(pooled)
        pooled[0, 0] = 1
    mean_all = pooled[0, 1:] / pooled[0, 0]
    spread = np.maximum(np.diag(pooled[1:, 1:]) / pooled[0, 0] - mean_all**2, 1e-6)
    means, whiten, constants = [], [], []
    for c in (0, 1):
        m = total[c] if counts[c] > 1 else pooled
        n = m[0, 0]
        mean = m[0, 1:] / n
        cov = m[1:, 1:] / n - np.outer(mean, mean)
        var = np.maximum(np.diag(cov), floor**2 * spread)
        cov = (1 - shrinkage) * cov
        cov[np.diag_indices(d)] = var
        factor = np.linalg.cholesky(cov)
        means.append(mean)
        whiten.append(np.linalg.inv(factor))
        constants.append(math.log((counts[c] + 1) / (counts.sum() + 2)) - np.log(np.diag(factor)).sum())
    return Model(np.array(means), np.array(whiten), np.array(constants))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Learns from labelled rows whose id is not in fold 0 of ``folds``. Null and empty
    texts are scored on their statistics like others; repeated rows are scored and
    learned from as often as they occur; without any labels all scores are 0.5.
    """
    scored = materialise(statistics(docs, id_col, text_col))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label")).where(remainder(F.col("doc_id"), folds) != 0)
    model = fit(scored.join(known, "doc_id"))
    return apply(scored, model).select("doc_id", (remainder(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def apply(stats: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, folds: int = 5) -> DataFrame:
    """The rows of ``docs``, with their own columns, whose score is ``threshold`` or more.

    The texts stay where they are: the model is fitted first, then applied to each
    batch of whole rows. Null texts are judged as empty ones, repeated rows each by
    itself; a label without id or value teaches nothing; without any labels all scores
    are 0.5 and every row stays. An empty table stays empty; texts may be of any length.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")).where(remainder(F.col("doc_id"), folds) != 0)
    model = fit(statistics(docs, "doc_id", text_col).join(known, "doc_id"))
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics_of(t.as_py() or "") for t in batch.column(at)], float).reshape(-1, len(STATISTICS))
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
