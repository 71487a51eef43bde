"""Quality by regularised quadratic discriminant analysis of document statistics.

A text becomes ``len(FEATURES)`` numbers: logarithms of its size and of smoothed shares (capitals, symbols, words without letters, repeated
neighbours, distinct words, ...), so that none of them runs away on long or odd texts. Of each class the rows, sums and products of these numbers
are added up, one small matrix for each batch, so all labelled rows teach and the driver gets one matrix a class.

A class has its own mean and its own covariance, shrunk twice: towards the covariance within both classes, by ``POOLED`` rows' worth of it,
and towards a multiple of the identity, by ``RIDGE``. The statistics are first scaled by the spread of all rows. The log-density of a text under
a class comes from its Mahalanobis distance, the length of the row whitened by the inverse of the class's Cholesky factor (found once in a
worker and kept), and from the log of the factor's diagonal. The difference of the two log-densities is clipped to ``MOST`` and turned into a
probability by a logistic curve fitted to the labelled rows.

A text is measured once; fitting and scoring read its numbers only, so no text is shuffled to meet its label.

Defined cases: NULL or empty text is scored by the statistics of an empty text; a training label that is NULL teaches nothing, a repeated id teaches
once, with its largest label; without rows of one of the classes the score is the smoothed share of label 1; ids may be NULL or repeat; an
empty table gives an empty one; other columns are left out. A text is measured whole, in one task, with memory in proportion to its length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daypanel.llm.common import slices, texts_of

FEATURES = (
    "words", "word_bytes", "word_spread", "capitals", "digits", "marks", "symbols", "bare_words", "repeated", "distinct", "lines", "capital_heads",
    "distinct_lines",
)
POOLED = 20.0
RIDGE = 0.02
MOST = 60.0
#: Least variance by which a statistic is scaled, and least mean variance of the identity that is mixed in.
LEAST = 1e-3

#: Classes of bytes: capital, digit, sentence mark, other ASCII symbol, line end, letter (all bytes beyond ASCII among them).
_CAPITAL, _DIGIT, _MARK, _SYMBOL, _LINE, _LETTER, _OTHER = range(7)


def _classes() -> np.ndarray:
    kinds = np.full(256, _LETTER, np.uint8)
    kinds[:33] = kinds[127] = _OTHER
    kinds[33:127] = _SYMBOL
    kinds[48:58], kinds[65:91], kinds[97:123], kinds[10] = _DIGIT, _CAPITAL, _LETTER, _LINE
    kinds[[ord(c) for c in ".,;:!?'\"()-"]] = _MARK
    return kinds


_KINDS = _classes()
_PUNCTUATION = bytes(b for b in range(256) if _KINDS[b] in (_MARK, _SYMBOL))
#: Bytes counted at once.
_PIECE = 1 << 22


def _log_share(part: float, whole: float) -> float:
    return math.log((part + 0.5) / (whole + 1.0))


def statistics(text: str) -> list[float]:
    """The numbers named in ``FEATURES``."""
    raw = text.encode()
    counts = np.zeros(7, np.int64)
    for i in range(0, len(raw), _PIECE):
        counts += np.bincount(_KINDS[np.frombuffer(raw, np.uint8, min(_PIECE, len(raw) - i), i)], minlength=7)
    capital, digit, mark, symbol, line, letter, _ = counts.tolist()
    words = raw.split()
    n, seen = len(words), capital + digit + mark + symbol + letter
    sizes = np.fromiter(map(len, words), np.int64, n)
    bare = sum(not w.strip(_PUNCTUATION) for w in words)
    lines = [part for part in raw.split(b"\n") if part.strip()]
    return [
        math.log1p(n),
        math.log((sizes.mean() if n else 0.0) + 1.0),
        math.log((float(sizes.std()) if n else 0.0) + 1.0),
        _log_share(capital, capital + letter),
        _log_share(digit, seen),
        _log_share(mark, seen),
        _log_share(symbol, seen),
        _log_share(bare, n),
        _log_share(sum(map(eq, words, words[1:])), n),
        math.log((len(set(words)) + 1.0) / (n + 1.0)),
        _log_share(line, n),
        _log_share(sum(65 <= w[0] <= 90 for w in words), n),
        math.log((len(set(lines)) + 1.0) / (len(lines) + 1.0)),
    ]


def _table(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))


@dataclass(frozen=True)
class Discriminant:
    """``centre`` and ``spread`` scale the statistics; ``means`` and ``covariances`` have a row for label 0 and one for label 1."""

    centre: np.ndarray
    spread: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    base: float = 0.0
    slope: float = 0.0

    @cached_property
    def whiteners(self) -> list[np.ndarray]:
        """Inverses of the lower Cholesky factors of the covariances."""
        return [np.linalg.inv(np.linalg.cholesky(c)) for c in self.covariances]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "whiteners"}

    def log_densities(self, rows: np.ndarray) -> np.ndarray:
        """A column a class, without the constant that both share."""
        scaled = (rows - self.centre) / self.spread
        found = []
        for mean, whitener in zip(self.means, self.whiteners, strict=True):
            white = (scaled - mean) @ whitener.T  # the squares of a row add up to the Mahalanobis distance
            found.append(np.log(np.diag(whitener)).sum() - 0.5 * (white**2).sum(1))
        return np.stack(found, 1)

    def margins(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.zeros(len(rows))
        dens = self.log_densities(rows)
        return np.clip(dens[:, 1] - dens[:, 0], -MOST, MOST)

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.base + self.slope * self.margins(rows))))


def shrunk(own: np.ndarray, rows: float, pooled: np.ndarray, weight: float = POOLED, ridge: float = RIDGE) -> np.ndarray:
    """Covariance of a class between its own, the pooled one (as ``weight`` more rows) and a multiple of the identity."""
    values, axes = np.linalg.eigh((rows * own + weight * pooled) / (rows + weight))
    values = np.maximum(values, 0.0)  # sums that are rounded can leave it a little below
    return (axes * ((1 - ridge) * values + ridge * max(values.mean(), LEAST))) @ axes.T


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sums and products of the statistics of each label, one row a label and batch."""
    for batch in batches:
        table, labels = _table(batch), batch.column("label").to_numpy()
        kinds = sorted(set(labels.tolist()))
        rows = [np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()]) for x in (table[labels == k] for k in kinds)]
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(list(rows), pa.list_(pa.float64()))], ["label", "sums"])


def _curve(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Intercept and slope of a logistic curve over (margin, rows, rows of label 1), with Platt's smoothed targets and a small ridge."""
    x, n, ones = (np.array(c, float) for c in zip(*bins, strict=True))
    low, high = 1 / ((n - ones).sum() + 2), (ones.sum() + 1) / (ones.sum() + 2)
    y = ones * high + (n - ones) * low
    design, beta = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -35, 35)))
        hessian = design.T @ (design * (n * p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (y - n * p) - 1e-3 * beta)
        beta = beta + np.clip(step, -2, 2)
        if abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def _measuring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [statistics(t) for t in texts_of(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.float64()))], ["id", "stats"])


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and ``stats``, the numbers named in ``FEATURES``, of every row."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_measuring, f"id {kind}, stats array<double>").withColumnRenamed("id", id_col)


def training_rows(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Statistics and label (0 or 1) of every labelled row of :func:`measure`."""
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("key"))
    chosen = one.agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
    return measured.select(F.col(id_col).alias("key"), "stats").join(chosen, "key").select("stats", "label")


def fit(rows: DataFrame) -> Discriminant:
    """Fit on all rows ``(stats, label)``, see :func:`training_rows`."""
    size = len(FEATURES)
    cells = rows.mapInArrow(_sums, "label int, sums array<double>")
    columns = [F.round(F.sum(F.get("sums", F.lit(i))), 6).alias(f"c{i}") for i in range(1 + size + size * size)]
    added = {r["label"]: np.array(r[1:], float) for r in cells.groupBy("label").agg(*columns).collect()}  # a row a label
    empty = np.zeros((0, size))
    if len(added) < 2:
        n = {k: v[0] for k, v in added.items()}
        share = (n.get(1, 0.0) + 1) / (sum(n.values()) + 2)
        return Discriminant(np.zeros(size), np.ones(size), empty, empty, math.log(share / (1 - share)))
    n = np.array([added[k][0] for k in (0, 1)])
    sums = np.stack([added[k][1 : 1 + size] for k in (0, 1)])
    squares = np.stack([added[k][1 + size :].reshape(size, size) for k in (0, 1)])
    centre = sums.sum(0) / n.sum()
    spread = np.sqrt(np.maximum(np.diag(squares.sum(0)) / n.sum() - centre**2, LEAST))
    means = (sums / n[:, None] - centre) / spread
    scale = np.outer(spread, spread)
    raw = [squares[k] / n[k] - np.outer(sums[k], sums[k]) / n[k] ** 2 for k in (0, 1)]
    own = [(c + c.T) / 2 / scale for c in raw]
    pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    draft = Discriminant(centre, spread, means, np.stack([shrunk(own[k], n[k], pooled) for k in (0, 1)]))
    margin = rows.mapInArrow(_margins(draft), "label int, x double")
    bins = margin.groupBy(F.round("x", 0).alias("x")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y"))
    points = sorted((r["x"], r["n"], r["y"]) for r in bins.collect())  # 2 x MOST + 1 values at most
    base, slope = _curve(points)
    return Discriminant(draft.centre, draft.spread, draft.means, draft.covariances, base, slope)


def _margins(model: Discriminant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(model.margins(_table(batch)))], ["label", "x"])

    return run


def _scoring(model: Discriminant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.probabilities(_table(batch)))], ["id", "score"])

    return run


def score(measured: DataFrame, model: Discriminant, id_col: str = "doc_id") -> DataFrame:
    """Id and ``score`` (0 to 1, the probability of label 1) of every row of :func:`measure`."""
    kind = measured.schema[id_col].dataType.simpleString()
    rows = measured.select(F.col(id_col).alias("id"), "stats")
    return rows.mapInArrow(_scoring(model), f"id {kind}, score double").withColumnRenamed("id", id_col)
