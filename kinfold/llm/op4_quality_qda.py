"""Operator 4: a quality classifier by regularised quadratic discriminant.

Every text becomes a vector of transformed statistics (shares, rates and lengths). The two classes' means and covariances
come from sums over all labelled training rows; each covariance is shrunk towards the pooled one and its diagonal. A text's
score is the difference of the two Gaussian log densities, each a Mahalanobis distance by a Cholesky factor computed once,
mapped to 0..1 by a logistic curve fitted to the training rows' differences.

Plan. The text is read once and not shuffled: statistics go to a narrow table in the shared folder, which the fit and
the scores read. Labels meet statistics by doc_id, as narrow rows. What the driver gets has a fixed size: sums of products
and two histograms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import codes_of, keep, pieces, within, words_of

THRESHOLD = 0.3
FOLDS = 5
SHRINK_TO_POOLED = 0.1
SHRINK_TO_DIAGONAL = 0.1

NAMES = (
    "log_words", "log_bytes", "word_length", "word_length_spread", "letters", "digits", "upper", "sentence_marks", "quotes", "marks",
    "bars", "foreign", "lines", "sentence_words", "distinct_words", "top_word", "short_words", "marked_words", "repeated_lines", "entropy",
)

_KINDS = 9  # lower, upper, digit, sentence mark, quote or dash, other mark, bar, white space, byte over 127


def _kind_table() -> np.ndarray:
    kind = np.full(256, 5, np.uint8)
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 0, 1, 2, 8
    for chars, k in ((".,;:!?", 3), ("'\"-()", 4), ("|", 6), (" \t\n\r\v\f", 7)):
        kind[[ord(c) for c in chars]] = k
    return kind


_KIND = _kind_table()


def _per_text(texts: pa.Array, separator: str) -> tuple[pa.Array, np.ndarray]:
    lists = pc.split_pattern(texts, separator)
    return lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)


def _distinct(codes: np.ndarray, starts: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text: distinct values, and how often the commonest occurs."""
    text, _ = within(starts)
    value, count = np.unique(text * np.int64(max(many, 1)) + codes, return_counts=True)
    of = value // max(many, 1)
    n = len(starts) - 1
    top = np.zeros(n, np.int64)
    np.maximum.at(top, of, count)
    return np.bincount(of, minlength=n), top


def statistics_of(texts: pa.Array) -> np.ndarray:
    """A row of NAMES for each text; null counts as empty. Every value is finite."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    flat, starts = words_of(texts)
    words = np.diff(starts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    size = np.diff(offsets)
    kinds = np.bincount(np.repeat(np.arange(n) * _KINDS, size) + _KIND[raw], minlength=n * _KINDS).reshape(n, _KINDS)
    length = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.float64)
    text, _ = within(starts)
    per = lambda x: np.bincount(text, weights=x, minlength=n)
    some = np.maximum(words, 1)
    mean = per(length) / some
    spread = np.sqrt(np.maximum(per(length**2) / some - mean**2, 0))
    codes, distinct_words = codes_of(flat)
    distinct, top = _distinct(codes, starts, len(distinct_words))
    odd = np.array([not w.strip(".,;:!?'\"-()").isalnum() for w in distinct_words], bool)
    marked = per(odd[codes].astype(float)) if len(codes) else np.zeros(n)
    lines, line_starts = _per_text(texts, "\n")
    line_codes, distinct_lines = codes_of(lines)
    line_count = np.diff(line_starts)
    lines_distinct, _ = _distinct(line_codes, line_starts, len(distinct_lines))
    share = lambda k: np.sqrt(kinds[:, k] / np.maximum(size, 1))
    p = kinds / np.maximum(size, 1)[:, None]
    ends = kinds[:, 3]
    columns = [
        np.log1p(words), np.log1p(size), np.log1p(mean), np.log1p(spread), np.sqrt((kinds[:, 0] + kinds[:, 1] + kinds[:, 8]) / np.maximum(size, 1)),
        share(2), share(1), share(3), share(4), share(5), share(6), share(8), np.log1p(line_count / some), np.log1p(words / np.maximum(ends, 1)),
        np.log((distinct + 1) / (words + 1)), np.sqrt(top / some), np.sqrt(per((length <= 3).astype(float)) / some), np.sqrt(marked / some),
        np.sqrt((line_count - lines_distinct) / np.maximum(line_count, 1)), -(p * np.log(np.maximum(p, 1e-12))).sum(axis=1),
    ]
    return np.stack(columns, axis=1)


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id and the array x of statistics of each row (columns doc_id, text; others are ignored)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            x = statistics_of(piece.column("text"))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), rows], names=["doc_id", "x"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Model:
    """Per class: whitening factor (the inverse of the Cholesky factor), mean and constant; then the logistic curve."""

    factors: tuple[np.ndarray, ...]
    means: tuple[np.ndarray, ...]
    constants: tuple[float, ...]
    slope: float = 1.0
    offset: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, priors included."""
        if not self.factors:
            return np.zeros(len(x))
        d = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for f, m, c in zip(self.factors, self.means, self.constants, strict=True)]
        return d[1] - d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.offset, -50, 50)))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, len(NAMES))


def _sums(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each class: rows, sum of x, sum of products. Partial sums are added up in the cluster, an entry of the sums a row."""
    d = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x, y = _matrix(batch), batch.column("y").to_numpy()
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).reshape(-1)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], names=["i", "v"])

    got = rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(2 * (1 + d + d * d))
    for r in got:
        total[r.i] = r.v
    total = total.reshape(2, -1)
    return total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d)


def _histogram(rows: DataFrame, model: Model, bins: int = 400, width: float = 0.25) -> np.ndarray:
    """Training rows by class and log-density difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * bins, np.int64)
        for batch in batches:
            at = np.clip(np.floor(model.difference(_matrix(batch)) / width) + bins // 2, 0, bins - 1).astype(int)
            total += np.bincount(at + bins * batch.column("y").to_numpy(), minlength=2 * bins)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * bins)), pa.array(total)], names=["i", "v"])

    total = np.zeros(2 * bins)
    for r in rows.mapInArrow(run, "i long, v long").groupBy("i").agg(F.sum("v").alias("v")).collect():
        total[r.i] = r.v
    return total.reshape(2, bins)


def fit(rows: DataFrame, to_pooled: float = SHRINK_TO_POOLED, to_diagonal: float = SHRINK_TO_DIAGONAL) -> Model:
    """A model of rows (x, y with y 0 or 1). Without rows of either class every score is 0.5 (of one class, near that class)."""
    n, s, ss = _sums(rows)
    if n.min() < 2:
        return Model((), (), (), 1.0, float(np.clip(np.log((n[1] + 0.5) / (n[0] + 0.5)), -2, 2)) if n.sum() else 0.0)
    means = s / n[:, None]
    own = ss / n[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = (own * n[:, None, None]).sum(axis=0) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
    unit = np.outer(scale, scale)
    pooled = pooled / unit
    target = (1 - to_diagonal) * pooled + to_diagonal * np.diag(np.diag(pooled))
    factors, constants = [], []
    for c in (0, 1):
        cov = (1 - to_pooled) * own[c] / unit + to_pooled * target + 1e-3 * np.eye(len(scale))
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low) / scale[None, :])
        constants.append(float(np.log(n[c] / n.sum()) - np.log(np.diag(low)).sum()))
    model = Model(tuple(factors), tuple(means), tuple(constants))
    hist = _histogram(rows, model)
    z = (np.arange(hist.shape[1]) - hist.shape[1] // 2 + 0.5) * 0.25
    a, b = 0.5, 0.0
    for _ in range(50):  # Newton steps of a logistic curve with a weak pull towards slope 1
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        total = hist.sum(axis=0)
        r, w = hist[1] - total * p, total * p * (1 - p)
        g = np.array([(r * z).sum() - (a - 1), r.sum() - b * 1e-3])
        h = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = np.clip(a + np.clip(step[0], -0.5, 0.5), 1e-3, 10), b + float(np.clip(step[1], -2, 2))
    return Model(model.factors, model.means, model.constants, float(a), float(b))


def in_fold(doc_id: Column | str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` modulo ``folds``; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def scored(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents (columns doc_id, text; others are ignored).

    Learns from the rows of labels (doc_id, quality 0 or 1) whose document is not held out (crc32(doc_id) mod ``folds`` is 0). score, from 0 to 1, is
    higher where label 1 is likelier; predicted is 1 from ``threshold`` on. Null and empty texts have statistics, so a
    score, like any other. Rows with a null doc_id are scored and not learnt from; null labels and labels other than 0 and 1 are
    ignored; repeated rows of either table count as often as they occur. Without labels every score is 0.5.
    """
    x = keep(statistics(documents), "statistics")
    known = labels.where("quality IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("long").alias("y"))
    train = keep(x.where(~in_fold("doc_id", folds, 0)).join(known, "doc_id").select("x", "y"), "training")
    model = fit(train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch)))], names=["doc_id", "score"])

    out = x.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", in_fold("doc_id", folds, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, folds: int = FOLDS) -> DataFrame:
    """The rows of documents, all columns, whose score is at least ``threshold``; the rules are those of scored.

    The scores are worked out beside the rows, so the text is read twice and never shuffled.
    """
    known = labels.where("quality IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("long").alias("y"))
    x = keep(statistics(documents), "statistics")
    model = fit(keep(x.where(~in_fold("doc_id", folds, 0)).join(known, "doc_id").select("x", "y"), "training"))
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            yield piece.filter(pa.array(model.score(statistics_of(piece.column(at))) >= threshold))

    return documents.mapInArrow(run, documents.schema)
