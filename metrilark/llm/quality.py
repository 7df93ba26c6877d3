"""Document quality by random Fourier features and ridge regression (operator 6).

1. One pass over the texts computes the document statistics of STATISTICS; the rest works
   on these few numbers a document. Their means and deviations come from all documents.
2. Standardised statistics are mapped to random Fourier features, whose inner products
   approximate a Gaussian kernel. Each partition of the labelled documents sums
   its part of the normal equations; the parts are added by a partially
   aggregated ``groupBy``, so the driver solves one small system whatever the number of labels.
3. The ridge score of documents that were held out is calibrated by isotonic regression, on
   counts over a fine grid of scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from . import calibrate
from ._spark import bounded, cut, small

STATISTICS = (
    "log_words",
    "word_length",
    "word_length_deviation",
    "distinct_words",
    "function_words",
    "letters",
    "capitals",
    "digits",
    "sentence_marks",
    "other_marks",
    "doubled_marks",
    "blanks",
    "other_bytes",
    "log_lines",
    "log_line_length",
    "distinct_lines",
    "short_lines",
    "ended_lines",
)
FEATURES = 192
#: Width of the kernel in standard deviations of the statistics, for all of them together.
WIDTH = 2.0 * len(STATISTICS) ** 0.5
RIDGE = 1e-3
#: Of this many labelled documents one, by a hash of doc_id, is held out for the calibration.
HELD = 5
#: Steps of the score in which the held-out labels are counted.
GRID = 4096
#: Calibrated score from which a document is kept.
THRESHOLD = 0.5
FUNCTION_WORDS = "the of and to in is that it for on with as was are by this be at from or an not de la le les des et en un une du que qui dans est pour pas sur au par el los las y del se una con su al es der die und das von den mit zu im ein eine ist nicht sich auf dem".split()
SCHEMA = "doc_id long, score double, quality double, keep boolean"

_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[[*range(48, 58)]] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 3
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 4
_KIND[128:] = 5
_CAPITAL = np.zeros(256, np.uint8)
_CAPITAL[65:91] = 1
_END = np.zeros(256, np.uint8)
_END[[ord(c) for c in ".!?\"')]:"]] = 1


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


_FUNCTION = np.sort(np.array([B.hash_text(w) for w in FUNCTION_WORDS], np.uint64))


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text; a text without a word has NaN."""
    flat, offsets = B.text_buffer(column)
    n = len(column)
    size = np.maximum(np.diff(offsets), 1).astype(np.float64)
    lower, lower_offsets = B.text_buffer(B.lowered(column))
    starts, ends, rows = B.words(lower, lower_offsets)
    hashes = B.span_hashes(lower, starts, ends)
    words = np.bincount(rows, minlength=n).astype(np.float64)
    per_word = np.maximum(words, 1)
    length = (ends - starts).astype(np.float64)
    mean = np.bincount(rows, length, n) / per_word
    deviation = np.sqrt(np.maximum(np.bincount(rows, length**2, n) / per_word - mean**2, 0))
    distinct = np.bincount(B.distinct_per_row(hashes, rows)[1], minlength=n) / per_word
    at = np.minimum(np.searchsorted(_FUNCTION, hashes), len(_FUNCTION) - 1)
    common = np.bincount(rows, _FUNCTION[at] == hashes, n) / per_word
    kind = _KIND[flat]
    share = [_sums(kind == k, offsets) / size for k in range(6)]
    letters = np.maximum(_sums(kind == 1, offsets), 1)
    doubled = np.zeros(len(flat), bool)
    if len(flat) > 1:
        doubled[1:] = (flat[1:] == flat[:-1]) & ((kind[1:] == 0) | (kind[1:] == 4))
    begin, stop, owner = B.spans_of((flat != 10).astype(np.uint8), offsets)
    lines = np.bincount(owner, minlength=n).astype(np.float64)
    per_line = np.maximum(lines, 1)
    lines_distinct = np.bincount(B.distinct_per_row(B.span_hashes(flat, begin, stop), owner)[1], minlength=n) / per_line
    brief = np.bincount(owner, (stop - begin) < 40, n) / per_line
    ended = np.bincount(owner, _END[flat[stop - 1]] if len(stop) else None, n) / per_line
    out = np.stack(
        [
            np.log1p(words),
            mean,
            deviation,
            distinct,
            common,
            share[1] + share[5],
            _sums(_CAPITAL[flat], offsets) / letters,
            share[2],
            share[4],
            share[0],
            _sums(doubled, offsets) / size,
            share[3],
            share[5],
            np.log1p(lines),
            np.log1p(size / per_line),
            lines_distinct,
            brief,
            ended,
        ],
        axis=1,
    )
    out[words == 0] = np.nan
    return out


def _statistics_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in B.pieces(batches):
        x = statistics(piece.column("text"))
        rows = pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.float32).ravel()), len(STATISTICS)).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), rows, pa.array(~np.isnan(x[:, 0]))], names=["doc_id", "x", "has"])


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, x, has`` for every row of ``docs(doc_id, text, ...)``: the statistics, and whether the text has a word at all."""
    plain = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_statistics_batches, "doc_id long, x array<float>, has boolean")


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


@dataclass
class Features:
    """Random Fourier features: cosines of projections of the standardised statistics on normal directions, with random phases."""

    mean: np.ndarray
    deviation: np.ndarray
    direction: np.ndarray
    phase: np.ndarray

    @classmethod
    def make(cls, mean: np.ndarray, deviation: np.ndarray, features: int = FEATURES, width: float = WIDTH) -> Features:
        rng = np.random.default_rng(6)
        return cls(mean, np.where(deviation > 1e-9, deviation, 1), rng.standard_normal((len(mean), features)) / width, rng.uniform(0, 2 * np.pi, features))

    def of(self, x: np.ndarray) -> np.ndarray:
        """The features of rows of statistics, and a one for the intercept."""
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        out = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.direction + self.phase)
        return np.hstack([out, np.ones((len(x), 1))])


@dataclass
class Model:
    features: Features | None
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ridge score and calibrated probability of rows of statistics."""
        if self.features is None:
            score = np.full(len(x), float(self.values[0]))
            return score, score
        score = np.round(self.features.of(x) @ self.weights, 9)
        return score, calibrate.apply(self.knots, self.values, score)


def _labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """``x, label, held`` of the documents with a word and a quality of 0 or 1; of several labels of a doc_id the largest counts."""
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    good = cut(good)
    return stats.where("has").join(small(good, 16), "doc_id").select("x", "label", (F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(HELD)) == 0).alias("held"))


def _normal_equations(batches: Iterator[pa.RecordBatch], features: Features, weight: tuple[float, float]) -> Iterator[pa.RecordBatch]:
    d = len(features.phase) + 1
    total = np.zeros((d, d + 1))
    for batch in batches:
        if batch.num_rows:
            z, y = features.of(matrix(batch.column("x"))), batch.column("label").to_numpy().astype(np.float64)
            w = np.where(y == 1, weight[1], weight[0])[:, None]
            total[:, :d] += z.T @ (z * w)
            total[:, d:] += z.T @ (y[:, None] * w)
    at = np.flatnonzero(np.hstack([np.triu(np.ones((d, d), bool)), np.ones((d, 1), bool)]))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at])], names=["k", "v"])


def solve(total: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Ridge weights from summed normal equations [A | b]; the intercept isn't penalised."""
    d = len(total)
    upper = np.triu(total[:, :d])
    a = upper + np.triu(upper, 1).T
    penalty = np.full(d, ridge * max(1.0, a[-1, -1]))
    penalty[-1] = 1e-9
    return np.linalg.solve(a + np.diag(penalty), total[:, d])


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """The classifier from ``document_statistics`` and ``labels(doc_id, quality)``.

    Both classes weigh the same in the fit; the calibration gives them the labels' own shares. Without labelled
    documents of both classes in either part, every document gets the labels' share of good ones (1 without labels).
    """
    x = [F.col("x")[k].cast("double") for k in range(len(STATISTICS))]
    moments = stats.where("has").agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(x)], *[F.stddev_pop(c).alias(f"s{k}") for k, c in enumerate(x)]).first()
    rows = cut(_labelled(stats, labels))
    shares = {(r["held"], r["label"]): r["n"] for r in rows.groupBy("held", "label").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 4:
        all_ = sum(shares.values())
        share = sum(n for (_, y), n in shares.items() if y == 1) / all_ if all_ else 1.0
        return Model(None, np.zeros(0), np.array([0.0]), np.array([share]))
    features = Features.make(*(np.array([moments[f"{p}{k}"] for k in range(len(STATISTICS))]) for p in "ms"))
    used = {y: shares[False, y] for y in (0, 1)}
    weight = (0.5 / used[0] * sum(used.values()), 0.5 / used[1] * sum(used.values()))
    summed = rows.where("NOT held").select("x", "label").mapInArrow(lambda it: _normal_equations(it, features, weight), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    d = FEATURES + 1
    total = np.zeros(d * (d + 1))
    total[summed["k"].to_numpy()] = summed["v"].to_numpy()
    weights = solve(total.reshape(d, d + 1))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = np.floor(features.of(matrix(batch.column("x"))) @ weights * GRID + 0.5).astype(np.int64) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(step), batch.column("label").cast(pa.float64())], names=["step", "label"])

    held = rows.where("held").select("x", "label").mapInArrow(scored, "step long, label double").groupBy("step").agg(F.avg("label").alias("mean"), F.count("*").alias("n")).toPandas()
    knots, values = calibrate.isotonic(held["step"].to_numpy() / GRID, held["mean"].to_numpy(), held["n"].to_numpy().astype(np.float64))
    return Model(features, weights, knots, values)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, score, quality, keep`` of every row of ``docs(doc_id, text, ...)``.

    ``score`` is the ridge regression's, ``quality`` the calibrated probability that a
    document is good, and ``keep`` whether it reaches THRESHOLD. Null, empty and wordless texts have
    a null score, the quality 0 and aren't kept. Labels that are null or neither 0 nor 1 are
    left out. Repeated rows get a row each; null doc_ids are scored too. Other columns are
    ignored. An empty table gives an empty result.
    """
    stats = cut(document_statistics(docs))
    model = fit(stats, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has = batch.column("has").to_numpy(zero_copy_only=False)
            score, value = np.zeros(len(has)), np.zeros(len(has))
            if has.any():
                score[has], value[has] = model.score(matrix(batch.column("x"))[has])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, mask=~has), pa.array(value), pa.array(has & (value >= THRESHOLD))], names=["doc_id", "score", "quality", "keep"])

    return stats.mapInArrow(run, SCHEMA)
