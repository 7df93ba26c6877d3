"""Toxicity by nearest labelled examples (operator 9).

Examples are a bounded sample of the labelled documents (``EXAMPLES`` of each
class, in hash order), two thirds to search and one third to calibrate on. Every
word of the examples is a term; document frequencies are counted over the whole
corpus. A term's weight grows smoothly with how much it tells of the label (the log-likelihood
ratio of a word and a label in the searched examples), for with plain TF-IDF the
topic decides who is near; no term is left out. Every document is then a query: its exact cosine with the TF-IDF vectors of
all searched examples is looked for in an inverted index whose postings are cut into
blocks of similar examples with a largest weight per block and term. A query first
scores the block of the highest upper bound, then the next ones, and skips every block that can't
reach its k-th neighbour any more, so that the result is that of a full scan. All
queries that score a block do it together. The neighbours vote with weights by
distance; an isotonic fit on the calibration part, weighted to the classes' shares
among the labels, turns votes into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from . import calibrate
from ._spark import bounded, cut

#: Labelled documents of each class that are used at most; all statistics besides come from the whole corpus.
EXAMPLES = 3000
NEIGHBOURS = 15
#: Log-likelihood ratio that doubles a term's squared weight.
GAIN = 10.0
BLOCK = 128
#: Terms in more than this share of the examples of a block, or of the blocks, have their row of weights written out.
DENSE = 0.25
#: Cosines are compared in steps of 2**-40.
_STEP = 1 << 40
_EPS = 1e-9
_PLACES = 20
#: Terms of queries that are searched together.
_TOGETHER = 1 << 15
#: Calibrated score from which a document is toxic.
THRESHOLD = 0.5
#: A doc_id that no example has, for rows without one.
_NOBODY = -(1 << 63)
EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.bool_())]))
SCHEMA = "doc_id long, toxic_score double, toxic boolean, evidence array<struct<doc_id:long,similarity:double,toxic:boolean>>"


def term_counts(column: pa.Array, vocabulary: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of the distinct terms of each row, ordered; a term is a word hash or, with a sorted vocabulary, its index there."""
    hashes, rows = B.word_hashes(column)
    if vocabulary is not None:
        at = np.searchsorted(vocabulary, hashes)
        hit = at < len(vocabulary)
        hit[hit] = vocabulary[at[hit]] == hashes[hit]
        hashes, rows = at[hit].astype(np.uint64), rows[hit]
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    if not len(rows):
        return rows, hashes, rows
    first = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1]))))
    return rows[first], hashes[first], np.diff(np.append(first, len(rows)))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair, one after another."""
    return np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(int(counts.sum()))


class Postings:
    """A matrix of terms and columns that is sparse but for the rows of frequent terms."""

    def __init__(self, term: np.ndarray, column: np.ndarray, value: np.ndarray, terms: int, columns: int):
        order = np.lexsort((column, term))
        has, size = np.unique(term, return_counts=True)
        self.__setstate__((terms, columns, has.astype(np.int32), size.astype(np.int32), column[order].astype(np.int32), value[order]))

    def __getstate__(self) -> tuple:
        """What travels in the tasks; tables by term are written out there."""
        return self.state

    def __setstate__(self, state: tuple) -> None:
        self.state = state
        terms, self.columns, has, size, self.column, self.value = state
        self.start = np.zeros(terms + 1, np.int32)
        self.start[has + 1] = size
        np.cumsum(self.start, out=self.start)
        frequent = size > DENSE * self.columns
        self.row = np.full(terms, -1, np.int32)
        self.row[has[frequent]] = np.arange(frequent.sum())
        self.dense = np.zeros((int(frequent.sum()), self.columns))
        dense = self.row[np.repeat(has, size)]
        self.dense[dense[dense >= 0], self.column[dense >= 0]] = self.value[dense >= 0]

    def product(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, queries: int) -> np.ndarray:
        """Queries times columns, for queries as (query, term, weight)."""
        row = self.row[term]
        dense = row >= 0
        q = np.zeros((queries, len(self.dense)))
        q[query[dense], row[dense]] = weight[dense]
        out = q @ self.dense
        query, term, weight = query[~dense], term[~dense], weight[~dense]
        start = self.start[term].astype(np.int64)
        size = self.start[term + 1] - start
        at = _ranges(start, size)
        cell = np.repeat(query * self.columns, size) + self.column[at]
        return out + np.bincount(cell, np.repeat(weight, size) * self.value[at], queries * self.columns).reshape(out.shape)


def similar_order(row: np.ndarray, term: np.ndarray, weight: np.ndarray, rows: int, terms: int) -> np.ndarray:
    """The rows in an order in which similar ones are near each other: halved along the principal axis again and again, to blocks."""
    rng = np.random.default_rng(7)
    parts, done = [np.arange(rows)], []
    member = np.full(rows, -1, np.int64)
    while parts:
        part = parts.pop()
        if len(part) <= BLOCK:
            done.append(part)
            continue
        member[part] = np.arange(len(part))
        at = member[row] >= 0
        r, t, w = member[row[at]], term[at], weight[at]
        mean = np.bincount(t, w, terms) / len(part)
        axis = rng.standard_normal(len(part))
        for _ in range(12):
            back = np.bincount(t, w * axis[r], terms) - mean * axis.sum()
            axis = np.bincount(r, w * back[t], len(part)) - (mean * back).sum()
            axis /= np.sqrt(axis @ axis) or 1.0
        member[part] = -1
        order = np.lexsort((part, axis))
        half = -(-len(part) // (2 * BLOCK)) * BLOCK
        parts += [part[order[half:]], part[order[:half]]]
    return np.concatenate(done) if done else np.arange(0)


@dataclass
class BlockMaxIndex:
    """TF-IDF vectors of unit length, in blocks of BLOCK similar examples with the largest weight of each (term, block). Examples are in the order of their ids, ``place`` has that of the blocks."""

    vocabulary: np.ndarray
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    place: np.ndarray
    bound: Postings
    blocks: list[Postings]

    @classmethod
    def build(cls, vocabulary: np.ndarray, idf: np.ndarray, ids: np.ndarray, labels: np.ndarray, row: np.ndarray, term: np.ndarray, count: np.ndarray) -> BlockMaxIndex:
        weight = (1 + np.log(count)) * idf[term]
        norm = np.sqrt(np.bincount(row, weight**2, len(ids)))
        weight = weight / np.where(norm, norm, 1)[row]
        place = similar_order(row, term, weight, len(ids), len(idf))
        at = np.argsort(place)[row]
        block = at // BLOCK
        n = -(-len(ids) // BLOCK)
        key, inverse = np.unique(term * n + block, return_inverse=True)
        top = np.zeros(len(key))
        np.maximum.at(top, inverse, weight)
        by_block = [np.flatnonzero(block == b) for b in range(n)]
        blocks = [Postings(term[k], at[k] - b * BLOCK, weight[k], len(idf), min(BLOCK, len(ids) - b * BLOCK)) for b, k in enumerate(by_block)]
        return cls(vocabulary, idf, ids, labels, place, Postings(key // n, key % n, top, len(idf), n), blocks)

    def weights(self, row: np.ndarray, term: np.ndarray, count: np.ndarray, rows: int) -> np.ndarray:
        """The unit vectors of texts as (row, term, count)."""
        weight = (1 + np.log(count)) * self.idf[term]
        norm = np.sqrt(np.bincount(row, weight**2, rows)) if len(row) else np.ones(rows)
        return weight / np.where(norm, norm, 1)[row]

    def nearest(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the k nearest examples of each query that share a term, by falling cosine, then by position; position -1 where there are fewer."""
        n = len(self.blocks)
        bounds = self.bound.product(row, term, weight, rows)
        # a key is the cosine in steps, then the position, such that of equal cosines the earlier position has the higher key
        best = np.zeros((rows, k), np.int64)
        open_ = bounds > 0
        first = np.searchsorted(row, np.arange(rows + 1))
        for reach in sorted({1, min(3, n), n}):
            kth = (best[:, 0] >> _PLACES) / _STEP
            open_ &= bounds >= kth[:, None] - _EPS
            least = np.partition(np.where(open_, bounds, 0), n - reach, axis=1)[:, n - reach]
            now = open_ & (bounds >= least[:, None])
            for b in np.flatnonzero(now.any(axis=0)):
                q = np.flatnonzero(now[:, b] & (bounds[:, b] >= (best[:, 0] >> _PLACES) / _STEP - _EPS))
                size = first[q + 1] - first[q]
                at = _ranges(first[q], size)
                score = self.blocks[b].product(np.repeat(np.arange(len(q)), size), term[at], weight[at], len(q))
                steps = np.rint(score * _STEP).astype(np.int64)
                place = (1 << _PLACES) - 1 - self.place[b * BLOCK : b * BLOCK + score.shape[1]]
                both = np.concatenate([best[q], np.where(steps > 0, (steps << _PLACES) | place, 0)], axis=1)
                both.partition(both.shape[1] - k, axis=1)
                best[q] = both[:, -k:]
            open_ &= ~now
        best.sort(axis=1)
        best = best[:, ::-1]
        return np.where(best > 0, (1 << _PLACES) - 1 - (best & ((1 << _PLACES) - 1)), -1), (best >> _PLACES) / _STEP

    def votes(self, row: np.ndarray, term: np.ndarray, count: np.ndarray, own: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(share of the votes for toxic, neighbours' positions or -1, cosines) of each text; the share is -1 without a neighbour. A neighbour votes with its cosine; the example of doc_id ``own`` isn't asked."""
        rows = len(own)
        weight = self.weights(row, term, count, rows)
        near, cosine = np.full((rows, k + 1), -1, np.int64), np.zeros((rows, k + 1))
        first = np.searchsorted(row, np.arange(rows + 1))
        at = 0
        while at < rows:
            to = max(at + 1, int(np.searchsorted(first, first[at] + _TOGETHER, side="right")) - 1)
            some = slice(first[at], first[to])
            near[at:to], cosine[at:to] = self.nearest(row[some] - at, term[some], weight[some], to - at, k + 1)
            at = to
        mine = (near >= 0) & (self.ids[near] == own[:, None])
        order = np.argsort(mine, axis=1, kind="stable")[:, :k]  # the own example goes last, or else the one too many
        near, cosine = np.take_along_axis(np.where(mine, -1, near), order, 1), np.take_along_axis(cosine, order, 1)
        weight = np.where(near >= 0, cosine, 0)
        total = weight.sum(axis=1)
        return np.where(total > 0, (weight * self.labels[near]).sum(axis=1) / np.where(total > 0, total, 1), -1.0), near, cosine


@dataclass
class Model:
    index: Broadcast | None
    knots: np.ndarray
    values: np.ndarray

    def toxic(self, scores: np.ndarray) -> np.ndarray:
        """Which scores mean toxic; none without an index, for the labels' share alone says nothing about a document."""
        return scores >= THRESHOLD if self.index is not None else np.zeros(len(scores), bool)

    def score(self, column: pa.Array, own: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """The score of each text and its neighbours."""
        if self.index is None:
            return np.full(len(column), float(self.values[0])), pa.array([[]] * len(column), EVIDENCE)
        index = self.index.value
        row, term, count = term_counts(column, index.vocabulary)
        ids = pc.fill_null(own.cast(pa.int64()), _NOBODY).to_numpy(zero_copy_only=False)
        votes, near, cosine = index.votes(row, term.astype(np.int64), count, ids)
        has = near >= 0
        flat = near[has]
        items = pa.StructArray.from_arrays([pa.array(index.ids[flat]), pa.array(cosine[has]), pa.array(index.labels[flat] == 1)], names=["doc_id", "similarity", "toxic"])
        return calibrate.apply(self.knots, self.values, votes), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(has.sum(axis=1)))), pa.int32()), items)


def _plain(docs: DataFrame) -> DataFrame:
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in B.pieces(batches):
        row, term, count = term_counts(piece.column("text"))
        offsets = pa.array(np.searchsorted(row, np.arange(piece.num_rows + 1)), pa.int32())
        columns = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (term.view(np.int64), count.astype(np.int32))]
        yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("doc_id", "label", "held")), *columns], names=["doc_id", "label", "held", "terms", "counts"])


def _document_frequencies(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    total, seen = np.zeros(len(vocabulary), np.int64), 0
    for piece in B.pieces(batches):
        _, term, _ = term_counts(piece.column("text"), vocabulary)
        total += np.bincount(term.astype(np.int64), minlength=len(vocabulary))
        seen += piece.num_rows
    has = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(has, -1)), pa.array(np.append(total[has], seen))], names=["term", "n"])


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Model:
    """The index and calibration for ``docs(doc_id, text)`` from ``labels(doc_id, toxic)``.

    Labels that are null or neither 0 nor 1 are left out; of several for a doc_id
    the largest counts. Of several rows with a doc_id that is sampled the one with
    the smallest text counts. Without labelled documents of both classes, or without a
    word in them, every document gets the labels' share of toxic (0 without labels) and none is called toxic.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    shares = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    base = shares.get(1, 0) / max(1, sum(shares.values()))
    flat = Model(None, np.array([0.0]), np.array([base]))
    if len(shares) < 2:
        return flat
    order = [F.xxhash64(F.lit(11), "doc_id"), "doc_id"]
    sample = labels.where("label = 1").orderBy(*order).limit(examples).unionByName(labels.where("label = 0").orderBy(*order).limit(examples))
    sample = sample.withColumn("held", F.pmod(F.xxhash64(F.lit(12), "doc_id"), F.lit(3)) == 0)
    chosen = _plain(docs).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"), F.first("held").alias("held")).where("text IS NOT NULL")
    examples_of = cut(chosen.mapInArrow(_example_terms, "doc_id long, label int, held boolean, terms array<long>, counts array<int>").where("size(terms) > 0"))
    rows = examples_of.where("NOT held").toArrow().sort_by("doc_id")
    ids, label = rows.column("doc_id").to_numpy(), rows.column("label").to_numpy().astype(float)
    row = np.repeat(np.arange(len(ids)), pc.list_value_length(rows.column("terms")).to_numpy())
    hashes, count = pc.list_flatten(rows.column("terms")).to_numpy().view(np.uint64), pc.list_flatten(rows.column("counts")).to_numpy()
    toxic, clean = int((label == 1).sum()), int((label == 0).sum())
    if not toxic or not clean:
        return flat
    vocabulary = np.unique(hashes)
    seen = _plain(docs).select("text").mapInArrow(lambda it: _document_frequencies(it, vocabulary), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(len(vocabulary) + 1, np.int64)  # the last is the number of documents
    frequency[seen.column("term").to_numpy()] = seen.column("n").to_numpy()
    idf = np.log((1 + frequency[-1]) / np.maximum(1, frequency[:-1]))
    term = np.searchsorted(vocabulary, hashes)
    idf = idf * np.sqrt(1 + likelihood_ratio(term, label[row] == 1, len(vocabulary), toxic, clean) / GAIN)
    # one copy a worker, whatever the number of tasks; bounded by the examples
    index = docs.sparkSession.sparkContext.broadcast(BlockMaxIndex.build(vocabulary, idf, ids, label, row, term, count))
    asked = examples_of.where("held").mapInArrow(lambda it: _held_votes(it, index.value), "label int, vote double").toArrow()
    targets, votes = asked.column("label").to_numpy().astype(float), asked.column("vote").to_numpy()
    per_class = [shares[y] / max(1, int((targets == y).sum())) for y in (0, 1)]
    return Model(index, *calibrate.isotonic(votes, targets, np.where(targets == 1, per_class[1], per_class[0])))


def _held_votes(batches: Iterator[pa.RecordBatch], index: BlockMaxIndex) -> Iterator[pa.RecordBatch]:
    """The votes on examples that aren't searched, from their terms."""
    for rows in batches:
        if not rows.num_rows:
            continue
        row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(rows.column("terms")).to_numpy())
        hashes, count = pc.list_flatten(rows.column("terms")).to_numpy().view(np.uint64), pc.list_flatten(rows.column("counts")).to_numpy()
        term = np.minimum(np.searchsorted(index.vocabulary, hashes), len(index.vocabulary) - 1)
        known = index.vocabulary[term] == hashes
        votes, _, _ = index.votes(row[known], term[known], count[known], rows.column("doc_id").to_numpy())
        yield pa.RecordBatch.from_arrays([rows.column("label"), pa.array(votes)], names=["label", "vote"])


def likelihood_ratio(term: np.ndarray, toxic: np.ndarray, terms: int, n_toxic: int, n_clean: int) -> np.ndarray:
    """G of the 2 x 2 table of each term and the label; ``term`` has each example's distinct terms, ``toxic`` the examples' labels."""
    out = np.zeros(terms)
    total = n_toxic + n_clean
    has = [np.bincount(term[toxic == y], minlength=terms) for y in (False, True)]
    both = has[0] + has[1]
    for y, n in ((0, n_clean), (1, n_toxic)):
        for seen, of in ((has[y], both), (n - has[y], total - both)):
            out += 2 * seen * np.log(np.maximum(seen, 1e-300) * total / np.maximum(of * n, 1))
    return np.maximum(out, 0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, toxic_score, toxic, evidence`` for every row; see ``toxicity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in B.pieces(batches):
            scores, evidence = model.score(piece.column("text"), piece.column("doc_id"))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(scores), pa.array(model.toxic(scores)), evidence], names=["doc_id", "toxic_score", "toxic", "evidence"])

    return _plain(docs).mapInArrow(run, SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """Calibrated toxicity of every row of ``docs(doc_id, text, ...)``, with its neighbours as evidence.

    ``evidence`` has its NEIGHBOURS nearest examples by falling cosine, of equal ones
    the smaller doc_id first. Only the words of the examples count, with frequencies
    over all of ``docs``. A labelled document is never its own neighbour. Null, empty and wordless texts
    share no term with an example and get the score of documents without
    evidence. A text of any length is one query, over all its words. Repeated rows get a row each; null doc_ids are scored too. Other columns
    are ignored. An empty table gives an empty result.
    """
    return score(docs, fit(docs, labels, examples))


def drop_toxic(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """``docs`` without the rows that ``toxicity`` finds toxic: one map over the rows, without a shuffle. Columns and all other rows stay as they are."""
    model = fit(docs, labels, examples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in B.pieces(batches):
            scores, _ = model.score(piece.column("text"), piece.column("doc_id"))
            yield piece.filter(pa.array(~model.toxic(scores)))

    return bounded(docs).mapInArrow(run, docs.schema)
