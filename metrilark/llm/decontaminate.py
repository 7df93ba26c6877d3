"""Benchmark decontamination with suffix arrays of the training text (operator 7).

Documents are cut into shards of whole texts. For each shard the suffix array of
its lower-case word sequence is built by prefix doubling, as deep as the longest
test item, with a mark between texts that no match can cross. All suffixes of all
test items are then searched at once: each keeps the interval of training suffixes
that share its first words and narrows it word by word with binary searches; what
is left at the least length are the matches, which are followed on to their full
length. A shard is one slice of an Arrow batch, so nothing is shuffled; the test
items travel in the closure, in slices of a bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._spark import bounded

#: Words of the shortest verbatim match that counts; an item of fewer words counts as a whole, if it has LEAST_ITEM.
MIN_WORDS = 13
LEAST_ITEM = 8
SHARD_BYTES = 2 << 20
#: Bytes of benchmark text searched in one pass over the documents.
SLICE_BYTES = 8 << 20
SCHEMA = "doc_id long, item_id long, words int, doc_word int, item_word int"
_MARK = np.uint64(0)


def sequence(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes with a mark after each text, text of each position, word number of each position)."""
    hashes, rows = B.word_hashes(column)
    hashes = np.where(hashes == _MARK, np.uint64(1), hashes)
    n = len(column)
    counts = np.bincount(rows, minlength=n)
    begins = np.concatenate(([0], np.cumsum(counts + 1)))
    out = np.full(begins[-1], _MARK)
    within = np.arange(len(rows)) - np.concatenate(([0], np.cumsum(counts)))[rows]
    out[begins[rows] + within] = hashes
    owner = np.repeat(np.arange(n), counts + 1)
    return out, owner, np.arange(len(out)) - begins[owner]


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Suffix starts in the order of their first ``depth`` tokens (by hash value), by prefix doubling over the groups that are still tied."""
    n = len(tokens)
    order = np.argsort(tokens, kind="stable")
    if not n:
        return order
    rank = np.empty(n, np.int64)
    new = np.concatenate(([True], tokens[order][1:] != tokens[order][:-1]))
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = first
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    tied = tied[tokens[order[tied]] != _MARK]  # nothing is searched beyond a mark
    step = 1
    while step < depth and len(tied):
        at = order[tied]
        ahead = at + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        at, key, head = at[by], key[by], rank[at[by]]
        order[tied] = at
        new = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.maximum.accumulate(np.where(new, tied, 0))
        rank[at] = first
        alone = new & np.append(new[1:], True)
        tied = tied[~alone]
        step *= 2
    return order


def _narrow(values: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, want: np.ndarray, right: bool) -> np.ndarray:
    """For each interval of suffixes the first whose token at ``depth`` isn't less than (right: is greater than) the one wanted."""
    low, high = low.copy(), high.copy()
    last = len(values) - 1
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high) >> 1
        found = values[np.minimum(order[np.minimum(middle, last)] + depth, last)]
        less = (found <= want) if right else (found < want)
        low = np.where(open_ & less, middle + 1, low)
        high = np.where(open_ & ~less, middle, high)


class Items:
    """The test items: their joint word sequence and the suffixes long enough to match."""

    def __init__(self, rows: list[tuple[int, str]], min_words: int):
        self.ids = pa.array([r[0] for r in rows], pa.int64())
        self.tokens, self.owner, self.word = sequence(pa.array([r[1] for r in rows], pa.string()))
        size = np.bincount(self.owner, minlength=len(rows)) - 1
        need = np.minimum(min_words, size)
        usable = size >= min(LEAST_ITEM, min_words)
        self.depth = int(size.max(initial=0)) + 1
        left = size[self.owner] - self.word
        self.suffixes = np.flatnonzero((left >= need[self.owner]) & usable[self.owner] & (left > 0))
        self.need = need[self.owner][self.suffixes]

    def matches(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(test position, training position, words) of all pairs of suffixes that share at least the words needed."""
        none = np.zeros(0, np.int64)
        if not len(self.suffixes) or not len(tokens):
            return none, none, none
        order = suffix_array(tokens, self.depth)
        first = tokens[order]
        want = self.tokens[self.suffixes]
        low, high = np.searchsorted(first, want, "left"), np.searchsorted(first, want, "right")
        live = np.arange(len(self.suffixes))
        got_q, got_t = [], []
        depth = 1
        while True:
            keep = low < high
            live, low, high = live[keep], low[keep], high[keep]
            ready = self.need[live] == depth
            if ready.any():
                size = high[ready] - low[ready]
                base = np.repeat(low[ready] - np.concatenate(([0], np.cumsum(size)[:-1])), size)
                got_t.append(order[base + np.arange(int(size.sum()))])
                got_q.append(np.repeat(self.suffixes[live[ready]], size))
                live, low, high = live[~ready], low[~ready], high[~ready]
            if not len(live):
                break
            want = self.tokens[self.suffixes[live] + depth]
            low, high = _narrow(tokens, order, low, high, depth, want, False), _narrow(tokens, order, low, high, depth, want, True)
            depth += 1
        if not got_q:
            return none, none, none
        q, t = np.concatenate(got_q), np.concatenate(got_t)
        length = np.zeros(len(q), np.int64)
        going = np.arange(len(q))
        while len(going):
            a, b = q[going] + length[going], t[going] + length[going]
            same = (self.tokens[np.minimum(a, len(self.tokens) - 1)] == tokens[np.minimum(b, len(tokens) - 1)]) & (self.tokens[np.minimum(a, len(self.tokens) - 1)] != _MARK)
            going = going[same]
            length[going] += 1
        return q, t, length

    def longest(self, column: pa.Array) -> tuple[np.ndarray, ...]:
        """(row, item index, words, word in the document, word in the item) of the longest match of each row with each item; ties go to the first in the document, then in the item."""
        tokens, owner, word = sequence(column)
        q, t, length = self.matches(tokens)
        row, item = owner[t], self.owner[q]
        order = np.lexsort((self.word[q], word[t], -length, item, row))
        q, t, length, row, item = q[order], t[order], length[order], row[order], item[order]
        first = np.concatenate(([True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]))) if len(row) else np.zeros(0, bool)
        return row[first], item[first], length[first], word[t[first]], self.word[q[first]]


def item_slices(benchmark: DataFrame, min_words: int) -> Iterator[Items]:
    """The items in slices of about SLICE_BYTES of text, by a hash of the id; one slice is on the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL AND text <> ''")
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    slices = -(-total // SLICE_BYTES)
    for k in range(slices):
        part = items if slices == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k)
        rows = [(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()]
        if rows:
            yield Items(rows, min_words)


def matches(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Longest verbatim match of every document with every benchmark item it leaks.

    Returns ``doc_id, item_id, words, doc_word, item_word``: a row for each row of
    ``docs`` and item that share at least ``min_words`` consecutive words (all words of
    a shorter item, if it has LEAST_ITEM), with the length and the places of the longest
    match. Words are compared in lower case, without blanks and punctuation.

    Null, empty and wordless texts on either side match nothing. Repeated rows get
    their own results; null ids are reported as null, and items of null id are told apart only
    by their rows. Other columns are ignored. Empty tables give an empty result.
    """
    plain = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in item_slices(benchmark, min_words):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for shard in B.pieces(batches, limit=SHARD_BYTES):
                row, item, words, there, here = items.longest(shard.column("text"))
                ids = items.ids.take(pa.array(item))
                yield pa.RecordBatch.from_arrays([shard.column("doc_id").take(pa.array(row)), ids, *(pa.array(x.astype(np.int32)) for x in (words, there, here))], names=["doc_id", "item_id", "words", "doc_word", "item_word"])

        found = plain.mapInArrow(run, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the rows that ``matches`` reports: a map over the rows for each slice of the benchmark, without a shuffle."""
    for items in item_slices(benchmark, min_words):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for shard in B.pieces(batches, limit=SHARD_BYTES):
                keep = np.ones(shard.num_rows, bool)
                keep[items.longest(shard.column("text"))[0]] = False
                yield shard.filter(pa.array(keep))

        docs = bounded(docs).mapInArrow(run, docs.schema)
    return docs
