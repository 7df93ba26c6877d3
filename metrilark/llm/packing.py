"""Best-fit packing after a dominance reduction (operator 3).

Documents are measured in words. A document of more than ``CAPACITY`` words is cut
into full pieces, each a bin of its own, and a rest. Bins depend on the lengths alone,
of which there are at most CAPACITY, so the whole plan is made from a histogram, by
two passes that treat equal lengths together and whose work doesn't depend on the
number of documents:

1. Reduction: from the longest length on, a small set (the piece alone, a pair, a
   triple) that provably dominates every other bin with the piece is fixed for good
   and taken out, as often as its lengths last.
2. Best-fit decreasing on what is left: each piece goes to the fullest bin that holds it.

The documents are then numbered within their length, by counts over hash buckets and a
window in each, and look up the slot of their number.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut

#: Words of a bin.
CAPACITY = 2048
#: Pieces in a bucket within which numbers are given by a window.
BUCKET_ROWS = 1_000_000
SCHEMA = "doc_id long, piece int, length int, bin_id long, bin_offset int, fixed boolean"


@dataclass
class Group:
    """``count`` bins of the same content: (length, copies) in the order of packing."""

    content: list[tuple[int, int]]
    count: int
    fixed: bool
    room: int = 0


class _Lengths:
    """A multiset of lengths with the neighbours of a length at hand."""

    def __init__(self, histogram: dict[int, int]):
        self.count = {w: n for w, n in histogram.items() if n > 0}
        self.order = sorted(self.count)

    def take(self, w: int, n: int) -> None:
        self.count[w] -= n
        if not self.count[w]:
            del self.count[w]
            self.order.pop(bisect.bisect_left(self.order, w))

    def largest(self, most: int) -> int | None:
        """The largest length of at most ``most``."""
        k = bisect.bisect_right(self.order, most)
        return self.order[k - 1] if k else None

    def fits(self, room: int, enough: int) -> int:
        """How many of the smallest pieces fit in ``room``, up to ``enough``."""
        n = 0
        for w in self.order:
            here = min(self.count[w], room // w, enough - n)
            n, room = n + here, room - here * w
            if n == enough or here < self.count[w]:
                return n
        return n


def reduce_dominated(histogram: dict[int, int], capacity: int) -> tuple[list[Group], dict[int, int]]:
    """Bins that some optimal packing has, and the lengths left.

    With j the longest piece not yet seen and h the longest that fits beside it:
    if none fits, {j} is fixed; if only one more piece of any kind can fit, or j + h
    fills the bin, {j, h}; if no more than two fit and the best pair isn't longer than h,
    {j, h} too; if the best pair's longer one is as long as h, and no pair can stand for it
    without being longer than the room, the triple.
    """
    left = _Lengths(histogram)
    fixed: list[Group] = []
    for j in sorted(histogram, reverse=True):
        while left.count.get(j):
            room = capacity - j
            left.take(j, 1)  # the others are those besides j
            more = left.fits(room, 3)
            h = left.largest(room)
            chosen: tuple[int, ...] | None = None
            if more == 0:
                chosen = (j,)
            elif more == 1 or h == room:
                chosen = (j, h)
            elif more == 2:
                a, b = _best_pair(left, room)
                if h >= a + b:
                    chosen = (j, h)
                elif h == a and _no_other_pair(left, room, a, b):
                    chosen = (j, a, b)
            _put_back(left, j)
            if chosen is None:
                break
            need = {w: chosen.count(w) for w in chosen}
            times = min(left.count[w] // k for w, k in need.items())
            for w, k in need.items():
                left.take(w, k * times)
            fixed.append(Group([(w, k) for w, k in need.items()], times, True))
    return fixed, left.count


def _put_back(left: _Lengths, w: int) -> None:
    if w in left.count:
        left.count[w] += 1
    else:
        left.count[w] = 1
        bisect.insort(left.order, w)


def _best_pair(left: _Lengths, room: int) -> tuple[int, int]:
    """The two pieces of largest sum within ``room``; of ties the pair with the longest piece."""
    best = (0, 0, 0)
    low, high = 0, len(left.order) - 1
    while low <= high:
        b, a = left.order[low], left.order[high]
        if a + b > room or (low == high and left.count[a] < 2):
            if low == high:
                break
            if a + b > room:
                high -= 1
                continue
        best = max(best, (a + b, a, b))
        low += 1
    for k, a in enumerate(left.order):
        if left.count[a] > 1 and 2 * a <= room:
            best = max(best, (2 * a, a, a))
    return best[1], best[2]


def _no_other_pair(left: _Lengths, room: int, a: int, b: int) -> bool:
    """Whether at most one piece lies between a and b, or the two next longer than b don't fit."""
    k = bisect.bisect_left(left.order, b)
    between = sum(left.count[w] for w in left.order[k + 1 :] if w < a)
    if between <= 1:
        return True
    longer: list[int] = []
    for w in left.order[k + 1 :]:
        longer += [w] * min(left.count[w], 2)
        if len(longer) >= 2:
            break
    return sum(longer[:2]) > room


def best_fit(histogram: dict[int, int], capacity: int) -> list[Group]:
    """Best-fit decreasing on lengths: of the open bins that hold a piece it goes to the one with least room, else to a new one."""
    done: list[Group] = []
    rooms: dict[int, list[Group]] = {}
    order: list[int] = []

    def add(g: Group) -> None:
        if not g.count:
            return
        if not g.room:
            done.append(g)
            return
        if g.room not in rooms:
            rooms[g.room] = []
            bisect.insort(order, g.room)
        rooms[g.room].append(g)

    for w in sorted(histogram, reverse=True):
        n = histogram[w]
        while n:
            k = bisect.bisect_left(order, w)
            if k < len(order):
                room = order[k]
                group = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    order.pop(k)
            else:
                room, group = capacity, Group([], -(-n // (capacity // w)), False, capacity)
            each = room // w
            full = min(group.count, n // each)
            add(Group([*group.content, (w, each)], full, False, room - each * w))
            n -= full * each
            rest = group.count - full
            if rest and n:  # n < each: the last of these pieces share one bin
                add(Group([*group.content, (w, n)], 1, False, room - n * w))
                rest, n = rest - 1, 0
            add(Group(group.content, rest, False, room) if group.content else Group([], 0, False))
    return done + [g for room in order for g in rooms[room]]


@dataclass
class Plan:
    """Slots of each length: the pieces numbered from ``start`` on go to bins from ``first_bin`` on, ``copies`` to a bin, from ``offset`` in it."""

    groups: list[Group]
    bins: int
    slots: dict[int, tuple[np.ndarray, ...]] = field(default_factory=dict)

    @classmethod
    def make(cls, histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
        fixed, rest = reduce_dominated(histogram, capacity)
        groups = fixed + best_fit(rest, capacity)
        rows: dict[int, list[tuple]] = {}
        used: dict[int, int] = {}
        at = 0
        for g in groups:
            offset = 0
            for w, copies in g.content:
                rows.setdefault(w, []).append((used.get(w, 0), at, copies, offset, g.fixed))
                used[w] = used.get(w, 0) + copies * g.count
                offset += w * copies
            at += g.count
        return cls(groups, at, {w: tuple(np.array(c) for c in zip(*r)) for w, r in rows.items()})

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bin, offset in it, fixed) of the pieces with these lengths and numbers within the length."""
        bins, offsets, fixed = np.zeros(len(length), np.int64), np.zeros(len(length), np.int32), np.zeros(len(length), bool)
        for w in np.unique(length):
            at = np.flatnonzero(length == w)
            start, first, copies, offset, by = self.slots[int(w)]
            k = np.searchsorted(start, number[at], side="right") - 1
            inside = number[at] - start[k]
            bins[at] = first[k] + inside // copies[k]
            offsets[at] = offset[k] + (inside % copies[k]) * w
            fixed[at] = by[k]
        return bins, offsets, fixed


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """A bin for every piece of ``docs(doc_id, text, ...)``: ``doc_id, piece, length, bin_id, bin_offset, fixed``.

    Lengths are words between blanks; ``piece`` counts the cuts of a document of more
    than ``capacity`` words; ``fixed`` bins come from the reduction or are full
    pieces. No bin holds more than ``capacity`` words and no document is cut that fits.
    Null, empty and blank texts have no words and no row. Repeated rows and null
    doc_ids are packed like any other. Which of several pieces of one length gets which slot
    follows from their doc_id and piece. Other columns are ignored. An empty table gives an empty result.
    """
    words = F.regexp_count(F.col("text").cast("string"), F.lit(r"\S+"))
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words")).where("words > 0"))
    whole = F.floor(F.col("words") / capacity).cast("int")
    rest = (F.col("words") % capacity).cast("int")
    ends = sized.where(rest > 0).select("doc_id", whole.alias("piece"), rest.alias("length"))
    full = sized.where(whole > 0).select("doc_id", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece"), F.lit(capacity).alias("length"))
    histogram = {r["length"]: r["n"] for r in ends.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = Plan.make(histogram, capacity)
    buckets = max(1, sum(histogram.values()) // BUCKET_ROWS)
    ends = _numbered(ends, buckets)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, offsets, fixed = plan.place(batch.column("length").to_numpy(), batch.column("number").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "length")), pa.array(bins), pa.array(offsets), pa.array(fixed)], names=["doc_id", "piece", "length", "bin_id", "bin_offset", "fixed"])

    placed = ends.mapInArrow(place, SCHEMA)
    alone = _numbered(full, max(1, full.count() // BUCKET_ROWS)).select("doc_id", "piece", "length", (F.lit(plan.bins) + F.col("number")).alias("bin_id"), F.lit(0).alias("bin_offset"), F.lit(True).alias("fixed"))
    return placed.unionByName(alone)


def _numbered(pieces: DataFrame, buckets: int) -> DataFrame:
    """``pieces`` with a ``number`` from 0 within each length: a window in each (length, bucket) after the counts of the buckets before it."""
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")))
    return ranked.join(before, ["length", "bucket"]).select("doc_id", "piece", "length", (F.col("rank") - 1 + F.col("before")).cast("long").alias("number"))
